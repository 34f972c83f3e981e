import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from loomgraph.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80) | st.lists(st.sampled_from(["<|endoftext|>", "it's", "\xa0", "\x1c", " ", "́x", "İ", "Σ", "ab", "12", "\x85", "ß", "...", "É'", "Don't", "ẞ", "AB,", "1."])).map("".join))
def test_chunks_give_the_ids_of_the_whole_text(text):
    encoder = packing.ChunkEncoder(PATH)
    wanted = TOKENIZER.encode(text, add_special_tokens=False).ids
    assert [ids.tolist() for ids in encoder.encode([text, "ab " + text, text])][::2] == [wanted, wanted]


def check_bins(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for slots in bins.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_documents(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choices(["ab", "word", "Straße", "x'll"], k=rnd.randint(0, 60))), "p") for i in range(200)]
    rows += [(200, None, "p"), (201, "", "p"), (3, rows[3][1], "p"), (None, "null id", "p"), (202, "long " * 3000, "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string").repartition(4)
    found = packing.pack_documents(docs, PATH, capacity=64).collect()
    wanted = []
    for doc, text, _ in rows:
        ids = TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 64):
            part = ids[k : k + 64]
            wanted.append((doc, k // 64, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in found), key=str) == sorted(wanted, key=str)
    assert len({(r.sequence_id, r.offset) for r in found}) == len(found)
    total = sum(r.length for r in found)
    assert check_bins(found, 64) <= -(-total // 64) * 1.1 + 1


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30)))
def test_plan_places_each_piece_once(counts):
    plan = packing.Packing(40, counts)
    rows, ranks = [], defaultdict(list)
    for length, rank, count, first, offset in plan.placed:
        for k in range(count):
            ranks[length].append(rank + k)
            rows.append({"sequence_id": first + k, "offset": offset, "length": length})
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
    used = check_bins(rows, 40)
    assert used == plan.bins
    total = sum(n * c for n, c in counts.items())
    assert used <= 1.5 * max(-(-total // 40), sum(c for n, c in counts.items() if n > 20)) + 1


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


@pytest.mark.parametrize("length", [4096, 1])
def test_one_length_only(spark, length):
    pieces = spark.range(1000).selectExpr("id AS doc_id", "0 AS piece", f"{length}L AS length", "id AS ids_crc32")
    assert check_bins(packing.pack(pieces, 4096).collect(), 4096) == (1000 if length == 4096 else 1)


def test_words_met_before_are_not_encoded_again(monkeypatch):
    """Three blocks of 100,000 words each, then the same in other cases and with marks: the table holds all of them."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [f"{a}{b}{c}{d}" for a in letters for b in letters for c in letters for d in letters][:300_000]
    blocks = [" ".join(words[at : at + 100_000]) for at in (0, 100_000, 200_000)]
    encoder = packing.ChunkEncoder(PATH)
    first = [next(encoder.encode([b])) for b in blocks]
    encoder.encode_calls = 0

    class Counted:
        def __getattr__(self, name):
            encoder.encode_calls += name.startswith("encode")
            return getattr(TOKENIZER, name)

    monkeypatch.setattr(encoder, "tokenizer", Counted())
    monkeypatch.setattr(encoder, "of_words", Counted(), raising=False)
    for block, ids in zip(blocks, first):
        assert np.array_equal(next(encoder.encode([block.upper()])), ids)
    assert encoder.encode_calls == 0


def test_ids_stay_right_when_the_table_is_full(monkeypatch):
    monkeypatch.setattr(packing, "KEPT", 40)
    rnd = random.Random(5)
    encoder = packing.ChunkEncoder(PATH)
    for _ in range(60):
        texts = [" ".join(rnd.choices(["Straße", "x'll", "a,b", "12.", "...", "ÉTÉ", "Įx"], k=3) + ["".join(rnd.choices("abÀö", k=3)) + rnd.choice(["", ",", ")."]) for _ in range(9)]) for _ in range(3)]
        assert [ids.tolist() for ids in encoder.encode(texts)] == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(encoder.known) == len(encoder.sizes) == len(set(encoder.known.to_pylist()))
        assert len(encoder.flat) == encoder.sizes.sum()
