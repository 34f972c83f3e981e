import hashlib
import random

import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings, strategies as st

from loomgraph.llm import bytebpe

FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bytebpe.read_ranks(FILE)


@pytest.fixture(scope="module")
def coder(ranks):
    return bytebpe.ByteCoder(ranks, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def oracle(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def toy_ranks(rnd, merges):
    """A vocabulary of random merges over a few letters, so that longest matches are often wrong."""
    found = {bytes([b]): b for b in range(256)}
    pool = [b"a", b"b", b"c"]
    while len(found) < 256 + merges:
        new = rnd.choice(pool) + rnd.choice(pool)
        if new not in found:
            found[new] = len(found)
            pool.append(new)
    return found


def trained_ranks(rnd, merges):
    """A vocabulary of pairs that stand together in merged text, as training makes it."""
    found = {bytes([b]): b for b in range(256)}
    while len(found) < 256 + merges:
        parts = bytebpe.merge(found, bytes(rnd.choice(b"aaabbc") for _ in range(40)))
        at = rnd.randrange(max(1, len(parts) - 1))
        found.setdefault(b"".join(parts[at : at + 2]), len(found))
    return found


@pytest.mark.parametrize("name", [r"\p{L}", r"\p{N}", r"\s", r"[^\s\p{L}\p{N}]"])
def test_character_classes_are_the_same(name):
    told = tiktoken.Encoding("class", pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    wanted = told.decode(told.encode_ordinary(text))
    assert wanted == "".join(regex.findall(bytebpe.same_classes(name), text, regex.V1))
    assert [c for c in wanted if c < "\u0100"] == regex.findall(name, text[:256])


def test_every_code_point(coder, oracle):
    for start in range(0, 0x110000, 997):
        text = "".join(f"a{chr(c)}" for c in range(start, min(start + 997, 0x110000)) if not 0xD800 <= c < 0xE000)
        assert list(coder.encode(text)) == oracle.encode_ordinary(text), hex(start)


def test_words_spaces_and_runs(coder, oracle):
    rnd = random.Random(3)
    alphabet = ["a", "e", " ", " ", "\n", "\t", "'s", "'LL", "ß", "é", "中", "文", "\U0001f600", "1", "23", "-", "===", " ", " ", "the", " Straße", "\x00", "\x1c"]
    for _ in range(400):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60)))
        assert list(coder.encode(text)) == oracle.encode_ordinary(text)
        assert coder.decode(coder.encode(text)) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(coder, oracle, text):
    assert list(coder.encode(text)) == oracle.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40))
def test_any_bytes_of_one_piece(coder, oracle, data):
    assert list(coder.cut(data)) == ([] if not data else oracle._encode_single_piece(data))


@pytest.mark.parametrize("make", [toy_ranks, trained_ranks])
@pytest.mark.parametrize("seed", range(25))
def test_vocabularies_that_need_backtracking(seed, make):
    rnd = random.Random(seed)
    ranks = make(rnd, rnd.randint(3, 60))
    coder = bytebpe.ByteCoder(ranks, r"[\s\S]+", r"[\s\S]+")
    assert coder.trained or make is toy_ranks
    told = tiktoken.Encoding("toy", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    for _ in range(60):
        text = "".join(rnd.choice("aaabbc") for _ in range(rnd.randint(1, 50)))
        assert list(coder.encode(text)) == told.encode_ordinary(text)


def test_borders_are_what_merging_gives(coder):
    rnd = random.Random(1)
    assert coder.trained
    tokens = list(coder.tokens)
    for _ in range(3000):
        left, right = rnd.choice(tokens), rnd.choice(tokens)
        both = [coder.tokens[left], coder.tokens[right]]
        assert coder.border(left, right) == (bytebpe.merge(coder.ranks, b"".join(both)) == both)


def test_long_pieces_are_linear(coder, oracle):
    text = "ab" * 60_000 + "a" * 50_001 + "x-" * 40_000
    assert list(coder.encode(text)) == oracle.encode_ordinary(text)


def test_single_bytes_are_needed():
    with pytest.raises(ValueError):
        bytebpe.ByteCoder({b"a": 0}, ".")


def test_documents(spark, ranks, oracle):
    rows = [(1, "A test, it's 12 o'clock."), (1, "A test, it's 12 o'clock."), (None, "same"), (2, None), (3, ""), (4, "wörter " * 30_000), (5, "é" * 9000), (6, " \n\n ")]
    docs = spark.createDataFrame([(*r, r[0], b"x") for r in rows], "doc_id long, text string, ids long, decoded binary")
    coded = bytebpe.encode_documents(docs, ranks, public_tokenizers.PATTERN)
    found = sorted((tuple(r) for r in bytebpe.token_digests(coded).collect()), key=repr)
    wanted = []
    for doc, text in rows:
        ids = oracle.encode_ordinary(text or "")
        wanted.append((doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert found == sorted(wanted, key=repr)
    coder = bytebpe.SharedCoder(spark, ranks, public_tokenizers.PATTERN)
    again = docs.select(bytebpe.decoded(coder, bytebpe.encoded(coder, docs.text)).alias("b"), "text").collect()
    assert all(bytes(r.b) == (r.text or "").encode() for r in again)
    assert [r.ids for r in coded.where("doc_id = 3").collect()] == [[]]
    assert bytebpe.encode_documents(docs.limit(0), ranks, public_tokenizers.PATTERN).collect() == []


def test_query_on_its_table(spark, oracle):
    from loomgraph.llm.queries import op12_byte_bpe

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = op12_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = oracle.encode_ordinary(docs[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()
