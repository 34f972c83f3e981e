import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings, strategies as st

from loomgraph.llm import suffixdedup as sd


def brute(rows):
    least = {}
    for doc, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - 49):
            if doc is not None:
                w = data[i : i + 50]
                least[w] = min(least.get(w, doc), doc)
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        cut = bytearray(len(data))
        for i in range(len(data) - 49):
            if doc is not None and least[data[i : i + 50]] < doc:
                cut[i : i + 50] = b"\1" * 50
        spans = sum(c and (i == 0 or not cut[i - 1]) for i, c in enumerate(cut))
        kept = bytes(b for b, c in zip(data, cut) if not c)
        out.append((doc, len(data), sum(cut), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdeé ", k=rnd.randint(1, 9)))
    passages = ["".join(word() for _ in range(rnd.randint(8, 60))) for _ in range(12)]
    rows = []
    for i in range(120):
        text = "".join(rnd.choice(passages)[rnd.randint(0, 20) :] if rnd.random() < 0.3 else word() for _ in range(rnd.randint(0, 40)))
        rows.append((rnd.randint(0, 10**6), text))
    rows += [(5, rows[3][1]), (6, rows[3][1]), (2 * 10**6, rows[3][1]), (7, None), (8, ""), (9, "a" * 500), (10, "a" * 49), (3 * 10**6, "ba" * 300 + "a" * 60), (11, "x" * 49 + "é" + "x" * 49)]
    rows += [(None, rows[3][1]), (rows[4][0], rows[4][1]), (12, rows[9][1]), (12, rows[9][1] + rows[9][1])]
    return rows


@pytest.mark.parametrize(("seed", "part", "hot"), [(1, 1 << 19, 20000), (2, 64, 3)])
def test_matches_brute_force(spark, monkeypatch, seed, part, hot):
    monkeypatch.setattr(sd, "SLICE", part)
    monkeypatch.setattr(sd, "HOT", hot)
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, rid string, block int").repartition(5)
    found = sorted((tuple(r) for r in sd.remove_repeats(docs).collect()), key=str)
    assert found == brute(rows)


def test_large_ids_beside_null_ids(spark):
    """Ids beyond 2**53 that differ in their last digit only, in one table with null ids."""
    passage = "".join(random.Random(4).choices("abcdefg ", k=89))
    rows = [(2**53 + k, f"{k} before {passage} after {k}") for k in (3, 4, 1, 0)] + [(None, f"x{passage}y{k}") for k in range(40)] + [(2**62 + 1, passage), (2**62, passage), (-(2**62), "n" * 60), (-(2**62) + 1, "n" * 70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted((tuple(r) for r in sd.remove_repeats(docs).collect()), key=str)
    assert found == brute(rows) and sum(n for _, _, n, _, _ in found) >= 3 * 89


def test_many_short_copies(spark):
    rows = [(i, "the same few words in each and every one of these documents, no more") for i in range(20_000)]
    found = sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed > 0")
    assert found.count() == 19_999


def test_texts_and_columns(spark):
    passage = "0123456789" * 8
    docs = spark.createDataFrame([(1, "é" + passage, "s", 3), (2, "é" + passage + "tail", None, None)], "doc_id long, text string, source string, n long")
    rows = sorted(sd.remove_repeats(docs, carry=("source", "n"), with_text=True).collect())
    assert [(r.kept_text, r.source, r.n) for r in rows] == [("é" + passage, "s", 3), ("tail", None, None)]
    assert sd.remove_repeats(docs.limit(0)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=50, max_size=70), min_size=1, max_size=8), st.sampled_from([sd._BASE, 1, 0]))
def test_sort_even_when_hashes_collide(texts, base):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    starts = np.arange(len(data) - 49)
    order = sd.SuffixOrder(data, base)
    windows = [data[i : i + 50].tobytes() for i in starts]
    index, same = sd.equal_windows(order, starts, np.zeros(len(starts), np.int64))
    groups = np.cumsum(~same)
    by_class = {}
    for i, g in zip(index, groups):
        by_class.setdefault(windows[i], set()).add(g)
    if len(starts) > 1:
        assert sorted(index) == list(range(len(starts)))
        assert all(len(g) == 1 for g in by_class.values()) and len(by_class) == len(set(windows))
        assert [windows[i] for i in index] == sorted(windows)


def test_windows_that_share_only_a_gram_are_not_sorted(monkeypatch):
    """Rows are packed: one per part, bucket or block, not per k-gram or segment; and only windows whose hashes agree are sorted."""
    rnd = random.Random(8)
    letters = lambda n: "".join(rnd.choices("abcdefgh", k=n))
    gram, passage = letters(sd.GRAM + 12), letters(90)
    texts = [letters(60) + gram + letters(60) for _ in range(40)] + [letters(30) + passage + letters(30) for _ in range(2)]
    none = pa.table({"key": pa.array([], pa.int64()), "kind": pa.array([], pa.int32()), "grams": pa.array([], pa.binary()), "block": pa.array([], pa.int32())})
    blocks = [pa.table({"block": pa.array([b] * 21, pa.int32()), "rid": list(range(21)), "doc_id": [2 * k + b for k in range(21)], "text": texts[b::2]}) for b in (0, 1)]
    filed = [sd._file_grams(3)(block, none) for block in blocks]
    assert all(len(f) <= 3 for f in filed)
    filed = pa.concat_tables(filed)
    shared = pa.concat_tables([sd._shared_grams(sd.HOT)(filed.filter(pc.equal(filed["part"], part))) for part in range(3)])
    shared = shared.append_column("key", pa.nulls(len(shared), pa.int64())).select(none.column_names)
    cut = pa.concat_tables([sd._cut_segments(5)(block, shared.filter(pc.equal(shared["block"], b))) for b, block in enumerate(blocks)])
    assert len(cut) <= 10
    plain, sorted_windows = sd.equal_windows, []
    monkeypatch.setattr(sd, "equal_windows", lambda order, at, key: sorted_windows.append(len(at)) or plain(order, at, key))
    found = pa.concat_tables([sd._sort_bucket(cut.filter(pc.equal(cut["bucket"], bucket))) for bucket in range(5) if bucket in cut["bucket"].to_pylist()])
    assert 0 < sum(sorted_windows) <= 2 * (90 - sd.WINDOW + 1)  # those of segments alike are settled before
    assert set(sd._values(found["least"], np.int64).tolist()) == {40}
    assert found["block"].unique().to_pylist() == [1]


@pytest.mark.parametrize("seed", range(30))
def test_ranges_that_overlap_or_touch_are_one(seed):
    rnd = random.Random(seed)
    ranges = [(rnd.randrange(6), a, a + rnd.randrange(1, 9)) for a in (rnd.randrange(40) for _ in range(rnd.randrange(25)))]
    wanted = []
    for text in range(6):
        covered = {k for t, a, b in ranges if t == text for k in range(a, b)}
        wanted.append([(a, min(k for k in range(a, 60) if k not in covered)) for a in sorted(covered) if a - 1 not in covered])
    columns = [np.array(c, np.int64) for c in zip(*ranges)] or [np.zeros(0, np.int64)] * 3
    assert list(sd._united(*columns, 6)) == wanted
