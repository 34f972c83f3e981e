import math
import random
import re
from collections import Counter

import pytest

from loomgraph.llm import lexical

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return PATTERN.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    sized = [(d, words(t)) for d, t in docs if words(t)]
    total, length = len(sized), sum(len(w) for _, w in sized)
    df = Counter(t for _, w in sized for t in set(w))
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(words(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for d, w in sized:
            tf, m = Counter(w), 50 + (50 * len(w) * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in terms if tf[t])
            if score > 0:
                scores.append((-score, d is None, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def case(seed=2, n=700):
    rnd = random.Random(seed)
    pool = [f"w{i}" for i in range(60)] + ["the"] * 40 + ["Éa", "éA", "x-y", "I'm", "naïve", "中文", "a_b", "\U0001f600"]
    docs = [(rnd.randint(-50, 900), " ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 40)))) for _ in range(n)]
    docs += [(1000 + i, "equal Texts here") for i in range(70)] + [(None, "equal texts here"), (5, None), (6, ""), (7, "--- !!"), (8, "the " * 30_000), (2**62, "w1"), (2**62, "w1")]
    rnd.shuffle(docs)
    items = [(1, "the w1 w2 W1"), (2, "equal texts"), (3, None), (3, "naïve"), (3, "中文 w9"), (4, "absent"), (5, ""), (None, "éa x"), (6, " ".join(f"w{i}" for i in range(60)))]
    return docs, items


def frames(spark, docs, items, parts=5):
    return spark.createDataFrame([(*d, 1, "t") for d in docs], "doc_id long, text string, n long, terms string").repartition(parts), spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, score long")


@pytest.mark.parametrize("k,window,block", [(50, 4096, 1 << 24), (3, 64, 1 << 24), (10, 128, 40)])
def test_matches_brute_force(spark, monkeypatch, k, window, block):
    docs, items = case()
    found = lexical.search_items(*frames(spark, docs, items), k=k, block_bytes=block)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(docs, items, k)


@pytest.mark.parametrize("sizes", [[0, 3, 64, 65, 200], [10], [4096, 1], [5000, 5000]])
def test_windows_hold_all_rows_in_order(sizes):
    import pyarrow as pa

    batches, at = [], 0
    for n in sizes:
        batches.append(pa.RecordBatch.from_arrays([pa.array(range(at, at + n))], ["x"]))
        at += n
    got = list(lexical.windows(iter(batches)))
    assert [x for b in got for x in b.column(0).to_pylist()] == list(range(at))
    assert all(b.num_rows == lexical.WINDOW for b in got[:-1])


def test_ties_go_by_id_in_a_full_heap():
    import numpy as np

    best = lexical.Best(3)
    best.harvest(np.array([5, 5, 5, 5]), np.array([9, 8, 7, 6]), np.array([True] * 4))
    best.harvest(np.array([5, 4, 0]), np.array([1, 2, 3]), np.array([True] * 3))
    best.harvest(np.array([5]), np.array([0]), np.array([False]))
    assert sorted(-x[2] for x in best.heap) == [1, 6, 7]


def test_empty_tables(spark):
    docs, items = frames(spark, [(1, "a")], [(1, "a")])
    assert lexical.search_items(docs.limit(0), items).collect() == []
    assert lexical.search_items(docs, items.limit(0)).collect() == []
    assert [tuple(r) for r in lexical.search_items(docs, items).collect()] == brute([(1, "a")], [(1, "a")], 50)


def test_terms_are_the_pattern():
    text = "".join(map(chr, range(0x250))) + " Straße_x9"
    assert [t.decode() for t in lexical.terms(text.encode())] == words(text)
