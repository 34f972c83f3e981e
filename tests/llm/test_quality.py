import random
from collections import Counter

import duckdb
import numpy as np
from hypothesis import given, settings, strategies as st

from loomgraph.llm import quality as q


def brute_repeats(words, size):
    """For each start the longest repeat by trying all pairs."""
    n = len(words)
    out = []
    for i in range(n):
        best = 0
        for j in range(n):
            if i != j:
                k = 0
                while i + k < n and j + k < n and words[i + k] == words[j + k]:
                    k += 1
                best = max(best, k)
        out.append(best)
    covered = {i + k for i, m in enumerate(out) if m >= size for k in range(m)}
    grams = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    windows = {i + k for i in range(n - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(windows), len(covered), max(out, default=0)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=30), min_size=1, max_size=6))
def test_repetition(texts):
    assert q.repetition(texts, 4) == [brute_repeats(w, 4) for w in texts]


def test_suffix_order():
    tokens = np.array([3, 1, 2, 1, 2, 1, -1])
    order, _ = q.suffix_ranks(tokens)
    assert order.tolist() == sorted(range(7), key=lambda i: tokens[i:].tolist())


def test_matches_sql(spark):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(500)] + ["##", "<a>", "é$"]
    texts = [None, "", " \n\n", "a", "\x1c\xa0 b", "one two\n" * 100]
    for i in range(60):
        words = rnd.choices(vocabulary, k=rnd.randint(1, 400))
        if i % 4 == 0:
            at = rnd.randrange(len(words))
            words += words[at : at + rnd.choice([3, 7, 8, 40, 127, 128, 200])] + ["end"]
        texts.append("".join(w + rnd.choice([" ", "\n", "\t", " \x0b"]) for w in words))
    texts.append(" ".join(rnd.choices(vocabulary, k=30000)))
    rows = [(i, t, True, 1.0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept boolean, m double").repartition(3)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    found = q.quality(docs).select(*columns).collect()
    documents = docs.toPandas()  # noqa: F841 read by the SQL
    assert sorted(map(tuple, found)) == sorted(duckdb.sql(q.QUALITY_SQL).fetchall())
    assert any(r.kept for r in found) and any(not r.kept and not r.base_failed for r in found)
    assert q.quality(docs.limit(0)).collect() == []
