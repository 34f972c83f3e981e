import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import ann


def brute(ids, rows, queries, k):
    out = {}
    for q in queries:
        d = np.sqrt(((rows - rows[list(ids).index(q)]) ** 2).sum(1))
        out[q] = [(float(x), int(i)) for x, i in sorted(zip(d, ids)) if i != q][:k]
    return out


def test_traverse_is_in_order():
    rng = np.random.default_rng(1)
    first, second = rng.random(7), rng.random(5)
    held = rng.integers(0, 4, (7, 5))
    cells = list(ann.traverse(first, second, held, 10**6))
    sums = [first[i] + second[j] for i, j in cells]
    assert sums == sorted(sums) and set(cells) == {tuple(c) for c in np.argwhere(held)}
    some = list(ann.traverse(first, second, held, 12))
    assert some == cells[: len(some)] and sum(held[c] for c in some) >= 12


def test_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(3000, 16)).astype(np.float32)
    rows[100:140] = rows[100]
    docs = spark.createDataFrame([(i, [float(x) for x in r], "x") for i, r in enumerate(rows)], "vec_id long, embedding array<float>, score string").repartition(4)
    found = ann.search(docs, F.col("vec_id") % 50 == 0).collect()
    truth = brute(range(3000), rows.astype(float), range(0, 3000, 50), 10)
    mine = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        mine.setdefault(r.query_id, []).append((r.score, r.vec_id))
        exact = np.sqrt(((rows[r.query_id].astype(float) - rows[r.vec_id].astype(float)) ** 2).sum())
        assert abs(r.score - exact) < 1e-12
    assert mine[100] == truth[100] and [i for _, i in mine[100]] == list(range(101, 111))
    assert all(len(v) == 10 and v == sorted(v) for v in mine.values())
    recall = np.mean([len({i for _, i in mine[q]} & {i for _, i in t}) / 10 for q, t in truth.items()])
    assert recall >= 0.9


def test_small_blocks_and_split_cells(spark, monkeypatch):
    """Cells larger than a block and blocks with more queries than one group takes."""
    monkeypatch.setattr(ann, "ROWS_PER_BLOCK", 40)
    monkeypatch.setattr(ann, "QUERIES_PER_BLOCK", 7)
    monkeypatch.setattr(ann, "RECALL", 1.0)
    rng = np.random.default_rng(5)
    rows = np.concatenate([rng.normal(size=(300, 6)) * 0.01 + 3, rng.normal(size=(500, 6))])
    docs = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "vec_id long, embedding array<double>").repartition(3)
    found = ann.search(docs, F.col("vec_id") % 10 == 0, k=5).collect()
    mine = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        mine.setdefault(r.query_id, []).append(r.vec_id)
    truth = brute(range(800), rows, range(0, 800, 10), 5)
    assert all(len(v) == 5 for v in mine.values()) and len(mine) == 80
    assert np.mean([len({*mine[q]} & {i for _, i in t}) / 5 for q, t in truth.items()]) >= 0.95


@pytest.mark.parametrize("size", [10_000, 100_000])
def test_recall_over_whole_tables(spark, size):
    """Recall of the queries against brute force over every row, on vectors in clusters."""
    rng = np.random.default_rng(size)
    centres = rng.normal(size=(size // 250, 16))
    rows = centres[rng.integers(0, len(centres), size)] + 0.4 * rng.normal(size=(size, 16))
    table = pa.table({"vec_id": np.arange(size), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(rows.reshape(-1)), 16).cast(pa.list_(pa.float64()))})
    docs = spark.createDataFrame(table).repartition(4)
    queries = range(0, size, size // 200)
    found = ann.search(docs, F.col("vec_id") % (size // 200) == 0).collect()
    mine = {}
    for r in found:
        mine.setdefault(r.query_id, set()).add(r.vec_id)
    distance = ann._squared(rows[list(queries)], rows)
    distance[np.arange(len(queries)), list(queries)] = np.inf
    truth = np.argpartition(distance, 10, axis=1)[:, :10]
    recall = np.mean([len(mine[q] & {*t}) / 10 for q, t in zip(queries, truth.tolist())])
    assert recall >= 0.9 and all(len(v) == 10 for v in mine.values())


def test_edge_cases(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(0, [1.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [1.0, 2.0]), (6, [1.0]), (None, [1.0, 1.0]), (7, [3.0, 2.0]), (0, [1.0, 2.0]), (8, [float("inf"), 1.0])]
    found = ann.search(spark.createDataFrame(rows, schema), F.lit(True)).collect()
    assert sorted(map(tuple, found)) == [(0, 1, 5, 0.0), (0, 2, 7, 2.0), (5, 1, 0, 0.0), (5, 2, 7, 2.0), (7, 1, 0, 2.0), (7, 2, 5, 2.0)]
    assert ann.search(spark.createDataFrame([], schema), F.lit(True)).collect() == []
    assert ann.search(spark.createDataFrame(rows[:1], schema), F.lit(True)).collect() == []


@pytest.mark.parametrize("sample", [1000, 16_384])
def test_recall_on_nearly_uniform_vectors(spark, monkeypatch, sample):
    """64 dimensions without clusters, as the given tables have them; codebooks see a sixth of the rows or all but the trials."""
    monkeypatch.setattr(ann, "SAMPLE", sample)
    rng = np.random.default_rng(8)
    rows = rng.normal(size=(6000, 64))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    docs = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<double>").repartition(4)
    mine = {}
    for r in ann.search(docs, F.col("vec_id") % 100 == 0).collect():
        mine.setdefault(r.query_id, set()).add(r.vec_id)
    truth = brute(range(6000), rows, range(0, 6000, 100), 10)
    assert np.mean([len(mine[q] & {i for _, i in t}) / 10 for q, t in truth.items()]) >= 0.9
