"""Job vectors, rings and cells by hand."""

import math
import random

from loomgraph.operators import space


def test_inferred_edges_open_no_dimension(spark):
    jobs = spark.createDataFrame([("a",), ("b",), ("c",), ("n",), ("n",)], "job string")
    measured = spark.createDataFrame([("a", "t1", 3.0), ("a", "t2", 2.0), ("a", "t2", 2.0), ("b", "t1", 1.0), ("b", "t3", 0.0), ("x", "t9", 1.0), ("c", None, 5.0), ("b", "t4", None)], "job string, task string, weight double")
    inferred = spark.createDataFrame([("n", "t1", 1.0), ("n", "t3", 4.0), ("n", "t8", 4.0)], "job string, task string, weight double")
    found = {(r.job, r.task): (round(r.value, 9), r.inferred) for r in space.unit_vectors(jobs, measured, inferred).collect()}
    assert found == {("a", "t1"): (0.6, False), ("a", "t2"): (0.8, False), ("b", "t1"): (1.0, False), ("n", "t1"): (1.0, True)}
    near = [tuple(r) for r in space.neighbours(space.unit_vectors(jobs, measured, inferred), 2).orderBy("job", "rank").collect()]
    assert near == [("a", 1, "b", 0.4, 1), ("a", 2, "n", 0.4, 1), ("b", 1, "n", 0.0, 1), ("b", 2, "a", 0.4, 1), ("n", 1, "b", 0.0, 1), ("n", 2, "a", 0.4, 1)]
    assert space.neighbours(space.unit_vectors(jobs.limit(0), measured), 2).collect() == []


def test_rings(spark):
    rows = spark.createDataFrame([("x", float(i)) for i in range(1, 21)] + [("y", 7.0)] * 3 + [("y", None), (None, 1.0)], "cluster string, distance double")
    found = {r.cluster: tuple(r)[1:] for r in space.rings(rows).collect()}
    assert found == {"x": (20, 5.0, 10.0, 15.0, 19.0), "y": (3, 7.0, 7.0, 7.0, 7.0), None: (1, 1.0, 1.0, 1.0, 1.0)}


def test_cells(spark):
    posts = spark.createDataFrame(
        [("a", "column", "BA", 0.5), ("a", "column", "MA", 0.03), ("a", "column", "PhD", 0.47), ("a", "band", "1", 0.2), ("a", "band", "2", 0.2), ("a", "band", "3", 0.6), ("b", "column", "BA", 1.0), ("b", "band", "3", 1.0), ("c", "column", "BA", 1.0), ("c", "band", "3", 1.0), ("a", "column", None, 0.5), ("a", "band", "4", None)],
        "job string, kind string, value string, share double",
    )
    jobs = spark.createDataFrame([("a", 100), ("b", 30), ("c", 0)], "job string, posts long")
    found = sorted((r["column"], r.band, r["rank"], r.job, r.posts) for r in space.post_cells(posts, jobs).collect())
    assert found == [("BA", "1", 1, "a", 10.0), ("BA", "3", 1, "a", 30.0), ("BA", "3", 2, "b", 30.0), ("PhD", "1", 1, "a", 9.4), ("PhD", "3", 1, "a", 28.2)]
    assert len(space.post_cells(posts, jobs, per_cell=1).collect()) == 4 and math.isclose(sum(x[4] for x in found), 107.6)


def test_cluster_model(spark):
    rows = [("a", "x", 3, [0.0, 1.0]), ("b", "x", 1, [1.0, None]), ("c", "y", 4, [2.0, -1.0]), ("d", None, 9, [1.0, 1.0]), ("e", "x", 0, [5.0, 5.0]), ("f", "x", 2, None)]
    jobs = spark.createDataFrame(rows, "job string, cluster string, posts long, vector array<double>")
    found = {(r.cluster, r.dim): (r.place, r.posts, r.centre, r.spread) for r in space.cluster_model(jobs, 1.0, 3).collect()}
    assert found == {("x", 0): (1, 4, 0.25, [3, 0, 1]), ("x", 1): (1, 4, 1.0, [0, 0, 3]), ("y", 0): (2, 4, 2.0, [0, 0, 4]), ("y", 1): (2, 4, -1.0, [4, 0, 0])}
    assert space.cluster_model(jobs.limit(0), 1.0).collect() == []


def test_scoped_stacks(spark):
    rows = [("s", "a", "web", 5), ("s", "a", "web", 1), ("s", "b", "web", None), ("s", "c", "db", 9), ("s", "d", "db", 9), ("s", "e", None, 3), ("t", "a", "ai", 1)]
    found = sorted(tuple(r) for r in space.scoped_stacks(spark.createDataFrame(rows, "scope string, job string, stack string, posts long"), ["scope"]).collect())
    assert found == [("s", "db", 2, 18, 1), ("s", "web", 2, 6, 2), ("t", "ai", 1, 1, 1)]


def test_neighbours_are_those_of_all_pairs_without_a_join(spark):
    """Blocks of few jobs, copies that tie by name, jobs that share nothing: as brute force has it, and no pair is a row of a join."""
    rnd = random.Random(2)
    jobs = {f"j{i:02}": {f"t{rnd.randrange(9)}": rnd.choice((1.0, 2.0, -1.0)) for _ in range(rnd.randint(1, 5))} for i in range(23)}
    jobs |= {"copy1": jobs["j03"], "copy2": jobs["j03"], "alone": {"x": 1.0}}
    unit = {j: {t: w / sum(x * x for x in v.values()) ** 0.5 for t, w in v.items()} for j, v in jobs.items()}
    rows = spark.createDataFrame([(j, t, w) for j, v in unit.items() for t, w in v.items()], "job string, task string, value double")
    wanted = set()
    for j, v in unit.items():
        near = sorted((round(max(0.0, 1 - sum(w * u[t] for t, w in v.items() if t in u)), 9), o, len(v.keys() & u.keys())) for o, u in unit.items() if o != j and v.keys() & u.keys())
        wanted |= {(j, r, o, d, n) for r, (d, o, n) in enumerate(near[:3], 1)}
    for blocks in ((4096, 16384), (7, 5)):
        found = space.neighbours(rows, 3, 9, *blocks)
        assert {(r.job, r["rank"], r.other, r.distance, r.shared) for r in found.collect()} == wanted
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert space.neighbours(rows.limit(0), 3).collect() == []
