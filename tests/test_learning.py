"""Hand-computed values of the operators on candidates, paths and upkeep."""

from pyspark.sql import functions as F

from loomgraph.operators import learning as L


def values(df, *exprs):
    return [tuple(r) for r in df.select(*exprs).collect()]


def test_remap_follows_chains_and_stops_in_cycles(spark):
    retired = [(i, i + 1) for i in range(1, 12)] + [(20, 21), (21, 22), (22, 20), (30, 20), (40, 12)]
    found = dict(map(tuple, L.remap(spark.createDataFrame(retired, "id int, target int")).collect()))
    assert {i: found[i] for i in (1, 5, 11, 40)} == {1: 12, 5: 12, 11: 12, 40: 12}
    assert all(found[i] == i for i in (20, 21, 22)) and set(found) == {i for i, _ in retired}
    assert L.remap(spark.createDataFrame([], "id int, target int")).collect() == []


def test_scores(spark):
    rows = spark.createDataFrame([(3.0, 3.0), (16.0, 3.0), (1.0, 4.0), (0.0, 1.0)], "years double, target double")
    assert [round(x, 6) for (x,) in values(rows, L.experience_score(F.col("years"), F.col("target")))] == [1.0, 0.82, 0.25, round(1 - 1 / 3, 6)]
    assert values(rows, L.degree_score(F.col("years"), F.col("target")))[2:] == [(0.25,), (0.0,)]
    mix = spark.createDataFrame([(0.25, 0.5), (0.0, 0.1), (0.04, 0.04), (0.0, 0.0)], "b double, e double")
    assert [tuple(m) for (m,) in values(mix, L.source_mix(F.col("b"), F.col("e")))] == [(0.5, 0.5, 0.8, "strengthening"), (0.0, 1.0, 0.55, "candidate"), (1.0, 0.0, 0.692, "active"), (0.0, 0.0, 0.55, "candidate")]


def test_month_spans(spark):
    rows = spark.createDataFrame([("2019.03-2019.03",), ("2019.03-至今",), ("2018/11 ~ 2019/01",), ("since 2019",), (None,)], "s string")
    assert values(rows, L.month_span(F.col("s"), F.lit("2020.01"))) == [(1,), (11,), (3,), (None,), (None,)]


def test_names(spark):
    pairs = spark.createDataFrame([("abcdef", "xbcdez"), ("abc", "abc"), ("", "a"), ("a", "b")], "a string, b string")
    assert values(pairs, L.common_substring(F.col("a"), F.col("b"))) == [(4,), (3,), (0,), (0,)]
    assert L.soft_matches(["vuejs", "go", "sqlserver2019"], ["vue", "sqlserver", "go", "java"]) == (3, 0, 1)
    assert L.soft_matches(["golang"], ["go"]) == (0, 1, 1)
    lists = spark.createDataFrame([(["Vue.js", "C"], ["vue"]), (None, ["x"])], "p array<string>, g array<string>")
    assert values(L.soft_prf(lists, "p", "g"), "tp", "fp", "fn") == [(1, 1, 1)]


def test_dormant_items_revive(spark):
    rows = spark.createDataFrame([("a", w, s) for w, s in enumerate([0.2, 0.1, 0.14, 0.3, 0.3])], "k string, w int, s double")
    assert [r.state for r in L.dormancy(rows, "k", "w", "s").orderBy("w").collect()] == ["active", "dormant", "dormant", "revived", "active"]


def test_staged_path_takes_first_distinct_points(spark):
    items = spark.createDataFrame([(1, "s", 0.5), (1, "t", 0.9)], "candidate int, skill string, gap double")
    points = spark.createDataFrame([("t", "p1", 0.5, 1), ("t", "p2", 0.9, 1), ("s", "p1", 0.9, 1), ("s", "p3", 0.1, 1), ("s", "p4", 0.2, 2), ("t", "own", 1.0, 1)], "skill string, point string, score double, stage int")
    owned = spark.createDataFrame([(1, "own")], "candidate int, point string")
    found = sorted(map(tuple, L.staged_path(items, points, owned, a_stage=3).collect()))
    assert found == [(1, 1, 1, "p2"), (1, 1, 2, "p1"), (1, 1, 3, "p3"), (1, 2, 1, "p4")]


def test_band(spark):
    rows = spark.createDataFrame([(0.0,), (0.3,), (0.95,), (1.0,)], "u double")
    assert values(rows, L.band(F.col("u"), [F.lit(0.25), F.lit(0.25), F.lit(0.4)])) == [(0,), (1,), (2,), (2,)]


def test_near_names_are_those_of_all_pairs(spark):
    """Names filed under rare characters and runs of four find what comparing all pairs finds."""
    import random

    rnd = random.Random(3)
    names = sorted({"".join(rnd.choice("abcdefgh é") for _ in range(rnd.randint(1, 9))) for _ in range(60)} | {"", "spark sql", "spark", "sql spark"})
    lcs = lambda a, b: max((n for i in range(len(a)) for n in range(1, len(a) - i + 1) if a[i : i + n] in b), default=0)
    wanted = set()
    for a in names:
        scored = []
        for b in names:
            share = len(set(a) & set(b)) / max(len(set(a)), len(set(b)), 1)
            if a != b and a and b and (share >= 0.5 or lcs(a, b) >= 4):
                scored.append((-round(max(share, lcs(a, b) / 8), 3), b))
        wanted |= {(a, b, -s, r + 1) for r, (s, b) in enumerate(sorted(scored)[:3])}
    frame = spark.createDataFrame([(n,) for n in [*names, names[3], None] if n != ""], "name string")
    assert {(r.name, r.near, r.score, r["rank"]) for r in L.near_names(frame, 3).collect()} == wanted
