"""Large tables are not dealt by the few keys of a taxonomy, nor shuffled again by a key they are already dealt by."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import audit, learning, mentions, mining
from loomgraph.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def unaided(spark):
    """No join is broadcast unless the code says so, and plans are as they run from the start."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def exchanged(df):
    """Column names of each exchange by hash."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", keys).split(", ") for keys in re.findall(r"hashpartitioning\(([^()]*), \d+\)", plan)]


def test_vectors_of_candidates_are_not_dealt_by_point(unaided):
    owned = unaided.createDataFrame([(1, "a", 0.5), (1, "b", 1.0), (2, "a", 1.0)], "candidate long, point string, proficiency double")
    edges = unaided.createDataFrame([("s", "a", 0.5), ("s", "b", 0.25), ("t", "b", 0.01)], "src string, dst string, weight double")
    found = learning.skill_vector(owned, edges)
    assert ["point"] not in exchanged(found)
    assert {(r.candidate, r.skill): round(r.value, 6) for r in found.collect()} == {(1, "s"): round((0.25 + 0.25) / 0.75, 6), (1, "t"): 1.0, (2, "s"): 1.0}


def test_vector_groups_in_place(unaided):
    assert not [k for k in exchanged(catalog.queries()["resume_vector"](unaided, DATA)) if "candidate" in k and len(k) > 1]


def test_first_points_are_not_dealt_by_name(unaided):
    docs = unaided.createDataFrame([(1, "red bolt, red gear"), (2, "old bolt")], "id long, text string")
    points = unaided.createDataFrame([("s", "bolt"), ("t", "bolt"), ("s", "red")], "skill string, name string")
    found = mentions.first_points(docs, "id", "text", points)
    assert not [k for k in exchanged(found) if k == ["name"] or k == ["doc", "skill"]]
    assert sorted(map(tuple, found.collect())) == [(1, "s", 0, 2), (1, "t", 4, 1), (2, "s", 4, 1), (2, "t", 4, 1)]


def test_signals_are_not_dealt_by_name(unaided):
    rows = unaided.createDataFrame([(1, "技能：a、b；任务：c")], "id long, text string")
    names = unaided.createDataFrame([("技能", "b"), ("任务", "c")], "kind string, name string")
    found = mentions.signals(rows, "id", "text", names)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    assert sorted(map(tuple, found.collect())) == sorted([(1, "技能", "b", 1), (1, "任务", "c", 1000)])


def test_claims_are_not_dealt_by_job(unaided):
    claims = unaided.createDataFrame([(1, 7, "j", "s", 0.5), (1, 8, "j", "t", 0.5)], "doc long, experience long, job string, skill string, owned double")
    required = unaided.createDataFrame([("j", "s", 1.0)], "job string, skill string, required double")
    found = audit.link_experiences(claims, required)
    # the requirement and its total are dealt by job, as small as they are; claims never by job and skill
    assert ["job", "skill"] not in exchanged(found)
    assert sorted((r.experience, r.coverage) for r in found.collect()) == [(7, 0.5), (8, 0.0)]


def test_gaps_and_plans_stay_with_their_candidate(unaided):
    assert not [k for k in exchanged(catalog.queries()["path_plan"](unaided, DATA)) if "candidate" in k and len(k) > 1]
    assert ["job"] not in [k for k in exchanged(catalog.queries()["five_dim_fit"](unaided, DATA)) if len(k) > 1] and not [k for k in exchanged(catalog.queries()["gap_typing"](unaided, DATA)) if k == ["candidate", "skill"]]


def test_ngrams_make_their_text_once(spark):
    """A cleaned text was cleaned again for each of its n-grams, so time grew with the square of a line's length."""
    import time

    from loomgraph.operators.audit import character_pairs

    rows = spark.createDataFrame([("Delivered 12 small gizmos; " * 1000,)] * 8, "text string").repartition(2)  # no constant, which is folded
    began = time.monotonic()
    found = rows.select(character_pairs(rows.text).alias("g")).first().g
    assert len(found) == 1000 * 23 - 1 and found[:2] == ["De", "el"]
    assert time.monotonic() - began < 30


def test_similar_sets_file_only_items_of_both_sides(unaided):
    from loomgraph.operators.setsim import similar_sets

    a = unaided.createDataFrame([("x", ["a", "b", "c", "d", "1"]), ("y", ["a", "1", "2", "3", "4"]), ("z", ["a", "b", "c", "d", "e"])], "set_id string, items array<string>")
    b = unaided.createDataFrame([("q", ["a", "b", "c", "d", "e"]), ("r", ["d", "e"])], "set_id string, items array<string>")
    found = similar_sets(a, b, 0.4)
    assert ["item"] not in exchanged(found)
    assert sorted((r.a, r.b, round(r.similarity, 6)) for r in found.collect()) == [("x", "q", 0.666667), ("z", "q", 1.0), ("z", "r", 0.4)]


def test_ngrams_are_counted_before_they_are_dealt(unaided):
    rows = unaided.createDataFrame([(1, "a b c a b"), (2, "a b c"), (3, "x b c")], "doc long, t string")
    found = mining.frequent_ngrams(rows, "doc", F.split("t", " "), 2, 3)
    assert not [k for k in exchanged(found) if k in (["a"], ["b"])]  # no row is dealt by a part of its gram
    assert {(r.gram, r["size"], r.df) for r in found.collect()} == {("a", 1, 2), ("b", 1, 3), ("c", 1, 3), ("a b", 2, 2), ("b c", 2, 3), ("a b c", 3, 2)}


def test_sentences_are_not_dealt_with_their_words(unaided):
    docs = unaided.createDataFrame([(1, ["Old bolt", "a BOLT, red"]), (1, ["red bolt"]), (2, ["red"]), (3, ["bolt", "red"]), (4, None)], "id long, s array<string>")
    found = mining.first_sentences(docs, "id", F.col("s").cast("array<string>"), unaided.createDataFrame([("bolt",), ("red",)], "term string"), 2)
    assert ["term"] not in exchanged(found)
    assert {(r.term, r.id): r.sentence for r in found.where("id > 1").collect()} == {("bolt", 3): "bolt", ("red", 2): "red"}
    assert {(r.term, r.id) for r in found.collect()} == {("bolt", 1), ("bolt", 3), ("red", 1), ("red", 2)}


def test_sparse_vectors_meet_in_blocks(unaided, monkeypatch):
    monkeypatch.setattr(mining, "QUERIES", 4)
    monkeypatch.setattr(mining, "ROWS", 7)
    rnd = random.Random(3)
    held = {d: {f"t{rnd.randint(0, 25)}": rnd.randint(1, 3) / 4 for _ in range(rnd.randint(1, 5))} for d in range(40)}
    frame = unaided.createDataFrame([(d, t, w) for d, v in held.items() for t, w in v.items()], "doc long, token string, weight double")
    found = mining.sparse_cosine_top_k(frame, "doc", frame.where("doc % 4 = 0"), 3)
    assert not [k for k in exchanged(found) if "token" in k or len(k) > 2 or k == ["query", "doc"]]  # no row for each pair
    expected = set()
    for q in range(0, 40, 4):
        scores = sorted((-sum(w * held[q][t] for t, w in v.items() if t in held[q]), d) for d, v in held.items() if d != q and held[q].keys() & v.keys())
        expected |= {(q, d, round(-s, 9), n) for n, (s, d) in enumerate(scores[:3], 1)}
    assert {(r.query, r.doc, round(r.score, 9), r["rank"]) for r in found.collect()} == expected


@pytest.mark.parametrize("name", ["segment_mentions", "direct_evidence", "uncovered_lines"])
def test_spans_of_a_text_stay_in_its_row(unaided, name):
    keys = exchanged(catalog.queries()[name](unaided, DATA))
    assert not [k for k in keys if {"cell", "size", "start"} & set(k)]


def test_facts_of_a_task_are_bounded(spark, monkeypatch):
    """Partitions merged by bytes held very many lines; dealt facts are the same rows, about as many in a part as asked for."""
    from loomgraph.plans import match_queries
    from loomgraph.plans.graph_queries import facts

    dealt_facts = facts(spark, DATA, 400)
    held = [r["count"] for r in dealt_facts.groupBy(F.spark_partition_id()).count().collect()]
    assert max(held) < 800 and dealt_facts.exceptAll(facts(spark, DATA)).isEmpty() and sum(held) == facts(spark, DATA).count()
    usual = sorted(map(tuple, match_queries.must_plus_def(spark, DATA).collect()))
    monkeypatch.setattr(match_queries, "LINES", 400)
    few = match_queries.must_plus_def(spark, DATA)
    assert sorted(map(tuple, few.collect())) == usual and usual
    assert "REPARTITION_BY_NUM" in few._jdf.queryExecution().executedPlan().toString()
