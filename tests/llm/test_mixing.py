import random
import re

import duckdb
import pytest

from loomgraph.llm import mixing


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size long, target double").repartition(3)


def test_matches_sql(spark):
    rows = [(i, "w " * (i * i % 97), ["a", "b", None, "é", "empty"][i % 5] if i % 3 else "a", 1, 2.0) for i in range(600)]
    rows = [(d, "" if s == "empty" else t, s, x, y) for d, t, s, x, y in rows] + [(600, None, "a", 1, 1.0), (5, rows[5][1], rows[5][2], 1, 1.0)]
    docs = rows_of(spark, rows)
    found = mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken").collect()
    documents = docs.toPandas()  # noqa: F841 read by the SQL
    wanted = duckdb.sql(mixing.MIX_SQL).fetchall()
    assert sorted(map(tuple, found)) == sorted(wanted)


def test_targets_copies_and_reruns(spark):
    docs = rows_of(spark, [(i, "w " * (1 + i % 50), f"s{i % 7}", 1, 1.0) for i in range(2000)])
    rows = mixing.mix_sources(docs).collect()
    total = sum(r["size"] for r in rows)
    for s in {r.source for r in rows}:
        mine = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 25
        assert mine[0].target <= 2 * mine[0].source_size
        assert {r.copies for r in mine} <= {0, 1, 2}
    assert sum({r.source: r.target for r in rows}.values()) == pytest.approx(1.5 * total)
    assert sorted(mixing.mix_sources(docs.repartition(7)).collect()) == sorted(rows)


def test_odds_raise_the_chance(spark):
    docs = rows_of(spark, [(i, "w", "s", 1, 1.0) for i in range(4000)]).selectExpr("*", "if(doc_id % 2 = 0, 9.0, null) AS odds")
    rows = mixing.mix_sources(docs, odds_col="odds", budget=0.5).collect()
    even = sum(r.taken for r in rows if r.doc_id % 2 == 0)
    assert sum(r.taken for r in rows) == 2000 and even > 1400


def test_rows_of_one_id_come_out_alike_in_any_order(spark):
    rows = [(d, "w " * n + str(n), "s", 1, 1.0) for d in (1, 2, None) for n in (3, 40, 7, 90, 21, 64)] + [(3, "x y", "s", 1, 1.0)] * 3
    results = []
    for seed in range(5):
        random.Random(seed).shuffle(rows)
        found = mixing.mix_sources(rows_of(spark, rows), weights=(1,), budget=0.6).select("doc_id", "size", "source_size", "target", "taken").collect()
        results.append(sorted(map(tuple, found), key=str))
    assert all(r == results[0] for r in results) and 0 < sum(r[4] for r in results[0]) < results[0][0][2]


def test_longer_documents_have_higher_odds(spark):
    docs = rows_of(spark, [(i, "w " * (4 if i % 2 else 100), "s", 1, 1.0) for i in range(4000)])
    rows = mixing.mix_sources(docs, budget=0.5).collect()
    short, long = (sum(r.copies for r in rows if r["size"] == n) / 2000 for n in (4, 100))
    assert abs(sum(r.taken for r in rows) - rows[0].target) <= 50 and 0.1 < short < 0.3 and 0.45 < long < 0.6


def test_words_and_empty(spark):
    texts = ["a\tb\x0bc\n", "é ü", " ", "", None, "a b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.word_count(mixing.F.col("t")))
    assert [r[0] for r in df.collect()] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    assert mixing.mix_sources(rows_of(spark, [])).collect() == []
