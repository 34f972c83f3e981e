import pytest
from pyspark.sql import functions as F

from loomgraph.sources import articles, postings


def test_csv_with_mark_quotes_and_missing_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿jobid,job,job_information,opentime,extra\n1,"dev ""x""","line one\nline, two",2024-05-02,z\n2,ops,,,\n', encoding="utf-8")
    rows = postings.read_csv(spark, f"file://{tmp_path}/a.csv").orderBy("jobid").collect()
    assert (rows[0].job, rows[0].job_information, rows[0].salary, rows[1].job_information) == ('dev "x"', "line one\nline, two", "", "")
    months = postings.union_months([postings.read_csv(spark, f"file://{tmp_path}/a.csv"), spark.createDataFrame([("3", "2024-06-01")], "jobid string, opentime string")])
    assert {r.jobid: r.month for r in months.collect()} == {"1": "2024-05", "2": "unknown", "3": "2024-06"}
    postings.write_months(months, f"file://{tmp_path}/months")
    postings.write_months(months.where("jobid = '3'"), f"file://{tmp_path}/months")
    assert spark.read.parquet(f"file://{tmp_path}/months").count() == 3


def test_json_lines_and_log(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": "a", "n": 1}\n\n{"k": "b", "n": 2}\nbroken\n{"k": "a", "n": 3}\n')
    rows = postings.read_json_lines(spark, f"file://{tmp_path}/a.jsonl", "k string, n int")
    assert sorted(map(tuple, postings.last_wins(rows, "k", "n").collect())) == [("a", 3), ("b", 2)]


def test_slices(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b", 0.5)], "src string, dst string, weight double")
    path = f"file://{tmp_path}/graph"
    for window in ("2024-05", "2024-Q1", "2023-12"):
        postings.write_slice(edges, path, window, "base")
    with pytest.raises(ValueError):
        postings.write_slice(edges, path, "2024-05", "base")
    postings.write_slice(edges.union(edges), path, "2024-05", "base", force=True)
    assert [r.window for r in postings.list_slices(spark, path).collect()] == ["2023-12", "2024-Q1", "2024-05"]
    assert postings.read_slices(spark, path).count() == 4
    assert '"total":1' in postings.envelope(edges, "2024-05", "job_task").first().json


def test_summary(spark):
    vectors = spark.createDataFrame([("k1", True, ["A", "Z"], {"A": "P2", "B": "P1"}), ("k2", True, [], {}), ("k3", False, [], {})], "jd_key string, it_related boolean, skills array<string>, levels map<string,string>")
    rows = postings.summary_rows(vectors, spark.createDataFrame([("A", "Java")], "code string, name string"), spark.createDataFrame([("k2",)], "jd_key string")).collect()
    assert [tuple(r) for r in rows] == [("k1", "Java|Z", "A:P2;B:P1")]


def test_news_and_papers(spark, tmp_path):
    (tmp_path / "n/site").mkdir(parents=True)
    (tmp_path / "n/site/a.txt").write_text("Title: Hello\nPublished: on 2024-03-01\nSource: Daily\n---\n" + "body " * 60)
    (tmp_path / "n/site/b.txt").write_text("Crawled: 2024-04-02\n\nFirst line\n" + "text " * 60)
    (tmp_path / "n/site/c.txt").write_text("Title: short\n\nx")
    rows = {r.source_file: r for r in articles.parse_news(articles.read_whole(spark, f"file://{tmp_path}/n")).collect()}
    assert (rows["a.txt"].title, rows["a.txt"].source, rows["a.txt"].pub_date) == ("Hello", "Daily", "2024-03-01")
    assert (rows["b.txt"].title, rows["b.txt"].source, rows["b.txt"].pub_date) == ("First line", "site", "2024-04-02") and "c.txt" not in rows
    for folder in ("S", "B"):
        (tmp_path / "p" / folder).mkdir(parents=True)
        (tmp_path / "p" / folder / "2403.01234.txt").write_text("[title] Paper\n\nAbstract: We show things.\n\nKeywords: a, b; c\n\n1. Introduction\nmore")
    papers = articles.parse_papers(articles.read_whole(spark, f"file://{tmp_path}/p")).collect()
    assert len(papers) == 1 and (papers[0].title, papers[0].tier, str(papers[0].pub_date), papers[0].abstract, papers[0].keywords) == ("Paper", "B", "2024-03-01", "We show things.", ["a", "b", "c"])


def test_metadata_first(spark):
    names = lambda k: spark.createDataFrame([(f"f{i}",) for i in k], "source_file string")
    assert articles.selected_files(names(range(10)), names(range(2, 10))).count() == 8
    assert articles.selected_files(names(range(3)), names(range(10))).count() == 10
    assert postings.timeline_mapping(names(range(2)).withColumn("d", F.when(F.col("source_file") == "f1", "2024").otherwise("")), F.col("d")).first().source_file == "f1"
