"""Strata, units, decisions, names and forecasts by hand."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import intake


def test_the_first_known_part_tells_the_stratum(spark):
    mapping = spark.createDataFrame([("Java", "dev"), ("Ｃ＋＋", "sys"), ("Ops..", "ops"), ("Java", "a"), (None, "x"), ("y", None)], "part string, stratum string")
    rows = [(1, "Art or Java or C++"), (2, " C++  or Java"), (3, "Art"), (4, None), (5, ""), (6, "Ops…"), (6, "Ops…"), (7, "Javaor C++")]
    found = sorted((r.id, r.stratum) for r in intake.strata(spark.createDataFrame([(*r, "s") for r in rows], "id int, types string, stratum0 string"), "types", mapping).collect())
    assert found == [(1, "a"), (2, "sys"), (3, None), (4, None), (5, None), (6, "ops"), (6, "ops"), (7, None)]
    assert intake.strata(spark.createDataFrame([(1, "Java")], "id int, types string"), "types", mapping.limit(0)).first().stratum is None


def test_units_of_a_paper(spark):
    rows = [("Graphs", ["a", "b"], "第一句话。第二句话！短。第一句话。", [" 证据 ", "", None, "第一句话。"]), (None, None, None, None), ("", [], "", [])]
    df = spark.createDataFrame(rows, "t string, k array<string>, a string, e array<string>")
    found = [r.u for r in df.select(intake.paper_units(F.col("t"), F.col("k"), F.col("a"), F.col("e")).alias("u")).collect()]
    assert found == [["标题：Graphs", "关键词：a; b", "第一句话。", "第二句话！", "证据"], [], []]


def test_decisions_are_brought_to_form(spark):
    candidates = spark.createDataFrame([(1, "new_task", "甲", "A"), (1, "new_job", "乙", "B"), (2, "new_skill", "丙", None), (None, "x", "x", "x")], "index long, kind string, name_zh string, name_en string")
    schema = "index string, status string, final_kind string, name_zh string, name_en string, taxonomy string, code string, merge_into string, reject_reason string, reason string"
    rows = [
        (" 1 ", "REJECT", "New_Skill", " ", None, None, None, None, None, " r "),
        ("2", "perhaps", "other", "名", "N", " Tasks", " T-01 ", "E1", "why", None),
        ("2", None, None, None, None, "tasks", " ", "E1", None, None),
        ("2", "reject", None, None, None, "towns", "T-01", " ", "so", ""),
        ("3", "keep", None, None, None, None, None, None, None, None),
        ("one", "keep", None, None, None, None, None, None, None, None),
        (None, "keep", None, None, None, None, None, None, None, None),
    ]
    found = sorted((tuple(r) for r in intake.validated(spark.createDataFrame(rows, schema), candidates).collect()), key=str)
    assert found == sorted(
        [
            (1, "new_skill", min("甲", "乙"), "B" if min("甲", "乙") == "乙" else "A", "reject", None, None, None, intake.NO_REASON, "r"),
            (2, "new_skill", "名", "N", "keep", "tasks", "T-01", None, "why", ""),
            (2, "new_skill", "丙", None, "keep", None, None, "E1", "", ""),
            (2, "new_skill", "丙", None, "reject", None, None, None, "so", ""),
        ],
        key=str,
    )


@pytest.mark.parametrize(
    "name,told",
    [("short", "short"), ("大规模语言模型的推理加速", "推理加速"), ("abcdefghijklm", "fghijklm"), ("xxxxx、的abcdefg", "abcdefg"), ("aaaa的的的的的的的的", "的的的的的的的"), ("", ""), (None, None), ("abcdefgh", "abcdefgh"), ("aaaaaaa的bcd", "aaaa的bcd")],
)
def test_long_names_keep_their_end(spark, name, told):
    """Eight characters at most: behind a joint that leaves four or more, else the last eight."""
    assert spark.createDataFrame([(name,)], "n string").select(intake.fitted_name(F.col("n"), 8).alias("f")).first().f == told


def test_forecasts(spark):
    columns = ["forecast_quarter", "job", "skill", "p50_uni", "p50_cov", "last_share", "n_hist_quarters"]
    rows = [(" Q3", "J", "S", "0.1", "0.25", "0.5", "4"), ("Q3", " J ", "S", "1", "0.5", "x", None), ("Q3", "no", "S", "1", "1", "1", "1"), ("Q3", "J", "S", "NaN", "1", "1", "1"), ("Q3", "J", "S", "1", "Infinity", "1", "1"), ("Q3", "J", None, "1", "1", "1", "1"), ("Q3", "J", "S", "", "1", "1", "1")]
    frame = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
    names = lambda *x: spark.createDataFrame(list(x), "name string, code string")
    found = sorted(tuple(r) for r in intake.forecasts(frame, names(("J", "j1"), ("J", "j0"), (None, "j2")), names(("S", "s"))).collect())
    assert found == [("Q3", "j0", "s", 0.1, 0.25, 0.15, 0.5, 4), ("Q3", "j0", "s", 1.0, 0.5, -0.5, 0.0, 0)]
    assert intake.forecasts(frame.limit(0), names(("J", "j")), names(("S", "s"))).collect() == []
