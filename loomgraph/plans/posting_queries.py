"""Posting functions over literal cases; the SQL is the table of expected values."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import postings
from loomgraph.plans.registry import registry

QUERIES, ORACLES, query = registry()

# Cases with their results.
SALARIES = {"1.5-2万": 17500.0, "8千-1.2万": 10000.0, "6-8千": 7000.0, "1-1.5万·13薪": 13541.67, "20-30万/年": 20833.33, "200元/天": 4400.0, "300-500元/天": 8800.0, "3千及以下": 3000.0, "2万以上": 20000.0, "面议": None, "": None, "薪资不限": None}
YEARS = {"3-5年以上相关工作经验": 5, "具有5年开发经验，2年管理经验": 5, "三年以上工作经验": 3, "十五年以上从业经历": 15, "无经验可": 0, "经验不限": 0, "良好的沟通能力": None, "3+ years of work": 3, "20年经验": 15, "工作年限：4年": 4}
LEVELS = [("3-4年经验", "助理工程师", "", "", "L2", "work_year"), ("在校生/应届", "高级工程师", "", "", "L0", "work_year"), ("", "工程师", "5年以上开发经验", "", "L3", "text"), ("", "工程师", "欢迎应届毕业生", "", "L0", "text"), ("", "资深架构师", "无", "", "L4", "title"),
          ("", "senior engineer", "x", "", "L3", "title"), ("", "工程师", "x", "初级开发", "L1", "funtype"), ("", "工程师", "x", "", "", ""), ("无需经验", "", "", "", "L1", "work_year"), ("", "实习生", "x", "", "L0", "title")]
DEGREES = {"学历不限，大专优先": "学历不限", "本科及以上学历": "本科", "大专或本科": "大专", "硕士研究生": "硕士", "博士": "博士", "会开车": "", "毕业即可": ""}


def _sql(value) -> str:
    return "NULL" if value is None else f"'{value}'" if isinstance(value, str) else repr(value)


def _values(rows, names: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in rows)}) AS t({names})"


@query("salary_parse", _values([(k, v) for k, v in SALARIES.items()], "salary, monthly").replace("SELECT *", "SELECT salary, monthly::DOUBLE AS monthly"))
def salary_parse(spark, sf_dir):
    return spark.createDataFrame([(k,) for k in SALARIES], "salary string").select("salary", postings.salary_monthly(F.col("salary")).alias("monthly"))


@query("years_parse", _values([(k, v) for k, v in YEARS.items()], "text, years"))
def years_parse(spark, sf_dir):
    return spark.createDataFrame([(k,) for k in YEARS], "text string").select("text", postings.text_years(F.col("text")).alias("years"))


@query("level_resolve", _values(LEVELS, "work_year, title, body, category, level, source"))
def level_resolve(spark, sf_dir):
    rows = spark.createDataFrame([r[:4] for r in LEVELS], "work_year string, title string, body string, category string")
    return rows.withColumn("r", postings.resolve_level(*map(F.col, rows.columns))).select(*rows.columns, "r.level", "r.source")


@query("degree_gate", _values(list(DEGREES.items()), "text, degree"))
def degree_gate(spark, sf_dir):
    return spark.createDataFrame([(k,) for k in DEGREES], "text string").select("text", postings.degree_gate(F.col("text")).alias("degree"))
