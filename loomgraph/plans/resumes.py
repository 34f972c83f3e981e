"""Résumés written from customers, orders, lines and parts: the text that extraction, grounding and audits work on.

A customer is a candidate, an order an experience from its date to its last shipping date, a line that isn't returned a task in it, a
part's name a skill point. The skill list also names the parts that were returned, which no experience tells of.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomgraph.sources.tables import load


def _joined(rows, value: str, separator: str):
    return F.array_join(F.array_sort(F.collect_list(value)), separator)


def experiences(spark, sf_dir: str) -> DataFrame:
    """(candidate, orderkey, started, ended, points, line count, body) of each order with lines."""
    rows = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    percent = F.round(F.col("l_discount") * 100).cast("int")
    task = F.concat(F.lit("- Delivered "), F.col("l_quantity").cast("int"), F.lit(" "), F.col("p_name"), F.lit(" as "), F.col("p_type"),
                    F.when(percent >= 8, F.concat(F.lit(", "), percent, F.lit("% above plan"))).otherwise(""), F.when(percent == 9, " (baseline 1995)").otherwise(""))
    told = F.col("l_returnflag") != "R"
    lines = rows.groupBy("l_orderkey").agg(
        F.max("l_shipdate").cast("date").alias("ended"),
        F.collect_set("p_name").alias("listed"),
        F.array_sort(F.collect_set(F.when(told, F.col("p_name")))).alias("points"),
        F.array_sort(F.collect_list(F.when(told, task))).alias("tasks"),
    )
    orders = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("candidate"), F.col("o_orderdate").cast("date").alias("started"), "o_orderpriority")
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    month = lambda c: F.date_format(c, "yyyy.MM")
    head = F.concat(month("started"), F.lit("-"), month("ended"), F.lit(" Order "), F.col("o_orderkey"), F.lit(" "), F.col("o_orderpriority"))
    return joined.select("candidate", F.col("o_orderkey").alias("orderkey"), "started", "ended", "listed", "points", F.array_join(F.concat(F.array(head), "tasks"), "\n").alias("body"))


def resumes(spark, sf_dir: str) -> DataFrame:
    """(candidate, text, years) of each customer with orders."""
    entries = experiences(spark, sf_dir)
    told = F.array_sort(F.collect_list(F.struct("started", "orderkey", "body")))
    rows = entries.groupBy("candidate").agg(told.alias("told"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("listed")))).alias("skills"))
    people = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("candidate"), "c_name", "c_mktsegment", F.floor(F.abs("c_acctbal") / 1000).alias("years"))
    text = F.concat_ws("\n", F.lit("Summary"), F.concat(F.lit("  "), F.col("c_name"), F.lit(", "), F.col("c_mktsegment"), F.lit(", "), F.col("years"), F.lit(" years.")), F.concat(F.lit("Skills: "), F.array_join("skills", ", ")),
                       F.lit("Experience"), F.array_join(F.transform("told", lambda x: x["body"]), "\n"), F.lit("Certificates: " "plan reading"))
    return rows.join(people, "candidate").select("candidate", text.alias("text"), "years")


#: Common table expressions: `experiences` and `resumes`.
RESUME_SQL = """told_lines AS (SELECT l_orderkey, l_shipdate, p_name, l_returnflag <> 'R' AS told, round(l_discount * 100)::INT AS percent,
    concat('- Delivered ', l_quantity::INT, ' ', p_name, ' as ', p_type, CASE WHEN round(l_discount * 100)::INT >= 8 THEN concat(', ', round(l_discount * 100)::INT, '% above plan') ELSE '' END,
        CASE WHEN round(l_discount * 100)::INT = 9 THEN ' (baseline 1995)' ELSE '' END) AS task FROM lineitem JOIN part ON l_partkey = p_partkey),
lined AS (SELECT l_orderkey, max(l_shipdate)::DATE AS ended, list_distinct(list(p_name)) AS listed, coalesce(list_sort(list_distinct(list(p_name) FILTER (told))), []) AS points, coalesce(list_sort(list(task) FILTER (told)), []) AS tasks FROM told_lines GROUP BY l_orderkey),
experiences AS (SELECT o_custkey AS candidate, o_orderkey AS orderkey, o_orderdate::DATE AS started, ended, listed, points,
    array_to_string([concat(strftime(o_orderdate::DATE, '%Y.%m'), '-', strftime(ended, '%Y.%m'), ' Order ', o_orderkey, ' ', o_orderpriority)] || tasks, chr(10)) AS body FROM orders JOIN lined ON o_orderkey = l_orderkey),
resumes AS (SELECT candidate, years, concat_ws(chr(10), 'Summary', concat('  ', c_name, ', ', c_mktsegment, ', ', years, ' years.'), concat('Skills: ', array_to_string(skills, ', ')), 'Experience', told, 'Certificates: plan reading') AS text
    FROM (SELECT candidate, string_agg(body, chr(10) ORDER BY started, orderkey) AS told, list_sort(list_distinct(flatten(list(listed)))) AS skills FROM experiences GROUP BY candidate)
    JOIN (SELECT c_custkey AS candidate, c_name, c_mktsegment, floor(abs(c_acctbal) / 1000)::BIGINT AS years FROM customer) USING (candidate))"""
