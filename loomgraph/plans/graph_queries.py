"""Graph layers bound to the star schema: job = market segment, task = order priority, skill = brand, point = part name."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.operators import graph
from loomgraph.plans import params as P
from loomgraph.plans.registry import registry
from loomgraph.sources.interim import settle
from loomgraph.sources.tables import load

QUERIES, ORACLES, query = registry()


def facts(spark: SparkSession, sf_dir: str, in_task: int | None = None) -> DataFrame:
    """One row per line of an order with its job, task, month, skill and point; orders without lines have null skills.

    With `in_task`, documents are dealt to so many parts that one has about this many lines: for groupings that hold a row for each line.
    """
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice", "o_orderdate")
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    lineitem = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    part = load(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")
    posts, lines = orders.join(customer, orders.o_custkey == customer.c_custkey), lineitem.join(part, lineitem.l_partkey == part.p_partkey)
    if in_task:
        # lines take few bytes when shuffled, so that partitions merged by bytes hold very many of them
        parts = max(spark.sparkContext.defaultParallelism, math.ceil(lineitem.count() / in_task))
        posts, lines = posts.repartition(parts, "o_orderkey"), lines.repartition(parts, "l_orderkey")
    joined = posts.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.selectExpr(
        "o_orderkey AS doc", "c_mktsegment AS job", "o_orderpriority AS task", "date_format(o_orderdate, 'yyyy-MM') AS month", "o_totalprice AS salary", "p_brand AS skill", "p_name AS point", "l_quantity AS quantity"
    )


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.documents(facts(spark, sf_dir), ["doc", "job", "task", "month"])


def freq(spark: SparkSession, sf_dir: str, window: str | None = None) -> DataFrame:
    return graph.presence_frequency(docs(spark, sf_dir), window)


def settled_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frequencies written once, for queries that read them several times; the facts are joined and counted once."""
    return settle(freq(spark, sf_dir), "freq")


FACTS = """facts AS MATERIALIZED (
  SELECT o_orderkey AS doc, c_mktsegment AS job, o_orderpriority AS task, strftime(o_orderdate, '%Y-%m') AS month, o_totalprice AS salary, p_brand AS skill, p_name AS point, l_quantity AS quantity
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (lineitem JOIN part ON l_partkey = p_partkey) ON o_orderkey = l_orderkey)"""


def freq_sql(window: bool = False) -> str:
    m, g = ("month, ", "GROUP BY ALL") if window else ("", "GROUP BY ALL")
    one = lambda kind, src, dst, where="": f"SELECT {m}'{kind}' AS kind, {src} AS src, {dst} AS dst, count(DISTINCT doc)::DOUBLE AS w FROM facts {where} {g}"
    return f"""{FACTS}, freq AS MATERIALIZED (
  {one("total", "''", "''")} UNION ALL {one("job", "job", "''")} UNION ALL {one("task", "task", "''")} UNION ALL {one("job_task", "job", "task")}
  UNION ALL {one("skill", "skill", "''", "WHERE skill IS NOT NULL")} UNION ALL {one("job_skill", "job", "skill", "WHERE skill IS NOT NULL")}
  UNION ALL {one("task_skill", "task", "skill", "WHERE skill IS NOT NULL")} UNION ALL {one("skill_skillpoint", "skill", "point", "WHERE skill IS NOT NULL")}
  UNION ALL SELECT {m}'skillpoint' AS kind, point AS src, '' AS dst, count(*)::DOUBLE AS w FROM (SELECT DISTINCT month, doc, skill, point FROM facts WHERE skill IS NOT NULL) {g})"""


@query("weighted_presence_freq", f"WITH {freq_sql()} SELECT * FROM freq")
def weighted_presence_freq(spark, sf_dir):
    return freq(spark, sf_dir)


def _edges_sql(relation: str, cte: str = "freq", scale: float = 1.0) -> str:
    return f"""SELECT p.src, p.dst, round_even({scale}::DOUBLE * p.w / n.w, 4) AS weight FROM {cte} p JOIN {cte} n ON p.src = n.src AND n.kind = '{graph.RELATIONS[relation]}'
WHERE p.kind = '{relation}' AND p.w / n.w > 0"""


for _name, _relation in (("edges_job_task", "job_task"), ("edges_job_skill", "job_skill"), ("edges_task_skill", "task_skill"), ("edges_skill_point", "skill_skillpoint")):

    @query(_name, f"WITH {freq_sql()} {_edges_sql(_relation)}")
    def _edges(spark, sf_dir, relation=_relation):
        return graph.conditional_edges(freq(spark, sf_dir), relation)


@query("entity_share", f"""WITH {freq_sql()} SELECT kind, src, round_even(w / (SELECT w FROM freq WHERE kind = 'total'), 6) AS share FROM freq WHERE kind IN ('task', 'skill', 'skillpoint')""")
def entity_share(spark, sf_dir):
    return graph.entity_share(freq(spark, sf_dir))


@query("merge_history", f"""WITH {freq_sql(True)}, picked AS (SELECT * FROM freq WHERE month IN ('1995-03', '1995-02'))
SELECT kind, src, dst, round(sum(CASE WHEN month = '1995-03' THEN w ELSE {P.ALPHA}::DOUBLE * w END), 6) AS w FROM picked GROUP BY ALL""")
def merge_history(spark, sf_dir):
    monthly = freq(spark, sf_dir, "month")
    merged = graph.merge_history(monthly.where("month = '1995-03'"), monthly.where("month = '1995-02'"), ["kind", "src", "dst"], P.ALPHA)
    return merged.withColumn("w", F.round("w", 6))


_STEP = "(substr(month, 1, 4)::INT * 12 + substr(month, 6, 2)::INT)"


@query("decayed_freq_chain", f"""WITH {freq_sql(True)}, last AS (SELECT max({_STEP}) AS n FROM freq)
SELECT kind, src, dst, round(sum(pow({P.ALPHA}::DOUBLE, n - {_STEP}) * w), 6) AS w FROM freq, last GROUP BY ALL""")
def decayed_freq_chain(spark, sf_dir):
    monthly = freq(spark, sf_dir, "month").withColumn("step", F.expr("int(substr(month, 1, 4)) * 12 + int(substr(month, 6, 2))"))
    last = load(spark, sf_dir, "orders").agg(F.max(F.expr("year(o_orderdate) * 12 + month(o_orderdate)")).alias("last"))
    chained = graph.decayed_chain(monthly.join(F.broadcast(last)), F.col("step"), F.col("last"), ["kind", "src", "dst"], P.ALPHA)
    return chained.withColumn("w", F.round("w", 6))


@query("salary_weight", f"""WITH r AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, o_totalprice, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_totalprice) - 1 AS i,
  count(*) OVER (PARTITION BY strftime(o_orderdate, '%Y-%m')) AS n FROM orders), m AS (SELECT month, o_totalprice AS median FROM r WHERE i = n // 2)
SELECT o_orderkey AS doc, r.month, round(ln(1 + o_totalprice / median), 6) AS salary_weight FROM r JOIN m ON r.month = m.month""")
def salary_weight(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc", "date_format(o_orderdate, 'yyyy-MM') AS month", "o_totalprice AS salary")
    weight = F.when(F.col("salary").isNull(), 1.0).otherwise(F.log1p(F.col("salary") / F.col("median")))
    return rows.join(graph.upper_median(rows, "salary", ["month"]), "month").select("doc", "month", F.round(weight, 6).alias("salary_weight"))


_LEVEL = "CASE WHEN quantity <= 2 THEN 'U' WHEN quantity <= 15 THEN 'P1' WHEN quantity <= 28 THEN 'P2' WHEN quantity <= 42 THEN 'P3' WHEN quantity <= 49 THEN 'P4' END"
_LEVELS = ["P1", "P2", "P3", "P4", "U"]


@query("prof_distribution", f"""WITH {FACTS}, g AS (SELECT skill, {_LEVEL} AS level FROM facts WHERE skill IS NOT NULL)
SELECT skill, count(*) AS n, {", ".join(f"count(*) FILTER (level = '{x}') AS {x}" for x in _LEVELS)}, count(*) FILTER (level IS NULL) AS unset FROM g GROUP BY skill""")
def prof_distribution(spark, sf_dir):
    rows = facts(spark, sf_dir).where("skill IS NOT NULL").selectExpr("skill", f"{_LEVEL} AS level")
    return graph.ordinal_shares(rows, "skill", "level", _LEVELS)


@query("prof_pivot", f"""WITH {FACTS}, g AS (SELECT skill, job, {_LEVEL} AS level FROM facts WHERE skill IS NOT NULL)
SELECT job, {", ".join(f"round(count(*) FILTER (level = '{x}')::DOUBLE / count(level), 6) AS {x}" for x in _LEVELS)} FROM g GROUP BY job""")
def prof_pivot(spark, sf_dir):
    rows = facts(spark, sf_dir).where("skill IS NOT NULL").selectExpr("job", f"{_LEVEL} AS level").where("level IS NOT NULL")
    wide = rows.groupBy("job").pivot("level", _LEVELS).count().na.fill(0)
    total = sum(F.col(x) for x in _LEVELS)
    return wide.select("job", *[F.round(F.col(x) / total, 6).alias(x) for x in _LEVELS])


def all_edges(table):
    out = None
    for relation in graph.RELATIONS:
        part = graph.conditional_edges(table, relation).withColumn("relation", F.lit(relation))
        out = part if out is None else out.unionByName(part)
    return out


_ALL_EDGES = "edges AS (" + " UNION ALL ".join(f"SELECT '{r}' AS relation, * FROM ({_edges_sql(r)})" for r in graph.RELATIONS) + ")"


def strengths(spark, sf_dir):
    tasks = load(spark, sf_dir, "orders").selectExpr("'task' AS kind", "o_orderpriority AS id", "int(substr(o_orderpriority, 1, 1)) * 17 AS x")
    skills = load(spark, sf_dir, "part").selectExpr("'skill' AS kind", "p_brand AS id", "int(regexp_extract(p_brand, '([0-9]+)', 1)) * 7 AS x")
    return tasks.unionByName(skills).distinct().selectExpr("kind", "id", "least(double(1.0), double(0.2) + double(0.01) * (x % 90)) AS strength")


STRENGTHS_SQL = """strengths AS (SELECT kind, id, least(1.0::DOUBLE, 0.2::DOUBLE + 0.01::DOUBLE * (x % 90)) AS strength FROM (
  SELECT DISTINCT 'task' AS kind, o_orderpriority AS id, substr(o_orderpriority, 1, 1)::INT * 17 AS x FROM orders
  UNION SELECT DISTINCT 'skill', p_brand, regexp_extract(p_brand, '([0-9]+)', 1)::INT * 7 FROM part)),
gaps AS (SELECT s.kind, s.id, greatest(0.0::DOUBLE, strength - coalesce(share, 0)) AS gap FROM strengths s
  LEFT JOIN (SELECT kind, src, round_even(w / (SELECT w FROM freq WHERE kind = 'total'), 6) AS share FROM freq) f ON s.kind = f.kind AND s.id = f.src)"""


def all_gaps(spark, sf_dir, table):
    share = graph.entity_share(table).select("kind", F.col("src").alias("id"), F.col("share").alias("exposure"))
    return graph.gaps(strengths(spark, sf_dir), share)


# documents of each task and skill are counted straight from the tables
_SHARES = """freq AS (SELECT 'total' AS kind, '' AS src, count(DISTINCT o_orderkey)::DOUBLE AS w FROM orders UNION ALL SELECT 'task', o_orderpriority, count(DISTINCT o_orderkey)::DOUBLE FROM orders GROUP BY o_orderpriority
  UNION ALL SELECT 'skill', p_brand, count(DISTINCT o_orderkey)::DOUBLE FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY p_brand)"""


@query("gaps", f"WITH {_SHARES}, {STRENGTHS_SQL} SELECT kind, id, round(gap, 6) AS gap FROM gaps")
def gaps(spark, sf_dir):
    return all_gaps(spark, sf_dir, settled_freq(spark, sf_dir)).withColumn("gap", F.round("gap", 6))


# weak task-skill edges are no base edges, so that new ones can be synthesised
@query("gap_synthesis", f"""WITH {freq_sql()}, {_ALL_EDGES}, {STRENGTHS_SQL},
kept AS (SELECT * FROM edges WHERE relation <> 'task_skill' OR weight >= 0.15::DOUBLE),
t AS (SELECT id, gap FROM gaps WHERE kind = 'task'), s AS (SELECT id, gap FROM gaps WHERE kind = 'skill'),
raw AS (
  SELECT relation, src, dst, weight AS base, {P.LAMBDA_J}::DOUBLE * coalesce(t.gap, s.gap, 0) AS delta, 'base' AS origin FROM kept LEFT JOIN t ON dst = t.id AND relation = 'job_task' LEFT JOIN s ON dst = s.id AND relation = 'job_skill' WHERE relation IN ('job_task', 'job_skill')
  UNION ALL SELECT relation, src, dst, weight, {P.LAMBDA_TS}::DOUBLE * coalesce(t.gap, 0) * coalesce(s.gap, 0), 'base' FROM kept LEFT JOIN t ON src = t.id LEFT JOIN s ON dst = s.id WHERE relation = 'task_skill'
  UNION ALL SELECT relation, src, dst, weight, {P.LAMBDA_SP}::DOUBLE * coalesce(s.gap, 0), 'base' FROM kept LEFT JOIN s ON src = s.id WHERE relation = 'skill_skillpoint'
  UNION ALL (SELECT 'task_skill', t.id, s.id, 0.0::DOUBLE, {P.LAMBDA_TS}::DOUBLE * t.gap * s.gap AS d, 'synthesized' FROM t, s WHERE t.gap > 0 AND s.gap > 0 AND NOT EXISTS (FROM kept WHERE relation = 'task_skill' AND src = t.id AND dst = s.id)
    ORDER BY {P.LAMBDA_TS}::DOUBLE * t.gap * s.gap DESC, t.id, s.id LIMIT {P.MAX_NEW_TS}))
SELECT relation, src, dst, base AS base_weight, round_even(delta, 4) AS delta_weight, round_even(base + delta, 4) AS effective_weight, origin FROM raw""")
def gap_synthesis(spark, sf_dir):
    table = settled_freq(spark, sf_dir)
    edges = all_edges(table).where("relation <> 'task_skill' OR weight >= 0.15D")
    return graph.synthesize(edges, all_gaps(spark, sf_dir, table), P.LAMBDA_J, P.LAMBDA_TS, P.LAMBDA_SP, P.MAX_NEW_TS)


@query("two_hop_paths", f"""WITH {freq_sql()}, {_ALL_EDGES} SELECT a.src, b.dst, round(sum(a.weight * b.weight), 6) AS weight FROM edges a JOIN edges b ON a.dst = b.src
WHERE a.relation = 'job_task' AND b.relation = 'task_skill' GROUP BY ALL""")
def two_hop_paths(spark, sf_dir):
    table = settled_freq(spark, sf_dir)
    paths = graph.two_hop(graph.conditional_edges(table, "job_task"), graph.conditional_edges(table, "task_skill"))
    return paths.withColumn("weight", F.round("weight", 6))


@query("two_hop_blend", f"""WITH {freq_sql()}, {_ALL_EDGES}, v AS (SELECT a.src, b.dst, sum(a.weight * b.weight) AS weight FROM edges a JOIN edges b ON a.dst = b.src WHERE a.relation = 'job_task' AND b.relation = 'task_skill' GROUP BY ALL),
n AS (SELECT src, dst, weight / max(weight) OVER (PARTITION BY src) AS v FROM v), d AS (SELECT src, dst, weight / max(weight) OVER (PARTITION BY src) AS d FROM edges WHERE relation = 'job_skill'),
x AS (SELECT coalesce(n.src, d.src) AS src, coalesce(n.dst, d.dst) AS dst, 0.3::DOUBLE * coalesce(d, 0) + 0.7::DOUBLE * coalesce(v, 0) AS x FROM n FULL JOIN d ON n.src = d.src AND n.dst = d.dst)
SELECT src, dst, round(x / max(x) OVER (PARTITION BY src), 6) AS score FROM x""")
def two_hop_blend(spark, sf_dir):
    table = settled_freq(spark, sf_dir)
    via = graph.two_hop(graph.conditional_edges(table, "job_task"), graph.conditional_edges(table, "task_skill"))
    return graph.blend_two_hop(graph.conditional_edges(table, "job_skill"), via).withColumn("score", F.round("score", 6))


@query("full_outer_base_effective", f"""WITH {freq_sql(True)},
e AS (SELECT p.month, p.src, p.dst, round_even(p.w / n.w, 4) AS weight FROM freq p JOIN freq n ON p.month = n.month AND p.src = n.src AND n.kind = 'job' WHERE p.kind = 'job_skill')
SELECT coalesce(b.src, f.src) AS src, coalesce(b.dst, f.dst) AS dst, coalesce(b.weight, 0) AS base_weight, coalesce(f.weight, b.weight) AS effective_weight,
  CASE WHEN b.weight IS NULL THEN 'delta' WHEN f.weight IS NULL THEN 'base' ELSE 'both' END AS origin
FROM (FROM e WHERE month = '1995-01') b FULL JOIN (FROM e WHERE month = '1995-02') f ON b.src = f.src AND b.dst = f.dst""")
def full_outer_base_effective(spark, sf_dir):
    edges = graph.conditional_edges(freq(spark, sf_dir, "month"), "job_skill", "month")
    return graph.base_and_effective(edges.where("month = '1995-01'"), edges.where("month = '1995-02'"))


@query("validate_graph", f"""WITH {freq_sql()}, {_ALL_EDGES}, nodes AS (SELECT DISTINCT src AS id FROM freq WHERE kind IN ('job', 'task', 'skill')),
e AS (SELECT src, dst, weight FROM edges WHERE relation IN ('job_skill', 'skill_skillpoint'))
SELECT 'self_loop' AS rule, src, dst FROM e WHERE src = dst UNION ALL SELECT 'unknown_src', src, dst FROM e WHERE src NOT IN (FROM nodes) UNION ALL SELECT 'unknown_dst', src, dst FROM e WHERE dst NOT IN (FROM nodes)
UNION ALL SELECT 'weight_range', src, dst FROM e WHERE weight <= 0 OR weight > 1 UNION ALL SELECT 'duplicate', src, dst FROM e GROUP BY ALL HAVING count(*) > 1""")
def validate_graph(spark, sf_dir):
    table = settled_freq(spark, sf_dir)
    edges = graph.conditional_edges(table, "job_skill").unionByName(graph.conditional_edges(table, "skill_skillpoint"))
    return graph.violations(edges, table.where("kind IN ('job', 'task', 'skill')").select(F.col("src").alias("id")))


@query("node_degrees", f"WITH {freq_sql()}, {_ALL_EDGES} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id")
def node_degrees(spark, sf_dir):
    return graph.degrees(all_edges(settled_freq(spark, sf_dir)))
