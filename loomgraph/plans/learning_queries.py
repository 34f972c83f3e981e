"""Candidates, learning paths and upkeep of items: customers are candidates, brands skills, part names points, months windows."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from loomgraph.operators import graph, learning, matching
from loomgraph.plans.graph_queries import _edges_sql, facts, freq_sql, full_outer_base_effective, settled_freq
from loomgraph.plans.match_queries import _GAPS, _gaps
from loomgraph.plans.registry import registry
from loomgraph.sources.interim import dealt, settle
from loomgraph.sources.tables import load

QUERIES, ORACLES, query = registry()


def _owned(spark, sf_dir):
    """(candidate, point, proficiency): the largest quantity of a part name that a customer has ordered, as a share of 50."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("candidate"))
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    part = load(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("point"))
    held = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return dealt(held.select("candidate", "point", "l_quantity"), "candidate").groupBy("candidate", "point").agg((F.max("l_quantity") / 50).alias("proficiency"))


_SP, _JS, _TS, _JT = (f"({_edges_sql(r)})" for r in ("skill_skillpoint", "job_skill", "task_skill", "job_task"))
_OWNED = "owned AS MATERIALIZED (SELECT o_custkey AS candidate, p_name AS point, max(l_quantity) / 50.0::DOUBLE AS proficiency FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)"
_VECTOR = f"{freq_sql()}, {_OWNED}, vec AS MATERIALIZED (SELECT candidate, src AS skill, sum(proficiency * greatest(weight, 0.05::DOUBLE)) / sum(greatest(weight, 0.05::DOUBLE)) AS value FROM owned JOIN {_SP} e ON point = dst GROUP BY ALL)"
_ATTAIN = "CASE WHEN coalesce({r}, 0) <= 0.02::DOUBLE THEN 1 ELSE least(1, coalesce({o}, 0) / {r}) END"


def _vector(spark, sf_dir, table):
    return learning.skill_vector(_owned(spark, sf_dir), graph.conditional_edges(table, "skill_skillpoint"))


@query("resume_vector", f"WITH {_VECTOR} SELECT candidate, skill, round(value, 6) AS value FROM vec")
def resume_vector(spark, sf_dir):
    return _vector(spark, sf_dir, settled_freq(spark, sf_dir)).withColumn("value", F.round("value", 6))


def _asked(spark, sf_dir, table):
    """A candidate's job with the skills it requires, and what the candidate has of them."""
    who = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("candidate"), F.col("c_mktsegment").alias("job"))
    required = graph.conditional_edges(table, "job_skill").selectExpr("src AS job", "dst AS skill", "weight AS req")
    return dealt(who, "candidate").join(F.broadcast(required), "job").join(_vector(spark, sf_dir, table), ["candidate", "skill"], "left")


_ASKED = f"asked AS (SELECT c_custkey AS candidate, c_mktsegment AS job, e.dst AS skill, e.weight AS req, v.value FROM customer JOIN {_JS} e ON c_mktsegment = e.src LEFT JOIN vec v ON v.candidate = c_custkey AND v.skill = e.dst)"


@query("job_coverage", f"WITH {_VECTOR}, {_ASKED} SELECT candidate, job, round(sum(req * {_ATTAIN.format(r='req', o='value')}) / sum(req), 6) AS coverage FROM asked WHERE req > 0.04::DOUBLE GROUP BY ALL")
def job_coverage(spark, sf_dir):
    asked = _asked(spark, sf_dir, settled_freq(spark, sf_dir)).where("req > 0.04D")
    return learning.coverage(asked, ["candidate", "job"], "req", "req", "value").withColumn("coverage", F.round("coverage", 6))


@query("task_coverage", f"WITH {_VECTOR}, {_ASKED} SELECT candidate, t.src AS task, round(sum(t.weight * {_ATTAIN.format(r='req', o='value')}) / sum(t.weight), 6) AS coverage FROM asked JOIN {_TS} t ON asked.skill = t.dst JOIN {_JT} j ON j.src = job AND j.dst = t.src GROUP BY ALL")
def task_coverage(spark, sf_dir):
    table = settled_freq(spark, sf_dir)
    tasks = graph.conditional_edges(table, "job_task").selectExpr("src AS job", "dst AS task")
    skills = graph.conditional_edges(table, "task_skill").selectExpr("src AS task", "dst AS skill", "weight")
    asked = _asked(spark, sf_dir, table).join(F.broadcast(tasks.join(skills, "task")), ["job", "skill"])
    return learning.coverage(asked, ["candidate", "task"], "weight", "req", "value").withColumn("coverage", F.round("coverage", 6))


@query("similar_jobs", f"""WITH {freq_sql()}, e AS MATERIALIZED {_JS}, n AS (SELECT src, sqrt(sum(weight * weight)) AS n FROM e GROUP BY src),
s AS (SELECT a.src AS job, b.src AS other, round(sum(a.weight * b.weight) / (any_value(x.n) * any_value(y.n)), 6) AS similarity FROM e a JOIN e b ON a.dst = b.dst AND a.src <> b.src JOIN n x ON x.src = a.src JOIN n y ON y.src = b.src GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY similarity DESC, other) AS rank FROM s) WHERE rank <= 4""")
def similar_jobs(spark, sf_dir):
    edges = settle(graph.conditional_edges(settled_freq(spark, sf_dir), "job_skill").selectExpr("src AS job", "dst AS skill", "weight"))
    norms = edges.groupBy("job").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    pairs = edges.join(edges.toDF("other", "skill", "w"), "skill").where("job <> other").groupBy("job", "other").agg(F.sum(F.col("weight") * F.col("w")).alias("dot"))
    scored = pairs.join(norms, "job").join(norms.toDF("other", "n2"), "other").select("job", "other", F.round(F.col("dot") / (F.col("norm") * F.col("n2")), 6).alias("similarity"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("job").orderBy(F.desc("similarity"), "other"))).where("rank <= 4")


# years: years with an order; degree: kinds of priority used; a job's targets are the lower medians of its candidates
_CAREERS = """c AS (SELECT o_custkey AS candidate, c_mktsegment AS job, count(DISTINCT year(o_orderdate)) AS years, count(DISTINCT o_orderpriority) AS degree FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
t AS (SELECT job, quantile_disc(years, 0.5) AS y, quantile_disc(degree, 0.5) AS d FROM c GROUP BY job),
scored AS (SELECT candidate, job, CASE WHEN years >= y THEN greatest(0.82::DOUBLE, 1 - (years - y) / 26::DOUBLE) ELSE greatest(0.0::DOUBLE, 1 - (y - years)::DOUBLE / greatest(y, 3)) END AS experience, CASE WHEN d <= 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, degree::DOUBLE / d) END AS degree FROM c JOIN t USING (job))"""


def careers(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("candidate"), F.year("o_orderdate").alias("year"), "o_orderpriority")
    jobs = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("candidate"), F.col("c_mktsegment").alias("job"))
    held = settle(orders.groupBy("candidate").agg(F.countDistinct("year").alias("years"), F.countDistinct("o_orderpriority").alias("degree")).join(jobs, "candidate"))
    for name in ("years", "degree"):  # few values: medians from their counts
        counts = held.groupBy("job", name).agg(F.count("*").alias("n"))
        w = Window.partitionBy("job")
        up = counts.withColumn("up", F.sum("n").over(w.orderBy(name).rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))
        held = held.join(F.broadcast(up.where("2 * up >= all").groupBy("job").agg(F.min(name).alias(f"{name}_wanted"))), "job")
    return held.select("candidate", "job", learning.experience_score(F.col("years"), F.col("years_wanted")).alias("experience"), learning.degree_score(F.col("degree"), F.col("degree_wanted")).alias("degree"))


@query("experience_degree", f"WITH {_CAREERS} SELECT candidate, job, round(experience, 6) AS experience, round(degree, 6) AS degree FROM scored")
def experience_degree(spark, sf_dir):
    return careers(spark, sf_dir).select("candidate", "job", F.round("experience", 6).alias("experience"), F.round("degree", 6).alias("degree"))


@query("five_dim_fit", f"WITH {_GAPS}, {_CAREERS}, s AS (SELECT candidate, job, avg(CASE WHEN median IS NULL THEN 1 ELSE least(1, coalesce(observed, 0)::DOUBLE / median) END) AS skill, avg((gap <> 'LEARN')::INT) AS task FROM gaps GROUP BY ALL) SELECT candidate, job, round(0.34::DOUBLE * skill + 0.26::DOUBLE * task + 0.16::DOUBLE * experience + 0.14::DOUBLE * degree + 0.10::DOUBLE, 6) AS fit FROM s JOIN scored USING (candidate, job)")
def five_dim_fit(spark, sf_dir):
    own = matching.attain(F.coalesce("observed", F.lit(0)), F.coalesce("median", F.lit(0)))
    rows = _gaps(spark, sf_dir).groupBy("candidate", "job").agg(F.avg(own).alias("skill"), F.avg((F.col("gap") != "LEARN").cast("int")).alias("task"))
    joined = rows.join(careers(spark, sf_dir), ["candidate", "job"])
    return joined.select("candidate", "job", F.round(matching.five_dimension_score(F.col("skill"), F.col("task"), F.col("experience"), F.col("degree"), F.lit(1.0)), 6).alias("fit"))


# a point's stage is the third of the largest size of its parts; points of small weight are foresight, those of another type are less relevant
_POINTS = f"pts AS (SELECT e.src AS skill, e.dst AS point, e.weight * (CASE WHEN s.type = 'STANDARD' THEN 1.0::DOUBLE ELSE 0.15::DOUBLE END) * (CASE WHEN e.weight < 0.02::DOUBLE THEN 2.2::DOUBLE ELSE 1.0::DOUBLE END) AS score, s.stage FROM {_SP} e JOIN (SELECT p_name, min(p_type) AS type, (CASE WHEN avg(p_size) <= 24 THEN 1 WHEN avg(p_size) <= 27 THEN 2 ELSE 3 END)::INT AS stage FROM part GROUP BY 1) s ON e.dst = s.p_name)"


@query("staged_learning_path", f"""WITH {_VECTOR}, {_ASKED}, {_POINTS}, items AS (SELECT candidate, skill, round(req * (1 - {_ATTAIN.format(r='req', o='value')}), 9) AS gap FROM asked WHERE {_ATTAIN.format(r='req', o='value')} < 0.85::DOUBLE),
i AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY gap DESC, skill) AS i FROM items),
o AS (SELECT i.candidate, i.i, stage, p.point, row_number() OVER (PARTITION BY i.candidate, i.skill ORDER BY score DESC, p.point) AS k FROM i JOIN pts p ON i.skill = p.skill WHERE NOT EXISTS (SELECT 1 FROM owned w WHERE w.candidate = i.candidate AND w.point = p.point)),
f AS (SELECT candidate, stage, point, min((i, k)) AS place FROM o WHERE k <= 6 GROUP BY ALL)
SELECT candidate, stage, step, point FROM (SELECT *, row_number() OVER (PARTITION BY candidate, stage ORDER BY place, point) AS step FROM f) WHERE step <= 6""")
def staged_learning_path(spark, sf_dir):
    table = settled_freq(spark, sf_dir)
    got = learning.attain(F.coalesce("value", F.lit(0.0)), F.col("req"))
    items = _asked(spark, sf_dir, table).where(got < 0.85).select("candidate", "skill", F.round(F.col("req") * (1 - got), 9).alias("gap"))
    size = F.avg("p_size")
    kinds = load(spark, sf_dir, "part").groupBy(F.col("p_name").alias("point")).agg(F.min("p_type").alias("type"), F.when(size <= 24, 1).when(size <= 27, 2).otherwise(3).alias("stage"))
    score = F.col("weight") * F.when(F.col("type") == "STANDARD", 1.0).otherwise(0.15) * F.when(F.col("weight") < 0.02, 2.2).otherwise(1.0)
    points = graph.conditional_edges(table, "skill_skillpoint").selectExpr("src AS skill", "dst AS point", "weight").join(kinds, "point").select("skill", "point", score.alias("score"), "stage")
    return learning.staged_path(items, points, _owned(spark, sf_dir))


# the development nodes of a brand are the part names of its small parts, by size; brands of few small parts have no graph
_NODES = "nodes AS (SELECT skill, node, level FROM (SELECT *, count(*) OVER (PARTITION BY skill) AS n FROM (SELECT p_brand AS skill, p_name AS node, min(p_size) AS level FROM part WHERE p_size <= 5 GROUP BY ALL)) WHERE n >= 2)"


@query("path_plan", f"""WITH {_GAPS}, {_OWNED}, {_NODES}, s AS (SELECT g.candidate, g.skill, string_agg(node, ';' ORDER BY level, node) AS steps FROM gaps g JOIN nodes n ON g.skill = n.skill WHERE gap IN ('LEARN', 'LEVEL_GAP') AND NOT EXISTS (SELECT 1 FROM owned o WHERE o.candidate = g.candidate AND o.point = n.node) GROUP BY ALL)
SELECT g.candidate, g.skill, CASE WHEN gap = 'SATISFIED' THEN 'NONE' WHEN gap = 'EVIDENCE_INSUFFICIENT' THEN 'VERIFY_FIRST' WHEN g.skill NOT IN (SELECT skill FROM nodes) THEN 'GRAPH_UNAVAILABLE' ELSE 'PLANNED' END AS status, coalesce(s.steps, '') AS steps FROM gaps g LEFT JOIN s ON g.candidate = s.candidate AND g.skill = s.skill""")
def path_plan(spark, sf_dir):
    part = load(spark, sf_dir, "part").where("p_size <= 5").groupBy(F.col("p_brand").alias("skill"), F.col("p_name").alias("node")).agg(F.min("p_size").alias("level"))
    nodes = part.withColumn("n", F.count("*").over(Window.partitionBy("skill"))).where("n >= 2").drop("n")
    achieved = _owned(spark, sf_dir).select("candidate", F.col("point").alias("node"))
    return learning.path_plan(_gaps(spark, sf_dir).select("candidate", "skill", "gap"), nodes, achieved).withColumn("steps", F.array_join("steps", ";"))


@query("subskill_resolve", """WITH a AS (SELECT p_brand AS skill, list(DISTINCT split_part(p_name, ' ', 2)) FILTER (p_size > 40) AS points FROM part GROUP BY 1),
t AS (SELECT p_brand AS skill, split_part(p_name, ' ', 2) AS term, min(p_size) AS pos FROM part WHERE p_size <= 12 GROUP BY ALL), h AS (SELECT a.skill, first(lower(term) ORDER BY pos, lower(term)) AS term FROM a JOIN t ON a.skill = t.skill AND list_contains(list_transform(points, lambda x: lower(x)), lower(term)) GROUP BY 1)
SELECT a.skill, CASE WHEN coalesce(len(points), 0) = 0 THEN 'NO_SKILL_POINTS' WHEN a.skill NOT IN (SELECT skill FROM t) THEN 'NO_GRAPH' WHEN h.term IS NOT NULL THEN 'MATCHED' ELSE 'NO_MATCH' END AS status, h.term FROM a LEFT JOIN h ON a.skill = h.skill""")
def subskill_resolve(spark, sf_dir):
    part = load(spark, sf_dir, "part").select(F.col("p_brand").alias("skill"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("term"), "p_size")
    asked = part.groupBy("skill").agg(F.collect_set(F.when(F.col("p_size") > 40, F.col("term"))).alias("points"))
    return learning.resolve_terms(asked, part.where("p_size <= 12").groupBy("skill", "term").agg(F.min("p_size").alias("pos")))


# a supplier with a balance below 4000 is retired in favour of the next one of its nation
_RETIRED = "r AS (SELECT id, target FROM (SELECT s_suppkey AS id, s_acctbal, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS target FROM supplier) WHERE s_acctbal < 4000 AND target IS NOT NULL)"


@query("transitive_remap", f"WITH RECURSIVE {_RETIRED}, w AS (SELECT id, target FROM r UNION SELECT w.id, r.target FROM w JOIN r ON w.target = r.id) SELECT id, target FROM w WHERE target NOT IN (SELECT id FROM r)")
def transitive_remap(spark, sf_dir):
    later = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_acctbal", F.lead("s_suppkey").over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("target"))
    return learning.remap(later.where("s_acctbal < 4000 AND target IS NOT NULL"))


@query("near_names", """WITH n AS (SELECT DISTINCT p_name AS name FROM part), c AS (SELECT name, list_distinct(string_split(name, '')) AS cs FROM n),
p AS (SELECT a.name, b.name AS near, len(list_intersect(a.cs, b.cs))::DOUBLE / greatest(len(a.cs), len(b.cs)) AS share, list_max([list_max([CASE WHEN contains(b.name, substr(a.name, i, n)) THEN n ELSE 0 END FOR n IN range(1, length(a.name) - i + 2)]) FOR i IN range(1, length(a.name) + 1)]) AS lcs FROM c a JOIN c b ON a.name <> b.name),
s AS (SELECT name, near, round(greatest(share, lcs / 8::DOUBLE), 3) AS score FROM p WHERE share >= 0.5 OR lcs >= 4)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, near) AS rank FROM s) WHERE rank <= 2""")
def near_names(spark, sf_dir):
    return learning.near_names(load(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct())


@query("soft_prf")
def soft_prf(spark, sf_dir):
    """Hits and misses of the parts named in an order's small lines against those of all its lines, a name within another counting; matching is
    one to one in order, which SQL has no form for, so it is tested by hand-made lists."""
    lines = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    said = F.when(F.col("l_quantity") < 30, F.when(F.col("p_size") % 3 == 0, F.substring_index("p_name", " ", -1)).otherwise(F.upper("p_name")))
    rows = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(said)).alias("predicted"), F.array_sort(F.collect_set("p_name")).alias("gold"))
    return learning.soft_prf(rows, "predicted", "gold")


@query("sentence_lookup", """WITH s AS (SELECT conv_id, turn, text, strpos(text, ' the ') AS pos, string_split(text, '.') AS parts FROM conversations)
SELECT conv_id, turn, pos, CASE WHEN pos > 0 THEN len(list_filter(range(1, len(parts) + 1), lambda i: coalesce(list_sum(list_transform(parts[1:i - 1], lambda p: length(p) + 1)), 0) + 1 <= pos)) END AS sentence FROM s""")
def sentence_lookup(spark, sf_dir):
    """The sentence (up to the next full stop) in which a position falls: the number of sentences that start there or before."""
    parts = F.split("text", r"\.")
    starts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.aggregate(F.slice(parts, F.lit(1), i - 1), F.lit(1), lambda s, p: s + F.length(p) + 1))
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.instr("text", " the ").alias("pos"), starts.alias("starts"))
    return rows.select("conv_id", "turn", "pos", F.when(F.col("pos") > 0, F.size(F.filter("starts", lambda s: s <= F.col("pos")))).alias("sentence"))


_BAND = "CASE WHEN q <= 15 THEN 'P1' WHEN q <= 28 THEN 'P2' WHEN q <= 42 THEN 'P3' ELSE 'P4' END"


@query("point_bands", f"WITH f AS (SELECT o_orderkey AS doc, p_brand AS skill, p_name AS point, l_quantity AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey), b AS (SELECT doc, skill, {_BAND} AS band FROM (SELECT doc, skill, max(quantity) AS q FROM f GROUP BY ALL)), p AS (SELECT DISTINCT doc, skill, point FROM f) SELECT point, count(*) AS n, " + ", ".join(f"count(*) FILTER (band = 'P{k}') AS P{k}" for k in range(1, 5)) + " FROM p JOIN b USING (doc, skill) GROUP BY point HAVING count(*) >= 20")
def point_bands(spark, sf_dir):
    """Points take the band of their skill in the same document; points of fewer than 20 documents are left out."""
    rows = facts(spark, sf_dir).where("skill IS NOT NULL").groupBy("doc", "skill").agg(F.max("quantity").alias("q"), F.collect_set("point").alias("points"))
    banded = rows.select(F.explode("points").alias("point"), F.expr(_BAND).alias("band"))
    return banded.groupBy("point").agg(F.count("*").alias("n"), *[F.count_if(F.col("band") == f"P{k}").alias(f"P{k}") for k in range(1, 5)]).where("n >= 20")


_MIX = "round(base_weight / t, 6) AS jd, round(d / t, 6) AS overlay, round(CASE WHEN base_weight > 0 THEN least(0.98::DOUBLE, 0.62::DOUBLE + sqrt(base_weight) * 0.36::DOUBLE) ELSE 0.55::DOUBLE END, 6) AS confidence, CASE WHEN base_weight <= 0 THEN 'candidate' WHEN d > 1e-6 THEN 'strengthening' ELSE 'active' END AS status"


@query("edge_source_mix", f"""WITH {freq_sql(True)}, e AS (SELECT p.month, p.src, p.dst, round_even(p.w / n.w, 4) AS weight FROM freq p JOIN freq n ON p.month = n.month AND p.src = n.src AND n.kind = 'job' WHERE p.kind = 'job_skill'),
m AS (SELECT coalesce(b.src, f.src) AS src, coalesce(b.dst, f.dst) AS dst, coalesce(b.weight, 0) AS base_weight, coalesce(f.weight, b.weight) AS effective_weight FROM (FROM e WHERE month = '1995-01') b FULL JOIN (FROM e WHERE month = '1995-02') f ON b.src = f.src AND b.dst = f.dst),
x AS (SELECT *, greatest(0, effective_weight - base_weight) AS d FROM m), y AS (SELECT *, CASE WHEN base_weight + d = 0 THEN 1 ELSE base_weight + d END AS t FROM x) SELECT src, dst, {_MIX} FROM y""")
def edge_source_mix(spark, sf_dir):
    return full_outer_base_effective(spark, sf_dir).select("src", "dst", learning.source_mix(F.col("base_weight"), F.col("effective_weight")).alias("m")).select("src", "dst", "m.*")


@query("seeded_bands", """WITH u AS (SELECT p_partkey, CAST('0x' || substr(md5(p_partkey::VARCHAR || '|deg'), 1, 12) AS BIGINT) / 281474976710656::DOUBLE AS u FROM part)
SELECT p_partkey, round(u, 9) AS u, CASE WHEN u < 0.25 THEN 0 WHEN u < 0.6 THEN 1 WHEN u < 0.9 THEN 2 ELSE 3 END::INT AS band FROM u""")
def seeded_bands(spark, sf_dir):
    u = learning.uniform(F.concat(F.col("p_partkey").cast("string"), F.lit("|deg")))
    rows = load(spark, sf_dir, "part").select("p_partkey", u.alias("u"))
    return rows.select("p_partkey", F.round("u", 9).alias("u"), learning.band(F.col("u"), [F.lit(0.25), F.lit(0.35), F.lit(0.3), F.lit(0.1)]).alias("band"))


@query("month_spans", """WITH s AS (SELECT o_custkey AS candidate, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1)
SELECT candidate, ((CASE WHEN strftime(b, '%Y') >= '2001' THEN 2001 * 12 + 9 ELSE year(b) * 12 + month(b) END) - (year(a) * 12 + month(a)) + 1)::INT AS months FROM s""")
def month_spans(spark, sf_dir):
    """Spans of months from texts like `1995.03-至今`; orders of the last year are open ends."""
    spans = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("candidate")).agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    text = F.concat(F.date_format("a", "yyyy.MM"), F.lit("-"), F.when(F.year("b") >= 2001, "至今").otherwise(F.date_format("b", "yyyy/MM")))
    return spans.select("candidate", learning.month_span(text, F.lit("2001.09")).alias("months"))


@query("dormancy", "WITH w AS (SELECT user_id, date_trunc('day', ts) AS day, sum(coalesce(value, 0)) / 200.0::DOUBLE AS strength FROM events GROUP BY ALL) SELECT user_id, strftime(day, '%Y-%m-%d') AS day, CASE WHEN strength < 0.15::DOUBLE THEN 'dormant' WHEN lag(strength < 0.15::DOUBLE) OVER (PARTITION BY user_id ORDER BY day) THEN 'revived' ELSE 'active' END AS state FROM w")
def dormancy(spark, sf_dir):
    daily = load(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg((F.sum(F.coalesce("value", F.lit(0.0))) / 200).alias("strength"))
    return learning.dormancy(daily, "user_id", "day", "strength").drop("strength")


@query("promotion_effective", """WITH m AS (SELECT p_brand AS skill, strftime(o_orderdate, '%Y-%m') AS month, count(DISTINCT o_orderkey) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY skill ORDER BY month) AS up FROM m) SELECT skill, min(month) AS decided, strftime(strptime(min(month) || '-01', '%Y-%m-%d') + INTERVAL 1 MONTH, '%Y-%m') AS effective FROM c WHERE up >= 50 GROUP BY skill""")
def promotion_effective(spark, sf_dir):
    """A skill is decided on in the month in which it reaches 50 documents, and takes effect in the month after."""
    monthly = facts(spark, sf_dir).where("skill IS NOT NULL").groupBy("skill", "month").agg(F.countDistinct("doc").alias("n"))
    up = F.sum("n").over(Window.partitionBy("skill").orderBy("month"))
    decided = monthly.withColumn("up", up).where("up >= 50").groupBy("skill").agg(F.min("month").alias("decided"))
    return decided.withColumn("effective", F.date_format(F.add_months(F.to_date(F.concat("decided", F.lit("-01"))), 1), "yyyy-MM"))


@query("calendar_holes", """WITH o AS (SELECT DISTINCT c_nationkey AS nation, strftime(o_orderdate, '%Y-%m') AS month FROM orders JOIN customer ON o_custkey = c_custkey), k AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS pos FROM (SELECT DISTINCT month FROM o)),
e AS (SELECT n.nation, k.pos, o.month IS NOT NULL AS has FROM (SELECT DISTINCT nation FROM o) n CROSS JOIN k LEFT JOIN o ON o.nation = n.nation AND o.month = k.month) SELECT nation, count(*) FILTER (NOT has) AS holes, coalesce(min(pos) FILTER (NOT has), count(*))::BIGINT AS prefix FROM e GROUP BY nation""")
def calendar_holes(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    seen = settle(orders.join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("nation"), "month").distinct())
    return learning.calendar_holes(seen, seen.select("month").distinct(), "nation", "month")


@query("confirmed_at_cursor", "SELECT event_type, count(*) FILTER (ts <= TIMESTAMP '2024-01-15 00:00:00' AND value IS NOT NULL) AS confirmed FROM events GROUP BY 1")
def confirmed_at_cursor(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if((F.col("ts") <= F.lit("2024-01-15 00:00:00").cast(load(spark, sf_dir, "events").schema["ts"].dataType)) & F.col("value").isNotNull()).alias("confirmed"))


@query("born_and_noise", """WITH s AS (SELECT p_partkey AS part, c_mktsegment AS job, strftime(min(o_orderdate), '%Y-%m') AS born, count(*) AS n_evidence, count(*) / 3000.0::DOUBLE AS strength FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT part, job, born, n_evidence FROM s WHERE born <= '1997-12' AND NOT (strength < 0.05::DOUBLE AND n_evidence <= 1)""")
def born_and_noise(spark, sf_dir):
    """Parts as items of each segment: those born after the window are dropped, and those of next to no strength with a single piece of evidence."""
    sold = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(load(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(load(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = sold.groupBy(F.col("p_partkey").alias("part"), F.col("c_mktsegment").alias("job")).agg(F.date_format(F.min("o_orderdate"), "yyyy-MM").alias("born"), F.count("*").alias("n_evidence"))
    return rows.where("born <= '1997-12' AND NOT (n_evidence / 3000D < 0.05D AND n_evidence <= 1)")


@query("excluded_titles", "SELECT p_partkey, p_name FROM part WHERE NOT regexp_matches(p_name, 'red|old|big')")
def excluded_titles(spark, sf_dir):
    return load(spark, sf_dir, "part").where(~F.col("p_name").rlike("red|old|big")).select("p_partkey", "p_name")


@query("no_signal", "SELECT conv_id, turn, NOT (contains(text, '?') OR contains(text, 'the') OR regexp_matches(text, '[0-9]')) AS demoted FROM conversations")
def no_signal(spark, sf_dir):
    """Rows whose three arrays of signals are all empty lose their flag."""
    signals = [F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in (r"\?", "the", "[0-9]")]
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", (sum((F.size(s) for s in signals), F.lit(0)) == 0).alias("demoted"))


@query("kind_recheck", "SELECT p_partkey, p_name, first_value(p_type) OVER (PARTITION BY lower(replace(p_name, ' ', '')) ORDER BY p_partkey) AS kind FROM part")
def kind_recheck(spark, sf_dir):
    """Items of one normalised name take the kind of the first of them, which is found by counting, not by ordering a name's items."""
    parts = load(spark, sf_dir, "part").withColumn("norm", F.lower(F.replace("p_name", F.lit(" "), F.lit(""))))
    first = parts.groupBy("norm").agg(F.min_by("p_type", "p_partkey").alias("kind"))
    return parts.join(first, "norm").select("p_partkey", "p_name", "kind")


@query("level_restriction", f"WITH {_GAPS} SELECT candidate, skill, observed FROM gaps WHERE requirement = 'EXPLICIT_LEVEL' AND observed IS NOT NULL")
def level_restriction(spark, sf_dir):
    """Levels of a candidate count only for skills with an explicit level."""
    return _gaps(spark, sf_dir).where("requirement = 'EXPLICIT_LEVEL' AND observed IS NOT NULL").select("candidate", "skill", "observed")


@query("params_hash", "SELECT p_brand, substr(sha256('{' || string_agg('\"' || k || '\":' || v, ',' ORDER BY k) || '}'), 1, 16) AS hash FROM (SELECT p_brand, p_name AS k, count(*)::VARCHAR AS v FROM part GROUP BY ALL) GROUP BY p_brand")
def params_hash(spark, sf_dir):
    """Fingerprint of a map of parameters: canonical JSON with sorted keys, SHA-256, 16 digits."""
    counts = load(spark, sf_dir, "part").groupBy("p_brand", F.col("p_name").alias("k")).agg(F.count("*").alias("v"))
    canonical = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))))
    return counts.groupBy("p_brand").agg(F.substring(F.sha2(canonical, 256), 1, 16).alias("hash"))
