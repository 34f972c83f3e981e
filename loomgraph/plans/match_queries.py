"""Statistics and matching: segments are jobs, customers are candidates, brands are skills, quantities stand for levels."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from loomgraph.operators import matching, stats
from loomgraph.operators.order_stats import values_at
from loomgraph.plans.graph_queries import FACTS, facts
from loomgraph.plans.registry import registry
from loomgraph.sources.interim import dealt
from loomgraph.sources.tables import load

QUERIES, ORACLES, query = registry()


def _orders(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice", F.year("o_orderdate").alias("year"))
    return orders.join(load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))


_ORDERS = "o AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus, o_totalprice, year(o_orderdate) AS year, c_mktsegment, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey)"


@query("share_norm", f"WITH {_ORDERS}, c AS (SELECT c_mktsegment, o_orderpriority, count(*) AS n FROM o GROUP BY ALL) SELECT *, round(n::DOUBLE / sum(n) OVER (PARTITION BY c_mktsegment), 6) AS share FROM c")
def share_norm(spark, sf_dir):
    counts = _orders(spark, sf_dir).groupBy("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"))
    return stats.shares(counts, ["c_mktsegment"], "n")


@query("multi_label_share", "SELECT label, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM part), 6) AS share FROM (SELECT unnest(list_distinct(string_split(p_name, ' '))) AS label FROM part) GROUP BY label")
def multi_label_share(spark, sf_dir):
    return stats.multi_label_share(load(spark, sf_dir, "part"), F.split("p_name", " "))


@query("stats_grouping_sets", f"WITH {_ORDERS} SELECT c_mktsegment, year, count(*) AS n, floor(quantile_cont(o_totalprice, 0.5))::BIGINT AS median, count(DISTINCT o_custkey) AS customers, grouping_id(c_mktsegment, year) AS g FROM o GROUP BY GROUPING SETS ((c_mktsegment, year), (c_mktsegment), (year), ())")
def stats_grouping_sets(spark, sf_dir):
    rows = _orders(spark, sf_dir).select("c_mktsegment", "year", "o_custkey", "o_totalprice")
    none = lambda kind: F.lit(None).cast(kind)
    grouped = [("c_mktsegment", "year", 0), ("c_mktsegment", None, 1), (None, "year", 2), (None, None, 3)]
    sets = F.array(*[F.struct((F.col(a) if a else none("string")).alias("c_mktsegment"), (F.col(b) if b else none("int")).alias("year"), F.lit(g).alias("g")) for a, b, g in grouped])
    each = rows.select(F.explode(sets).alias("s"), "o_custkey", "o_totalprice").select("s.*", "o_custkey", "o_totalprice")
    by = ["c_mktsegment", "year", "g"]
    middle = values_at(each, "o_totalprice", by, {"low": F.floor((F.col("n") - 1) / 2), "high": F.floor(F.col("n") / 2)})
    # one row per group and customer first, so that no task counts all customers of a group
    customers = each.select(*by, "o_custkey").distinct().groupBy(*by).agg(F.count("o_custkey").alias("customers"))
    same = [middle[c].eqNullSafe(customers[c]) for c in by]
    median = F.floor(F.col("low") + (F.col("high") - F.col("low")) / 2).cast("long")
    return middle.join(customers, same).select(middle.c_mktsegment, middle.year, "n", median.alias("median"), "customers", middle.g)


@query("rollup_totals", f"WITH {_ORDERS} SELECT c_mktsegment, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM o GROUP BY ROLLUP (c_mktsegment, o_orderstatus)")
def rollup_totals(spark, sf_dir):
    return _orders(spark, sf_dir).rollup("c_mktsegment", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("cube_counts", f"WITH {_ORDERS} SELECT o_orderpriority, o_orderstatus, count(*) AS n, grouping_id(o_orderpriority, o_orderstatus)::INT AS g FROM o GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def cube_counts(spark, sf_dir):
    return _orders(spark, sf_dir).cube("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("g"))


@query("tail_trim", "WITH c AS (SELECT p_name, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity < p_size GROUP BY p_name), k AS (SELECT *, n >= 0.5 * max(n) OVER () AS keep FROM c) SELECT p_name, n, (SELECT count(*) FILTER (NOT keep) FROM k) AS trimmed FROM k WHERE keep")
def tail_trim(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity")
    part = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    counts = lines.join(part, (F.col("l_partkey") == F.col("p_partkey")) & (F.col("l_quantity") < F.col("p_size"))).groupBy("p_name").agg(F.count("*").alias("n"))
    return stats.tail_trim(counts, "n", 0.5)


@query("demand_overview", f"WITH {_ORDERS}, d AS (SELECT c_nationkey, sum(CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 ELSE 1 END) AS demand FROM o GROUP BY 1) SELECT n_name, r_name, demand::BIGINT AS demand, round(demand::DOUBLE / max(demand) OVER (), 6) AS share, sum(demand) OVER (PARTITION BY r_name)::BIGINT AS group_demand FROM d JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def demand_overview(spark, sf_dir):
    weight = F.when(F.col("o_orderpriority") == "1-URGENT", 3).when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(1)
    demand = _orders(spark, sf_dir).groupBy("c_nationkey").agg(F.sum(weight).alias("demand"))
    named = demand.join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    peak = demand.agg(F.max("demand").alias("peak"))
    return named.join(F.broadcast(peak)).select("n_name", "r_name", "demand", F.round(F.col("demand") / F.col("peak"), 6).alias("share"), F.sum("demand").over(Window.partitionBy("r_name")).alias("group_demand"))


@query("attr_salary_product", f"""WITH {_ORDERS}, p AS (SELECT c_mktsegment AS job, count(*) AS posts FROM o GROUP BY 1), a AS (SELECT c_mktsegment AS job, o_orderpriority AS a, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY c_mktsegment) AS sa FROM o GROUP BY 1, 2),
b AS (SELECT c_mktsegment AS job, CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 300000 THEN 'mid' ELSE 'high' END AS b, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY c_mktsegment) AS sb FROM o GROUP BY 1, 2)
SELECT job, a, b, round(posts * sa * sb, 4) AS n FROM p JOIN a USING (job) JOIN b USING (job)""")
def attr_salary_product(spark, sf_dir):
    rows = _orders(spark, sf_dir).withColumnRenamed("c_mktsegment", "job")
    band = F.when(F.col("o_totalprice") < 100000, "low").when(F.col("o_totalprice") < 300000, "mid").otherwise("high")
    of_job = Window.partitionBy("job")
    a = rows.groupBy("job", F.col("o_orderpriority").alias("a")).count().withColumn("posts", F.sum("count").over(of_job)).select("job", "a", "posts", (F.col("count") / F.col("posts")).alias("share_a"))
    b = rows.groupBy("job", band.alias("b")).count().select("job", "b", (F.col("count") / F.sum("count").over(of_job)).alias("share_b"))
    return stats.attribute_product(a, b, "job").withColumn("n", F.round("n", 4))


_DIST = f"""{_ORDERS}, d AS (SELECT c_nationkey AS entity, 'priority' AS attr, o_orderpriority AS bucket, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY c_nationkey) AS share FROM o GROUP BY 1, 3
  UNION ALL SELECT c_nationkey, 'status', o_orderstatus, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY c_nationkey) FROM o GROUP BY 1, 3)"""


@query("facet_bias_filter", f"WITH {_DIST}, s AS (SELECT attr, count(DISTINCT bucket) AS size FROM d GROUP BY attr), g AS (SELECT entity, attr, sum(share) FILTER ((attr = 'priority' AND bucket IN ('1-URGENT', '2-HIGH')) OR (attr = 'status' AND bucket = 'F')) AS got, CASE attr WHEN 'priority' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END / any_value(size) AS need FROM d JOIN s USING (attr) GROUP BY entity, attr) SELECT entity FROM g GROUP BY entity HAVING count(*) FILTER (coalesce(got, 0) >= need - 1e-12::DOUBLE) = 2")
def facet_bias_filter(spark, sf_dir):
    rows = _orders(spark, sf_dir).withColumnRenamed("c_nationkey", "entity")
    part = lambda attr, column: rows.groupBy("entity", F.lit(attr).alias("attr"), F.col(column).alias("bucket")).count()
    both = part("priority", "o_orderpriority").unionByName(part("status", "o_orderstatus"))
    shares = both.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy("entity", "attr")))
    return stats.facet_filter(shares, "entity", {"priority": ["1-URGENT", "2-HIGH"], "status": ["F"]})


_RANK = "CASE WHEN quantity <= 5 THEN NULL WHEN quantity <= 15 THEN 1 WHEN quantity <= 28 THEN 2 WHEN quantity <= 42 THEN 3 ELSE 4 END"
_JOBS = f"""{FACTS}, docs AS (SELECT job, count(DISTINCT doc) AS total FROM facts GROUP BY job), pres AS (SELECT job, skill, count(DISTINCT doc) AS n FROM facts WHERE skill IS NOT NULL GROUP BY ALL),
lv AS (SELECT job, skill, {_RANK} AS rank, count(*) AS c FROM facts WHERE skill IS NOT NULL GROUP BY ALL), g AS (SELECT job, skill, sum(c) AS graded, sum(c) AS x FROM lv WHERE rank IS NOT NULL GROUP BY ALL),
run AS (SELECT job, skill, rank, sum(c) OVER (PARTITION BY job, skill ORDER BY rank) AS up, sum(c) OVER (PARTITION BY job, skill) AS total FROM lv WHERE rank IS NOT NULL), med AS (SELECT job, skill, min(rank) AS median FROM run WHERE up >= floor((total + 1) / 2) GROUP BY ALL),
req AS (SELECT pres.job, pres.skill, round(n::DOUBLE / total, 6) AS presence, coalesce(graded, 0)::BIGINT AS graded, CASE WHEN coalesce(graded::DOUBLE / n, 0) >= 0.5 THEN median END AS median, CASE WHEN coalesce(graded::DOUBLE / n, 0) >= 0.5 THEN 'EXPLICIT_LEVEL' ELSE 'LEVEL_UNSPECIFIED' END AS requirement
  FROM pres JOIN docs USING (job) LEFT JOIN g USING (job, skill) LEFT JOIN med USING (job, skill) WHERE n::DOUBLE / total >= 0.1)"""


#: Lines of a task that tells the documents of a skill apart: some 150 MB.
LINES = 1 << 19


def _requirements(spark, sf_dir):
    rows = facts(spark, sf_dir, LINES)
    total = rows.groupBy("job").agg(F.countDistinct("doc").alias("total"))
    named = rows.where("skill IS NOT NULL")
    presence = named.groupBy("job", "skill").agg(F.countDistinct("doc").alias("n")).join(total, "job").withColumn("presence", F.col("n") / F.col("total"))
    by_level = named.groupBy("job", "skill", F.expr(_RANK).alias("rank")).agg(F.count("*").alias("c")).where("rank IS NOT NULL")
    medians = matching.lower_median_rank(by_level, ["job", "skill"], "rank", "c")
    graded = by_level.groupBy("job", "skill").agg(F.sum("c").alias("graded")).join(medians, ["job", "skill"])
    return matching.requirement_profile(presence, graded).withColumn("presence", F.round("presence", 6))


@query("requirement_profile", f"WITH {_JOBS} SELECT * FROM req")
def requirement_profile(spark, sf_dir):
    return _requirements(spark, sf_dir)


@query("ordinal_lower_median", f"WITH {_JOBS} SELECT job, skill, median FROM med")
def ordinal_lower_median(spark, sf_dir):
    named = facts(spark, sf_dir).where("skill IS NOT NULL")
    by_level = named.groupBy("job", "skill", F.expr(_RANK).alias("rank")).agg(F.count("*").alias("c")).where("rank IS NOT NULL")
    return matching.lower_median_rank(by_level, ["job", "skill"], "rank", "c")


@query("must_plus_def", f"WITH {_JOBS}, r AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY presence DESC, skill) AS k FROM req) SELECT job, skill, presence, k, CASE WHEN presence >= 0.13 AND k <= 8 THEN 'must' WHEN presence >= 0.11 AND k <= 13 THEN 'plus' ELSE 'other' END AS kind FROM r")
def must_plus_def(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("job").orderBy(F.desc("presence"), "skill"))
    rows = _requirements(spark, sf_dir).withColumn("k", k)
    kind = F.when((F.col("presence") >= 0.13) & (F.col("k") <= 8), "must").when((F.col("presence") >= 0.11) & (F.col("k") <= 13), "plus").otherwise("other")
    return rows.select("job", "skill", "presence", "k", kind.alias("kind"))


_CANDIDATES = """cand AS (SELECT o_custkey AS candidate, p_brand AS skill, max(CASE WHEN l_quantity <= 5 THEN NULL WHEN l_quantity <= 15 THEN 1 WHEN l_quantity <= 28 THEN 2 WHEN l_quantity <= 42 THEN 3 ELSE 4 END) AS observed, bool_or(l_returnflag <> 'R') AS verified, count(*) > 3 AND max(l_linestatus) = 'O' AS unknown
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
_GAPS = f"""{_JOBS}, {_CANDIDATES}, who AS (SELECT DISTINCT candidate, c_mktsegment AS job FROM cand JOIN customer ON candidate = c_custkey),
gaps AS (SELECT w.candidate, r.job, r.skill, r.requirement, r.median, observed, CASE WHEN c.skill IS NULL THEN 'LEARN' WHEN NOT verified OR unknown THEN 'EVIDENCE_INSUFFICIENT' WHEN median IS NULL THEN 'SATISFIED' WHEN observed IS NULL THEN 'EVIDENCE_INSUFFICIENT' WHEN observed < median THEN 'LEVEL_GAP' ELSE 'SATISFIED' END AS gap
  FROM who w JOIN req r ON w.job = r.job LEFT JOIN cand c ON c.candidate = w.candidate AND c.skill = r.skill)"""


def _gaps(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("candidate"))
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_quantity").alias("quantity"), "l_returnflag", "l_linestatus")
    part = load(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("skill"))
    held = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    skills = dealt(held.select("candidate", "skill", "quantity", "l_returnflag", "l_linestatus"), "candidate").groupBy("candidate", "skill").agg(F.max(F.expr(_RANK)).alias("observed"), F.bool_or(F.col("l_returnflag") != "R").alias("verified"), ((F.count("*") > 3) & (F.max("l_linestatus") == "O")).alias("unknown"))
    jobs = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("candidate"), F.col("c_mktsegment").alias("job"))
    # a candidate's skills are one row, as many as the taxonomy has at most: what is asked of all candidates is looked up in it, not joined
    found = F.struct("skill", F.struct("observed", "verified", "unknown").alias("had"))
    who = skills.groupBy("candidate").agg(F.map_from_entries(F.collect_list(F.when(F.col("skill").isNotNull(), found))).alias("skills")).join(jobs, "candidate")
    asked = who.join(F.broadcast(_requirements(spark, sf_dir)), "job").withColumn("had", F.col("skills")[F.col("skill")])
    joined = asked.select("*", "had.*", F.when(F.col("had").isNotNull(), True).alias("held")).drop("skills", "had")
    gap = matching.gap_type(F.col("observed"), F.col("verified"), F.col("unknown"), F.col("held"), F.col("median"))
    return joined.withColumn("gap", gap)


@query("gap_typing", f"WITH {_GAPS} SELECT candidate, job, skill, gap FROM gaps")
def gap_typing(spark, sf_dir):
    return _gaps(spark, sf_dir).select("candidate", "job", "skill", "gap")


_R = lambda k: f"round(count(*) FILTER (gap = '{k}')::DOUBLE / count(*), 6)"


@query("match_score", f"WITH {_GAPS} SELECT candidate, job, count(*) AS n, {_R('SATISFIED')} AS satisfied_rate, {_R('LEVEL_GAP')} AS level_gap_rate, {_R('EVIDENCE_INSUFFICIENT')} AS uncertainty_rate, {_R('LEARN')} AS missing_rate, round(100 * count(*) FILTER (gap = 'SATISFIED')::DOUBLE / count(*), 2) AS score, CASE WHEN {_R('SATISFIED')} >= 0.380952 THEN 'MATCH' ELSE 'NO_MATCH' END AS decision FROM gaps GROUP BY ALL")
def match_score(spark, sf_dir):
    return matching.match_scores(_gaps(spark, sf_dir), ["candidate", "job"], 0.380952)


@query("priority_rank", f"WITH {_GAPS} SELECT candidate, job, skill, gap, row_number() OVER (PARTITION BY candidate, job ORDER BY CASE requirement WHEN 'EXPLICIT_LEVEL' THEN 0 ELSE 1 END, CASE gap WHEN 'LEARN' THEN 0 WHEN 'LEVEL_GAP' THEN 1 ELSE 2 END, presence DESC, skill) AS priority FROM gaps JOIN (SELECT job, skill, presence FROM req) USING (job, skill) WHERE gap <> 'SATISFIED'")
def priority_rank(spark, sf_dir):
    return matching.priorities(_gaps(spark, sf_dir), ["candidate", "job"], "requirement", "presence", "skill").select("candidate", "job", "skill", "gap", "priority")


# nations need regions; suppliers need their nation and the first supplier of it
_EDGES = "e AS (SELECT 'n' || n_nationkey AS id, 'r' || n_regionkey AS needs FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 's' || s_suppkey, 's' || f FROM (SELECT s_suppkey, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS f FROM supplier) WHERE f <> s_suppkey)"


def _dag(spark, sf_dir):
    named = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string"))
    nation, supplier = load(spark, sf_dir, "nation"), load(spark, sf_dir, "supplier")
    first = supplier.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("f"))
    edges = nation.select(named("n", "n_nationkey").alias("id"), named("r", "n_regionkey").alias("needs"))
    edges = edges.unionByName(supplier.select(named("s", "s_suppkey").alias("id"), named("n", "s_nationkey").alias("needs")))
    later = supplier.join(first, "s_nationkey").where("f <> s_suppkey")
    return edges.unionByName(later.select(named("s", "s_suppkey").alias("id"), named("s", "f").alias("needs")))


@query("dag_topo", f"WITH RECURSIVE {_EDGES}, l AS (SELECT id, 0 AS level FROM (SELECT needs AS id FROM e EXCEPT SELECT id FROM e) UNION SELECT e.id, l.level + 1 FROM e JOIN l ON e.needs = l.id) SELECT id, max(level) AS level FROM l GROUP BY id")
def dag_topo(spark, sf_dir):
    edges = _dag(spark, sf_dir)
    nodes = edges.select(F.explode(F.array("id", "needs")).alias("id")).distinct()
    return matching.levels(nodes, edges)


@query("prereq_closure", f"WITH RECURSIVE {_EDGES}, c AS (SELECT id AS goal, id FROM (SELECT DISTINCT id FROM e) UNION SELECT c.goal, e.needs FROM c JOIN e ON e.id = c.id) SELECT goal, id FROM c")
def prereq_closure(spark, sf_dir):
    edges = _dag(spark, sf_dir)
    return matching.prerequisite_closure(edges, edges.select("id").distinct())


@query("micro_prf", """WITH r AS (SELECT doc_id, list_filter([CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS gold, list_filter([CASE WHEN n_chars > 400 THEN 'good' END, CASE WHEN contains(text, '!!') THEN 'toxic' END], lambda x: x IS NOT NULL) AS pred FROM labels JOIN documents USING (doc_id)),
s AS (SELECT sum(len(list_intersect(pred, gold)))::BIGINT AS tp, sum(len(pred) - len(list_intersect(pred, gold)))::BIGINT AS fp, sum(len(gold) - len(list_intersect(pred, gold)))::BIGINT AS fn FROM r)
SELECT tp, fp, fn, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / (tp + fn), 6) AS recall, round(2 * (tp::DOUBLE / (tp + fp)) * (tp::DOUBLE / (tp + fn)) / ((tp::DOUBLE / (tp + fp)) + (tp::DOUBLE / (tp + fn))), 6) AS f1 FROM s""")
def micro_prf(spark, sf_dir):
    rows = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), "doc_id")
    gold = F.array_compact(F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic")))
    pred = F.array_compact(F.array(F.when(F.col("n_chars") > 400, "good"), F.when(F.col("text").contains("!!"), "toxic")))
    found = matching.micro_prf(rows.select(gold.alias("gold"), pred.alias("pred")), "pred", "gold")
    return found.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("concept_metric", "WITH r AS (SELECT source, quality = 1 AS gold, n_chars > 400 AS pred FROM labels JOIN documents USING (doc_id)) SELECT source, count(*) FILTER (gold AND pred) AS tp, count(*) FILTER (pred AND NOT gold) AS fp, count(*) FILTER (gold AND NOT pred) AS fn, CASE WHEN count(*) FILTER (gold) > 0 THEN round(count(*) FILTER (gold AND pred)::DOUBLE / count(*) FILTER (gold), 6) END AS recall FROM r GROUP BY source")
def concept_metric(spark, sf_dir):
    rows = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id").select("source", (F.col("quality") == 1).alias("gold"), (F.col("n_chars") > 400).alias("pred"))
    gold, pred = F.col("gold"), F.col("pred")
    return rows.groupBy("source").agg(F.count_if(gold & pred).alias("tp"), F.count_if(pred & ~gold).alias("fp"), F.count_if(gold & ~pred).alias("fn"), F.round(F.try_divide(F.count_if(gold & pred), F.count_if(gold)), 6).alias("recall"))


@query("pass_rate", "SELECT lang, count(*) AS n, round(avg((n_chars >= 400)::INT), 6) AS long_rate, round(avg((quality = 1)::INT), 6) AS good_rate, round(avg((n_chars >= 400 AND quality = 1 AND toxic = 0)::INT), 6) AS all_rate FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def pass_rate(spark, sf_dir):
    rows = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    rate = lambda c: F.round(F.avg(F.expr(c).cast("int")), 6)
    return rows.groupBy("lang").agg(F.count("*").alias("n"), rate("n_chars >= 400").alias("long_rate"), rate("quality = 1").alias("good_rate"), rate("n_chars >= 400 AND quality = 1 AND toxic = 0").alias("all_rate"))


@query("source_agreement", "SELECT source, count(*) AS n_docs, count(l.doc_id) AS n_labelled, round(count(l.doc_id)::DOUBLE / count(*), 6) AS overlap FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def source_agreement(spark, sf_dir):
    labels = load(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("labelled"))
    return load(spark, sf_dir, "documents").select("doc_id", "source").join(labels, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n_docs"), F.count("labelled").alias("n_labelled"), F.round(F.count("labelled") / F.count("*"), 6).alias("overlap"))
