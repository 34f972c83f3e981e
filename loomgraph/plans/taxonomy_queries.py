"""Taxonomy maintenance over part names, brands and nations."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from loomgraph.operators import taxonomy
from loomgraph.plans.registry import registry
from loomgraph.sources.tables import load

QUERIES, ORACLES, query = registry()


@query("label_precedence", """WITH k AS (SELECT DISTINCT p_name AS key FROM part), a AS (SELECT DISTINCT p_name AS key FROM part WHERE p_name LIKE 'red%'), b AS (SELECT p_name AS key, max(p_type) AS label FROM part WHERE p_size > 48 GROUP BY 1), f AS (SELECT DISTINCT p_name AS key FROM part WHERE p_name LIKE '%bolt')
SELECT key, CASE WHEN f.key IS NOT NULL THEN 'negative' WHEN a.key IS NOT NULL THEN 'blocked' ELSE coalesce(b.label, 'unknown') END AS label, CASE WHEN f.key IS NOT NULL THEN 'forced' WHEN a.key IS NOT NULL THEN 'blacklist' WHEN b.key IS NOT NULL THEN 'seed' ELSE 'default' END AS layer FROM k LEFT JOIN a USING (key) LEFT JOIN b USING (key) LEFT JOIN f USING (key)""")
def label_precedence(spark, sf_dir):
    part = load(spark, sf_dir, "part").withColumnRenamed("p_name", "key")
    blacklist = part.where("key LIKE 'red%'").select("key", F.lit("blocked").alias("label")).distinct()
    seed = part.where("p_size > 48").groupBy("key").agg(F.max("p_type").alias("label"))
    forced = part.where("key LIKE '%bolt'").select("key").distinct()
    return taxonomy.first_label(part, "key", [("blacklist", blacklist), ("seed", seed)], forced)


@query("rule_merge", """WITH n AS (SELECT DISTINCT p_name || CASE p_size % 3 WHEN 0 THEN ' engineer' WHEN 1 THEN ' (senior)' ELSE ' lead engineer' END AS name FROM part), k AS (SELECT DISTINCT p_name AS name FROM part WHERE p_name NOT LIKE 'blue%'),
c AS (SELECT name, trim(regexp_replace(name, '[(][^)]*[)]', '', 'g')) AS bare FROM n), s AS (SELECT *, CASE WHEN ends_with(bare, ' lead engineer') THEN left(bare, length(bare) - 14) WHEN ends_with(bare, ' engineer') THEN left(bare, length(bare) - 9) END AS cut FROM c)
SELECT s.name, coalesce(a.name, b.name) AS merged FROM s LEFT JOIN k a ON bare = a.name LEFT JOIN k b ON cut = b.name""")
def rule_merge(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    suffix = F.when(F.col("p_size") % 3 == 0, " engineer").when(F.col("p_size") % 3 == 1, " (senior)").otherwise(" lead engineer")
    known = part.where("p_name NOT LIKE 'blue%'").select(F.col("p_name").alias("name")).distinct()
    return taxonomy.rule_merge(part.select(F.concat("p_name", suffix).alias("name")), "name", known, [" engineer", " lead engineer"])


@query("source_inventory", "WITH c AS (SELECT 'orders' AS src, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents) SELECT src, n, round(n::DOUBLE / sum(n) OVER (), 6) AS share FROM c")
def source_inventory(spark, sf_dir):
    counts = None
    for name in ("orders", "lineitem", "events", "documents"):
        part = load(spark, sf_dir, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("src"), "n")
        counts = part if counts is None else counts.unionByName(part)
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("rule_coverage", "WITH d AS (SELECT DISTINCT md5(text) AS k, CASE WHEN text LIKE '%GNU%' THEN 'excluded' WHEN regexp_matches(text, ' (der|les|los) ') THEN 'tier1' WHEN regexp_matches(text, ' (und|par|por|and) ') THEN 'tier2' ELSE 'miss' END AS tier FROM documents) SELECT tier, count(*) AS n FROM d GROUP BY tier")
def rule_coverage(spark, sf_dir):
    text = F.col("text")
    tiers = [("excluded", text.contains("GNU")), ("tier1", F.regexp_like(text, F.lit(" (der|les|los) "))), ("tier2", F.regexp_like(text, F.lit(" (und|par|por|and) ")))]
    return taxonomy.coverage(load(spark, sf_dir, "documents"), F.md5("text"), tiers)


@query("taxonomy_completeness", "WITH n AS (SELECT c_nationkey AS id FROM customer WHERE c_acctbal > 9600), h AS (SELECT s_nationkey AS id FROM supplier WHERE s_acctbal > 9000 UNION SELECT n_nationkey FROM nation WHERE n_regionkey = 1), r AS (SELECT n_nationkey + 10 AS id FROM nation) SELECT 'duplicate' AS problem, id FROM n GROUP BY id HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'unhandled', id FROM n WHERE id NOT IN (FROM h) UNION ALL SELECT DISTINCT 'unknown_reference', id FROM r WHERE id NOT IN (FROM n)")
def taxonomy_completeness(spark, sf_dir):
    nation = load(spark, sf_dir, "nation")
    nodes = load(spark, sf_dir, "customer").where("c_acctbal > 9600").select(F.col("c_nationkey").alias("id"))
    handled = [load(spark, sf_dir, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("id")), nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("id"))]
    return taxonomy.completeness(nodes, handled, nation.select((F.col("n_nationkey") + 10).alias("id")))


@query("consistency_matrix", "SELECT CASE WHEN o_totalprice < 100000 THEN 'L1' WHEN o_totalprice < 300000 THEN 'L2' ELSE 'L3' END AS structured, substr(o_orderpriority, 1, 1) AS told, count(*) AS n FROM orders GROUP BY ALL")
def consistency_matrix(spark, sf_dir):
    level = F.when(F.col("o_totalprice") < 100000, "L1").when(F.col("o_totalprice") < 300000, "L2").otherwise("L3")
    return load(spark, sf_dir, "orders").groupBy(level.alias("structured"), F.substring("o_orderpriority", 1, 1).alias("told")).agg(F.count("*").alias("n"))


@query("interleave_rankings", "WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rn FROM documents WHERE lang IN ('de', 'fr')) SELECT doc_id, lang FROM r WHERE rn <= 30 ORDER BY rn, lang LIMIT 30")
def interleave_rankings(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").where("lang IN ('de', 'fr')").select("doc_id", "lang", "n_chars")
    return taxonomy.interleave(rows, "lang", [F.desc("n_chars"), "doc_id"], 30).select("doc_id", "lang")


@query("interval_overlap", "SELECT a.p_partkey AS a, b.p_partkey AS b, round(greatest(0, least(a.p_size + 10, b.p_size + 20) - greatest(a.p_size, b.p_size))::DOUBLE / 10, 6) AS ratio FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey")
def interval_overlap(spark, sf_dir):
    """All pairs of parts of one name and brand, as many as its SQL has. The ratios are tenths, so that nothing is left to round."""
    return taxonomy.overlapping_pairs(load(spark, sf_dir, "part"), ["p_name", "p_brand"], "p_partkey", "p_size", 10, 20)


@query("level_tilt", "WITH w AS (SELECT p_type AS job, p_brand AS grp, count(*)::DOUBLE AS weight FROM part GROUP BY ALL), x AS (SELECT job, grp, weight * CASE WHEN regexp_extract(grp, '([0-9]+)', 1)::INT % 2 = 0 THEN 0.5::DOUBLE + regexp_extract(grp, '([0-9]+)', 1)::INT / 50.0::DOUBLE ELSE 1 END AS w FROM w) SELECT job, grp, round(w / max(w) OVER (PARTITION BY job), 6) AS weight FROM x")
def level_tilt(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    weights = part.groupBy(F.col("p_type").alias("job"), F.col("p_brand").alias("grp")).agg(F.count("*").cast("double").alias("weight"))
    number = F.regexp_extract("grp", "([0-9]+)", 1).cast("int")
    coefficients = part.select(F.col("p_brand").alias("grp")).distinct().where(number % 2 == 0).withColumn("coefficient", 0.5 + number / 50.0)
    return taxonomy.tilted(weights, coefficients, "job", "grp").select("job", "grp", F.round("weight", 6).alias("weight"))


@query("best_item_per_group", "WITH c AS (SELECT p_type, p_size % 5 AS g, p_name, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_type, g ORDER BY n DESC, p_name) AS r FROM c) SELECT p_type, g, p_name, n FROM r WHERE r = 1")
def best_item_per_group(spark, sf_dir):
    counts = load(spark, sf_dir, "part").groupBy("p_type", (F.col("p_size") % 5).alias("g"), "p_name").agg(F.count("*").alias("n"))
    best = counts.groupBy("p_type", "g").agg(F.min(F.struct((-F.col("n")).alias("m"), "p_name")).alias("b"))
    return best.select("p_type", "g", "b.p_name", (-F.col("b.m")).alias("n"))


@query("inferred_profile", """WITH p AS (SELECT p_brand AS entity, p_name AS item, count(*)::DOUBLE AS weight FROM part GROUP BY ALL), s AS (FROM p), nb AS (SELECT DISTINCT a.entity, b.entity AS neighbour, 1.0::DOUBLE / (1 + abs(regexp_extract(a.entity, '([0-9]+)', 1)::INT - regexp_extract(b.entity, '([0-9]+)', 1)::INT)) AS similarity FROM s a, p b WHERE a.entity <> b.entity),
o AS (SELECT entity, item, 0.75::DOUBLE * weight / max(weight) OVER (PARTITION BY entity) AS w FROM s), l0 AS (SELECT nb.entity, item, sum(similarity * weight) AS x FROM nb JOIN p ON p.entity = neighbour GROUP BY ALL), l AS (SELECT entity, item, 0.25::DOUBLE * x / max(x) OVER (PARTITION BY entity) AS w FROM l0),
m AS (SELECT entity, item, sum(w) AS w FROM (FROM o UNION ALL FROM l) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY round(w, 9) DESC, item) AS r, max(w) OVER (PARTITION BY entity) AS top FROM m), k AS (FROM r WHERE w >= 0.12::DOUBLE * top AND r <= 24)
SELECT entity, item, round(w / sum(w) OVER (PARTITION BY entity), 4) AS weight FROM k""")
def inferred_profile(spark, sf_dir):
    profiles = load(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("entity"), F.col("p_name").alias("item")).agg(F.count("*").cast("double").alias("weight"))
    number = lambda c: F.regexp_extract(c, "([0-9]+)", 1).cast("int")
    signal = profiles
    near = profiles.select(F.col("entity").alias("neighbour")).distinct()
    neighbours = signal.select("entity").distinct().join(F.broadcast(near), F.col("entity") != F.col("neighbour")).withColumn("similarity", 1.0 / (1 + F.abs(number("entity") - number("neighbour"))))
    return taxonomy.inferred_profile(signal, neighbours, profiles, "item")


@query("facet_aggregation", "WITH o AS (SELECT c_mktsegment AS job, n_name AS city, c_custkey AS company, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey), c AS (SELECT job, city, count(*) AS n, count(DISTINCT company) AS companies FROM o GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY n DESC, city) AS r FROM c) SELECT job, city, n, companies FROM r WHERE r <= 3")
def facet_aggregation(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    counts = rows.groupBy(F.col("c_mktsegment").alias("job"), F.col("n_name").alias("city")).agg(F.count("*").alias("n"), F.countDistinct("c_custkey").alias("companies"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("job").orderBy(F.desc("n"), "city"))).where("r <= 3").drop("r")


@query("taxonomy_final", """WITH jobs AS (SELECT 'J-' || n_nationkey AS code, n_name AS name, [n_regionkey, (n_nationkey * 7) % 5, 9] AS sources FROM nation), l AS (SELECT code, unnest(sources) AS source, unnest(range(3)) AS spot FROM jobs), f AS (SELECT code, source, min(spot) AS spot FROM l GROUP BY ALL),
n AS (SELECT f.code, string_agg(r_name, '|' ORDER BY spot) AS names, max(CASE WHEN spot = 0 THEN lower(r_name) END) AS en FROM f JOIN region ON source = r_regionkey GROUP BY f.code),
p AS (SELECT n_regionkey AS source, c_mktsegment AS part, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > n_regionkey * 2000 + 1500 GROUP BY ALL), h AS (SELECT code, string_agg(part, '|' ORDER BY part) AS parts, sum(n)::BIGINT AS hits FROM (SELECT code, part, max(n) AS n FROM f JOIN p USING (source) GROUP BY ALL) GROUP BY code),
s AS (SELECT 'J-' || s_nationkey AS code, count(*) AS n FROM supplier GROUP BY 1)
SELECT code, 'J' AS category, name, CASE WHEN substr(code, 3)::INT % 3 = 0 THEN 'own ' || code ELSE en END AS name_en, coalesce(names, '') AS source_names, coalesce(parts, '') AS parts, coalesce(hits, 0) AS hits, coalesce(s.n, 0) AS n_samples, substr(code, 3)::INT % 4 > 0 AS complete
FROM (SELECT code, name FROM jobs) LEFT JOIN n USING (code) LEFT JOIN h USING (code) LEFT JOIN s USING (code) WHERE substr(code, 3)::INT % 12 > 0""")
def taxonomy_final(spark, sf_dir):
    """Nations as jobs made of regions: names, parts with their customers, samples; a quarter has no definition yet."""
    nation, region = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    jobs = nation.where("n_nationkey % 12 > 0").selectExpr("concat('J-', n_nationkey) AS code", "n_name AS name", "array(n_regionkey, n_nationkey * 7 % 5, 9) AS sources")
    told = nation.selectExpr("concat('J-', n_nationkey) AS code", "CASE WHEN n_nationkey % 4 > 0 THEN 'what it is' END AS definition", "CASE WHEN n_nationkey % 3 = 0 THEN concat('own J-', n_nationkey) ELSE '' END AS name_en")
    old = region.selectExpr("r_regionkey AS code", "r_name AS name", "lower(r_name) AS name_en")
    sold = load(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).where("c_acctbal > n_regionkey * 2000 + 1500")
    parts = sold.groupBy(F.col("n_regionkey").alias("source"), F.col("c_mktsegment").alias("part")).agg(F.count("*").alias("n"))
    found = taxonomy.finalised(jobs, told, old, parts, load(spark, sf_dir, "supplier").selectExpr("concat('J-', s_nationkey) AS code"))
    return found.select("code", "category", "name", "name_en", F.array_join("source_names", "|").alias("source_names"), F.array_join("parts", "|").alias("parts"), "hits", "n_samples", "complete")
