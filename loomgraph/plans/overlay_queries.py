"""Overlay evidence bound to `events`: a slice of a user is an entity, an event a document, its type the source and tier."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import overlay
from loomgraph.plans import params as P
from loomgraph.plans.registry import registry
from loomgraph.sources.tables import load

QUERIES, ORACLES, query = registry()

_END = "2024-01-25"
_EVIDENCE = """SELECT concat('E', user_id, '-', event_id % 16) AS entity, event_id AS doc_id,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS date,
  CASE event_type WHEN 'purchase' THEN 'jd' WHEN 'signup' THEN 'papers' WHEN 'click' THEN 'papers' ELSE 'news' END AS source,
  CASE event_type WHEN 'signup' THEN 'A' WHEN 'click' THEN 'C' ELSE '' END AS tier,
  CASE WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'medium' ELSE 'high' END AS confidence,
  CASE WHEN event_id % 3 = 0 THEN 'require' ELSE 'scan' END AS grade FROM events"""


def evidence(spark, sf_dir):
    load(spark, sf_dir, "events").createOrReplaceTempView("_events")
    rows = spark.sql(_EVIDENCE.replace("FROM events", "FROM _events"))
    end = F.lit(_END).cast("date")
    kept = rows.where(overlay.known_by(F.col("date"), end))
    return kept.withColumn("contrib", overlay.contribution(F.col("source"), F.col("tier"), F.col("confidence"), F.col("date"), end))


_SQL = f"""evidence AS (SELECT *,
  CASE WHEN source = 'jd' THEN 1.0::DOUBLE WHEN tier = 'A' THEN 0.7::DOUBLE WHEN tier = 'C' THEN 0.3::DOUBLE ELSE 0.4::DOUBLE END
  * CASE confidence WHEN 'high' THEN 1.0::DOUBLE WHEN 'medium' THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END
  * CASE WHEN date IS NULL THEN 0.5::DOUBLE ELSE pow(0.5::DOUBLE, greatest(date_diff('day', date, DATE '{_END}'), 0)::DOUBLE / CASE WHEN source = 'jd' THEN 365 WHEN tier <> '' THEN 730 ELSE 180 END) END AS contrib
  FROM ({_EVIDENCE}) WHERE date IS NULL OR date <= DATE '{_END}'),
rolled AS (SELECT entity, count(*) AS n, round(1 - product(1 - contrib), 4) AS strength, round(max(contrib), 4) AS max_contrib, min(date) AS first_seen, max(date) AS last_seen,
  coalesce(string_agg(DISTINCT nullif(tier, ''), ',' ORDER BY nullif(tier, '')), '') AS tiers FROM evidence GROUP BY entity)"""


@query("evidence_contrib", f"WITH {_SQL} SELECT doc_id, entity, round(contrib, 6) AS contrib FROM evidence")
def evidence_contrib(spark, sf_dir):
    return evidence(spark, sf_dir).select("doc_id", "entity", F.round("contrib", 6).alias("contrib"))


@query("noisy_or_strength", f"WITH {_SQL} SELECT entity, source, round(1 - product(1 - contrib), 6) AS strength FROM evidence GROUP BY ALL")
def noisy_or_strength(spark, sf_dir):
    rows = evidence(spark, sf_dir)
    return rows.groupBy("entity", "source").agg(F.round(overlay.noisy_or(F.col("contrib")), 6).alias("strength"))


@query("entity_rollup", f"WITH {_SQL} SELECT * FROM rolled")
def entity_rollup(spark, sf_dir):
    return overlay.roll_up(evidence(spark, sf_dir), "entity")


@query("participation", f"WITH {_SQL}, w AS (SELECT entity, doc_id % 16 AS slot, count(*) AS n, round(1 - product(1 - contrib), 4) AS strength FROM evidence GROUP BY ALL) SELECT entity, slot, strength, strength >= {P.PARTICIPATE} AS participates, strength < {P.MIN_STRENGTH} AND n <= 1 AS pruned, strength < {P.PARTICIPATE} AS dormant FROM w")
def participation(spark, sf_dir):
    rows = evidence(spark, sf_dir).withColumn("slot", F.col("doc_id") % 16).withColumn("key", F.struct("entity", "slot"))
    rolled = overlay.participation(overlay.roll_up(rows, "key"))
    return rolled.select("key.entity", "key.slot", "strength", "participates", "pruned", "dormant")


@query("promotion", f"WITH {_SQL}, c AS (SELECT entity, count(DISTINCT doc_id) AS jd_docs FROM evidence WHERE source = 'jd' AND grade = 'require' GROUP BY entity) SELECT entity, strength, jd_docs FROM rolled JOIN c USING (entity) WHERE strength >= {P.PROMOTE} AND jd_docs >= {P.PROMOTE_DOCS}")
def promotion(spark, sf_dir):
    rows = evidence(spark, sf_dir)
    return overlay.promotions(rows, overlay.roll_up(rows, "entity"), "entity")


@query("merge_named_sources", """WITH e AS (
  SELECT 'P' || p_partkey AS id, p_name AS name, p_type AS definition, CASE p_partkey % 3 WHEN 0 THEN 'news' WHEN 1 THEN 'papers' ELSE 'jd' END AS source, p_size AS born FROM part),
n AS (SELECT *, lower(regexp_replace(name, '[\\s,.;_()-]', '', 'g')) AS norm, row_number() OVER (PARTITION BY lower(regexp_replace(name, '[\\s,.;_()-]', '', 'g')) ORDER BY CASE source WHEN 'papers' THEN 1 WHEN 'jd' THEN 2 ELSE 3 END, -length(definition), id) AS r FROM e)
SELECT norm, max(id) FILTER (r = 1) AS id, max(definition) FILTER (r = 1) AS definition, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, min(born) AS born, count(*) AS merged FROM n GROUP BY norm""")
def merge_named_sources(spark, sf_dir):
    rows = load(spark, sf_dir, "part").selectExpr("concat('P', p_partkey) AS id", "p_name AS name", "p_type AS definition", "CASE p_partkey % 3 WHEN 0 THEN 'news' WHEN 1 THEN 'papers' ELSE 'jd' END AS source", "p_size AS born")
    return overlay.merge_same_name(rows, F.lower(F.regexp_replace("name", r"[\s、，,.;·_（）()-]", "")), ["papers", "jd", "news"])


@query("evidence_upsert", """WITH s AS (SELECT event_id, user_id, value, 1 AS seq FROM events), b AS (SELECT event_id, user_id, value * 2 AS value, 2 AS seq FROM events WHERE value > 20)
SELECT event_id, max_by(value, seq) AS value, max(seq) AS seq FROM (FROM s UNION ALL FROM b UNION ALL FROM b) GROUP BY event_id""")
def evidence_upsert(spark, sf_dir):
    events = load(spark, sf_dir, "events").select("event_id", "value")
    state = events.withColumn("seq", F.lit(1))
    batch = events.where("value > 20").withColumn("value", F.col("value") * 2).withColumn("seq", F.lit(2))
    return overlay.upsert(state, batch.unionByName(batch), ["event_id"], "seq")


@query("mint_codes", """WITH n AS (SELECT DISTINCT p_name AS name FROM part WHERE p_size > 25), e AS (SELECT max(regexp_extract(p_brand, '([0-9]+)', 1)::INT) AS last FROM part)
SELECT name, 'PS-' || lpad((last + row_number() OVER (ORDER BY name))::VARCHAR, 3, '0') AS id FROM n, e""")
def mint_codes(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    existing = part.selectExpr("concat('PS-', regexp_extract(p_brand, '([0-9]+)', 1)) AS id").distinct()
    return overlay.mint_codes(part.where("p_size > 25").select(F.col("p_name").alias("name")).distinct(), existing, "PS")
