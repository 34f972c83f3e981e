"""Profiles of market segments as jobs, over the graph's edges with what gaps add."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import profiles
from loomgraph.plans import params as P
from loomgraph.plans.graph_queries import _ALL_EDGES, STRENGTHS_SQL, all_edges, all_gaps, freq_sql, settled_freq
from loomgraph.plans.registry import registry
from loomgraph.sources.tables import load

QUERIES, ORACLES, query = registry()

_SURE = "least(0.98, 0.62 + 0.36 * sqrt(weight))"


@query("job_profile", f"""WITH {freq_sql()}, {_ALL_EDGES}, {STRENGTHS_SQL},
e AS (SELECT relation, src, dst, weight + {P.LAMBDA_J}::DOUBLE * weight * coalesce(gap, 0) AS eff, {P.LAMBDA_J}::DOUBLE * weight * coalesce(gap, 0) AS overlay, least(0.98::DOUBLE, 0.62::DOUBLE + 0.36::DOUBLE * sqrt(weight)) AS sure FROM edges LEFT JOIN gaps ON dst = id),
tilts AS (SELECT DISTINCT p_brand AS skill, CASE substr(p_brand, 7)::INT % 3 WHEN 0 THEN 0.7::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END AS tilt FROM part),
tt AS (SELECT src AS task, CASE WHEN sum(eff) > 0 THEN sum(tilt * eff) / sum(eff) ELSE 1 END AS tilt FROM e JOIN tilts ON dst = skill WHERE relation = 'task_skill' GROUP BY src),
members AS (SELECT DISTINCT c_mktsegment AS scope, c_mktsegment AS job FROM customer UNION SELECT 'all', c_mktsegment FROM customer), counts AS (SELECT scope, count(*) AS n FROM members GROUP BY scope),
v AS (SELECT src, dst, CASE relation WHEN 'job_task' THEN 'task' ELSE 'skill' END AS kind, eff * coalesce(CASE relation WHEN 'job_task' THEN tt.tilt ELSE tilts.tilt END, 1) AS v, overlay, sure FROM e LEFT JOIN tt ON dst = task LEFT JOIN tilts ON dst = skill WHERE relation IN ('job_task', 'job_skill')),
i AS (SELECT scope, kind, dst AS id, sum(v) / any_value(n) AS demand, sum(overlay) / any_value(n) AS overlay, sum(sure * greatest(v, 1e-6)) / sum(greatest(v, 1e-6)) AS confidence FROM v JOIN members ON src = job JOIN counts USING (scope) GROUP BY ALL),
k AS (SELECT *, CASE WHEN demand > 1e-6 THEN least(1, overlay / demand) ELSE 0 END AS forward_share FROM i WHERE demand > 1e-4),
p AS (SELECT src AS skill, dst AS point, greatest(eff, 0.01) / sum(greatest(eff, 0.01)) OVER (PARTITION BY src) AS part, CASE WHEN eff > 0 THEN overlay / eff ELSE 0 END AS own, sure FROM e WHERE relation = 'skill_skillpoint'),
o AS (SELECT scope, kind, NULL AS parent, id, demand, forward_share, confidence FROM k UNION ALL SELECT scope, 'skillpoint', skill, point, demand * part, least(1, forward_share + own), (confidence + sure) / 2 FROM k JOIN p ON k.id = p.skill WHERE kind = 'skill')
SELECT scope, kind, parent, id, round(demand + 1e-9, 5) AS demand, round(forward_share + 1e-9, 5) AS forward_share, round(confidence + 1e-9, 5) AS confidence FROM o""")
def job_profile(spark, sf_dir):
    table = settled_freq(spark, sf_dir)
    gaps = all_gaps(spark, sf_dir, table).select(F.col("id").alias("dst"), "gap")
    edges = all_edges(table).join(gaps, "dst", "left").select("relation", "src", "dst", F.col("weight").alias("base"), (F.col("weight") * F.coalesce("gap", F.lit(0.0))).alias("delta"), F.expr(_SURE).alias("confidence"))
    tilts = load(spark, sf_dir, "part").selectExpr("p_brand AS skill", "CASE int(substr(p_brand, 7)) % 3 WHEN 0 THEN 0.7D WHEN 1 THEN 1.0D ELSE 1.5D END AS tilt").distinct()
    jobs = load(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("job")).distinct()
    scopes = jobs.select(F.col("job").alias("scope"), "job").unionByName(jobs.select(F.lit("all").alias("scope"), "job"))
    found = profiles.job_profile(scopes, edges, tilts, P.LAMBDA_J)
    return found.withColumns({c: F.round(F.col(c) + 1e-9, 5) for c in ("demand", "forward_share", "confidence")})
