"""Trees over the tables' keys, and JSON found in text made of events' properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import loose_json
from loomgraph.operators import space, tree
from loomgraph.plans.registry import registry
from loomgraph.sources.tables import load

QUERIES, ORACLES, query = registry()

#: Regions, nations, customers and orders as one tree of codes. Some are retained; one nation's region isn't there.
_NODES = """SELECT concat('R', r_regionkey) AS code, r_name AS name, NULL AS up, r_regionkey % 2 = 0 AS retained FROM region
UNION ALL SELECT concat('N', n_nationkey), n_name, concat('R', CASE WHEN n_nationkey = 7 THEN 99 ELSE n_regionkey END), n_nationkey % 3 = 0 FROM nation
UNION ALL SELECT concat('C', c_custkey), c_name, concat('N', c_nationkey), c_acctbal > 5000 FROM customer
UNION ALL SELECT concat('O', o_orderkey), o_orderpriority, concat('C', o_custkey), o_orderkey % 4 > 0 FROM orders"""

_TREE = f"""WITH nodes AS ({_NODES}), up1 AS (SELECT code, name, up, retained FROM nodes),
told AS (SELECT a.code, a.retained, a.up IS NOT NULL AND b.code IS NULL OR b.up IS NOT NULL AND c.code IS NULL OR c.up IS NOT NULL AND d.code IS NULL AS orphan,
  concat_ws(' > ', d.name, c.name, b.name, a.name) AS path, (b.code IS NOT NULL)::INT + (c.code IS NOT NULL)::INT + (d.code IS NOT NULL)::INT AS depth,
  CASE WHEN b.retained THEN b.code WHEN c.retained THEN c.code WHEN d.retained THEN d.code ELSE '__ROOT__' END AS parent
  FROM nodes a LEFT JOIN nodes b ON a.up = b.code LEFT JOIN nodes c ON b.up = c.code LEFT JOIN nodes d ON c.up = d.code)"""


def nodes(spark, sf_dir):
    for name in ("region", "nation", "customer", "orders"):
        load(spark, sf_dir, name).createOrReplaceTempView(f"_{name}")
    text = _NODES
    for name in ("region", "nation", "customer", "orders"):
        text = text.replace(f"FROM {name}", f"FROM _{name}")
    return spark.sql(text).select("code", "name", F.when(F.col("up").isNotNull(), F.array("up", F.lit("R0"))).alias("parents"), "retained")


@query("classification_paths", f"{_TREE} SELECT code, path, depth, parent, CASE WHEN orphan THEN 'orphan' ELSE 'ok' END AS state FROM told")
def classification_paths(spark, sf_dir):
    return tree.ancestry(nodes(spark, sf_dir)).select("code", F.array_join("path", " > ").alias("path"), "depth", "parent", "state")


@query("classification_tree", f"{_TREE}, hidden AS (SELECT parent AS code, count(*) AS n FROM told WHERE NOT retained GROUP BY parent) SELECT parent, code AS child, coalesce(n, 0) AS n_below FROM told LEFT JOIN hidden USING (code) WHERE retained")
def classification_tree(spark, sf_dir):
    return tree.retained_tree(nodes(spark, sf_dir))


#: Answers as a model gives them: fences, talk before and after, brackets in strings, some cut off, some with a field twice or one too many.
_ANSWERS = """SELECT event_id, user_id, value, CASE event_id % 8
  WHEN 0 THEN concat('Here [it] is? ', substr(props, 1, 5))
  WHEN 1 THEN concat('```json', chr(10), '[{"id": ', event_id, ', "kind": "', event_type, ' ]} ", "p": ', props, '}]', chr(10), '```')
  WHEN 2 THEN concat('Sure: [{"id": ', event_id, ', "kind": "a", "p": ', props, '}, {"id": 1, "kind": "b]", "p": {}}] done ]')
  WHEN 3 THEN concat('[{"id": ', event_id, ', "id": 2, "kind": "x", "p": {}}]')
  WHEN 4 THEN concat('[{"id": ', event_id, ', "type": "x", "p": {}}]')
  WHEN 5 THEN concat('[{"id": ', event_id, ', "kind": "x"')
  WHEN 6 THEN '' ELSE concat('[', event_id, ']') END AS answer FROM events"""


@query("tolerant_json", """WITH k AS (SELECT event_id, event_type, (props->>'$.k')::INT AS k FROM events)
SELECT event_id, reason, CASE WHEN event_id % 8 IN (1, 2, 4, 7) THEN CASE event_id % 8 WHEN 2 THEN 2 ELSE 1 END END AS n, CASE WHEN event_id % 8 IN (1, 2, 4) THEN event_id END AS id,
  CASE event_id % 8 WHEN 1 THEN event_type || ' ]} ' WHEN 2 THEN 'a' END AS kind, CASE WHEN event_id % 8 IN (1, 2) THEN k END AS k,
  CASE event_id % 8 WHEN 4 THEN 'missing: kind; unknown: type' WHEN 7 THEN 'not an object' END AS fault
FROM (SELECT *, CASE event_id % 8 WHEN 0 THEN 'invalid' WHEN 3 THEN 'repeated field: id' WHEN 5 THEN 'unclosed' WHEN 6 THEN 'empty' END AS reason FROM k)""")
def tolerant_json(spark, sf_dir):
    """The first array in each answer, its first object's fields and what is wrong with them."""
    load(spark, sf_dir, "events").createOrReplaceTempView("_events")
    rows = spark.sql(_ANSWERS.replace("FROM events", "FROM _events")).select("event_id", loose_json.found(F.col("answer")).alias("f")).select("event_id", "f.value", "f.reason")
    first = F.try_variant_get("value", "$[0]", "variant")
    get = lambda path, kind: F.try_variant_get("value", path, kind)
    return rows.select("event_id", "reason", F.size(get("$", "array<variant>")).alias("n"), get("$[0].id", "long").alias("id"), get("$[0].kind", "string").alias("kind"), get("$[0].p.k", "int").alias("k"), F.when(first.isNotNull(), loose_json.field_faults(first, ("id", "kind", "p"))).alias("fault"))


_JOB = "concat(c_nationkey, '-', c_mktsegment)"
_MEASURED = f"SELECT {_JOB} AS job, p_name AS task, count(*) / 10.0D AS weight FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE p_name NOT LIKE 'small%' AND l_quantity > 25 GROUP BY ALL"
_INFERRED = "SELECT concat('S', s_suppkey) AS job, p_name AS task, sum(l_discount) AS weight FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE s_suppkey % 5 = 0 AND l_quantity > 40 GROUP BY ALL"
_VECTORS = f"""measured AS ({_MEASURED.replace('10.0D', '10.0::DOUBLE')}), inferred AS ({_INFERRED}),
edges AS (SELECT job, task, weight, false AS inferred FROM measured UNION ALL SELECT job, task, weight, true FROM inferred WHERE task IN (SELECT task FROM measured)),
norms AS (SELECT job, sqrt(sum(weight * weight)) AS norm, bool_or(inferred) AS inferred FROM edges WHERE weight <> 0 GROUP BY job), vectors AS (SELECT job, task, weight / norm AS value, norms.inferred FROM edges JOIN norms USING (job) WHERE weight <> 0)"""
_NEAREST = f"""{_VECTORS}, pairs AS (SELECT a.job, b.job AS other, round(greatest(0, 1 - sum(a.value * b.value)), 9) AS distance, count(*) AS shared FROM vectors a JOIN vectors b ON a.task = b.task AND a.job <> b.job GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY distance, other)::INT AS rank FROM pairs)"""


def _vectors(spark, sf_dir):
    for name in ("orders", "customer", "lineitem", "part", "supplier"):
        load(spark, sf_dir, name).createOrReplaceTempView(f"_{name}")
    told = []
    for text in (_MEASURED, _INFERRED):
        for name in ("orders", "customer", "lineitem", "part", "supplier"):
            text = text.replace(f"FROM {name} ", f"FROM _{name} ").replace(f"JOIN {name} ", f"JOIN _{name} ")
        told.append(spark.sql(text))
    jobs = told[0].select("job").unionByName(told[1].select("job"))
    return space.unit_vectors(jobs, *told)


@query("job_space", f"WITH {_NEAREST} SELECT job, rank, other, round(distance, 6) AS distance, shared FROM ranked WHERE rank <= 5")
def job_space(spark, sf_dir):
    """Nearest jobs by the tasks that postings have; suppliers are jobs known by inference only."""
    return space.neighbours(_vectors(spark, sf_dir), 5).withColumn("distance", F.round("distance", 6))


@query("job_rings", f"""WITH {_NEAREST}, c AS (SELECT split_part(job, '-', 2) AS cluster, distance FROM ranked WHERE rank <= 20), o AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY distance) AS i, count(*) OVER (PARTITION BY cluster) AS n FROM c)
SELECT cluster, any_value(n) AS n, """ + ", ".join(f"round(max(distance) FILTER (i = greatest(1, ceil({s}::DOUBLE * n - 1e-9))), 6) AS r{round(100 * s)}" for s in (0.25, 0.5, 0.75, 0.95)) + " FROM o GROUP BY cluster")
def job_rings(spark, sf_dir):
    """Within what distance shares of the near jobs of each cluster lie."""
    near = space.neighbours(_vectors(spark, sf_dir), 20).select(F.split_part("job", F.lit("-"), F.lit(2)).alias("cluster"), "distance")
    return space.rings(near).withColumns({c: F.round(c, 6) for c in ("r25", "r50", "r75", "r95")})


_BAND = "CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 200000 THEN 'mid' WHEN o_totalprice < 300000 THEN 'high' ELSE 'top' END"
_POSTS = f"SELECT {_JOB} AS job, o_orderpriority AS col, {_BAND} AS band FROM orders JOIN customer ON o_custkey = c_custkey"


@query("post_cells", f"""WITH p AS ({_POSTS}), jobs AS (SELECT job, count(*) AS posts FROM p GROUP BY job),
cols AS (SELECT job, col, count(*)::DOUBLE / any_value(posts) AS a FROM p JOIN jobs USING (job) GROUP BY job, col HAVING count(*)::DOUBLE / any_value(posts) >= 0.04),
bands AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY b DESC, band) AS nth FROM (SELECT job, band, count(*)::DOUBLE / any_value(posts) AS b FROM p JOIN jobs USING (job) GROUP BY job, band)),
cells AS (SELECT job, col AS "column", band, round(posts * a * b, 6) AS posts FROM cols JOIN bands USING (job) JOIN jobs USING (job) WHERE nth <= 2)
SELECT "column", band, rank, job, posts FROM (SELECT *, row_number() OVER (PARTITION BY "column", band ORDER BY posts DESC, job)::INT AS rank FROM cells) WHERE rank <= 5""")
def post_cells(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).selectExpr(f"{_JOB} AS job", "o_orderpriority AS col", f"{_BAND} AS band")
    jobs = rows.groupBy("job").agg(F.count("*").alias("posts"))
    share = lambda kind, value: rows.groupBy("job", F.col(value).alias("value")).agg(F.count("*").alias("n")).join(jobs, "job").select("job", F.lit(kind).alias("kind"), "value", (F.col("n") / F.col("posts")).alias("share"))
    return space.post_cells(share("column", "col").unionByName(share("band", "band")), jobs)


@query("cluster_model", """WITH v AS (SELECT label AS cluster, vec_id % 7 + 1 AS w, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS dim FROM embeddings WHERE label IS NOT NULL),
t AS (SELECT cluster, sum(w) AS posts, row_number() OVER (ORDER BY sum(w) DESC, cluster)::INT AS place FROM (SELECT label AS cluster, vec_id % 7 + 1 AS w FROM embeddings WHERE label IS NOT NULL) GROUP BY cluster),
s AS (SELECT cluster, dim, w, v, least(13, greatest(0, floor(v / 0.5::DOUBLE * 13 + 0.5::DOUBLE)))::INT AS bin FROM v)
SELECT cluster, place, any_value(posts)::BIGINT AS posts, dim::INT AS dim, round(sum(v * w) / sum(w), 6) AS centre, array_to_string([coalesce(m, 0) FOR m IN [""" + ", ".join(f"sum(w) FILTER (bin = {b})" for b in range(14)) + """]], ',') AS spread FROM s JOIN t USING (cluster) GROUP BY cluster, place, dim""")
def cluster_model(spark, sf_dir):
    jobs = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("job"), F.col("label").alias("cluster"), (F.col("vec_id") % 7 + 1).alias("posts"), F.col("embedding").alias("vector"))
    return space.cluster_model(jobs, 0.5).select("cluster", "place", "posts", "dim", F.round("centre", 6).alias("centre"), F.array_join(F.col("spread").cast("array<string>"), ",").alias("spread"))


@query("scoped_stacks", f"""WITH j AS (SELECT r_name AS scope, {_JOB} AS job, p_type AS stack, count(*) AS posts FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE l_quantity > 49 GROUP BY ALL)
SELECT scope, stack, count(*) AS jobs, sum(posts)::BIGINT AS posts, row_number() OVER (PARTITION BY scope ORDER BY count(*) DESC, sum(posts) DESC, stack)::INT AS rank FROM j GROUP BY scope, stack""")
def scoped_stacks(spark, sf_dir):
    sold = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = sold.join(load(spark, sf_dir, "lineitem").where("l_quantity > 49"), F.col("o_orderkey") == F.col("l_orderkey")).join(load(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return space.scoped_stacks(lines.selectExpr("r_name AS scope", f"{_JOB} AS job", "p_type AS stack", "1 AS posts"), ["scope"])
