"""Upkeep of stores bound to parts, orders and documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomgraph.operators import resume, store
from loomgraph.plans.registry import registry
from loomgraph.sources.interim import shared_dir
from loomgraph.sources.tables import load

QUERIES, ORACLES, query = registry()

_CANDIDATES = """SELECT p_partkey AS cand, CASE p_size % 7 WHEN 0 THEN 'new_job' WHEN 1 THEN 'new_task' WHEN 2 THEN 'implied_task' WHEN 3 THEN 'new_skill' WHEN 4 THEN 'capability_gap' WHEN 5 THEN 'skillpoint' ELSE 'rumour' END AS kind,
  CASE WHEN p_partkey % 31 = 0 THEN ' . ' WHEN p_partkey % 2 = 0 THEN upper(concat(p_name, '-', p_type)) ELSE concat(p_name, ' ', p_type) END AS name,
  CASE WHEN p_retailprice < 950 THEN 'reject' WHEN p_partkey % 5 = 0 THEN NULL ELSE 'accept' END AS status,
  CASE WHEN p_partkey % 6 = 0 THEN concat('T-', substr(p_brand, 7)) END AS map_to, CASE WHEN p_partkey % 9 = 0 THEN concat('E', p_partkey - 9) END AS merge_into FROM part"""
_TAXONOMY = "SELECT DISTINCT concat('T-', substr(p_brand, 7)) AS code, p_brand AS name FROM part WHERE length(p_brand) = 8"
_ENTRIES = "SELECT concat('E', p_partkey) AS id, CASE p_size % 4 WHEN 0 THEN 'new_jobs' WHEN 1 THEN 'new_tasks' WHEN 2 THEN 'new_skills' ELSE 'skillpoints' END AS array, concat(p_name, ' ', p_type) AS name FROM part WHERE p_size > 40"
_NORM = "lower(regexp_replace({}, '[\\s、，,.;·\\-_（）()]', '', 'g'))"


@query("delta_decisions", f"""WITH c AS (SELECT *, CASE WHEN kind = 'new_job' THEN 'new_jobs' WHEN kind IN ('new_task', 'implied_task') THEN 'new_tasks' WHEN kind IN ('new_skill', 'capability_gap') THEN 'new_skills' WHEN kind = 'skillpoint' THEN 'skillpoints' END AS array, nullif({_NORM.format('name')}, '') AS norm FROM ({_CANDIDATES})),
t AS ({_TAXONOMY}), e AS (SELECT *, {_NORM.format('name')} AS norm FROM ({_ENTRIES})),
d AS (SELECT c.*, (SELECT min(id) FROM e WHERE e."array" = c."array" AND e.norm = c.norm) AS same, map_to IN (SELECT code FROM t) AS mapped, merge_into IN (SELECT id FROM e) AS there FROM c),
x AS (SELECT *, CASE WHEN status = 'reject' THEN 'reject' WHEN mapped THEN 'strengthen' WHEN there THEN 'merge' WHEN "array" IS NULL OR norm IS NULL THEN 'skip' WHEN same IS NOT NULL THEN 'merge' ELSE 'new' END AS decision FROM d),
y AS (SELECT *, decision = 'new' AND cand > min(cand) FILTER (decision = 'new') OVER (PARTITION BY "array", norm) AS later FROM x)
SELECT cand, kind, "array", norm, CASE WHEN later THEN 'merge' ELSE decision END AS decision, CASE WHEN decision = 'strengthen' THEN map_to WHEN decision = 'merge' THEN CASE WHEN there THEN merge_into ELSE same END END AS target FROM y""")
def delta_decisions(spark, sf_dir):
    load(spark, sf_dir, "part").createOrReplaceTempView("_part")
    one, two, three = (spark.sql(q.replace("FROM part", "FROM _part")) for q in (_CANDIDATES, _TAXONOMY, _ENTRIES))
    return store.decide(one, two, three).select("cand", "kind", "array", "norm", "decision", "target")


_BASE = "SELECT concat('T-', CASE WHEN r < 10 THEN '0' ELSE '' END, r) AS code, name, definition FROM (SELECT row_number() OVER (ORDER BY p_name) AS r, p_name AS name, min(p_type) AS definition FROM part GROUP BY p_name)"
_OPERATIONS = """SELECT p_partkey AS seq, p_size % 3 + 1 AS batch, CASE p_partkey % 20 WHEN 0 THEN 'add' WHEN 1 THEN 'modify' WHEN 2 THEN 'merge' END AS op,
  CASE WHEN p_partkey % 20 = 1 THEN concat('T-', 10 + p_partkey % 50) WHEN p_partkey % 20 = 2 THEN concat('T-', 10 + p_partkey * 7 % 50) END AS code, CASE WHEN p_partkey % 20 = 2 THEN concat('T-', 10 + p_partkey % 50) END AS other,
  CASE WHEN p_partkey % 20 = 0 THEN concat(p_name, ' ', p_type) WHEN p_partkey % 60 = 1 THEN concat('the ', p_name) END AS name, CASE WHEN p_partkey % 7 > 0 THEN p_brand END AS definition FROM part WHERE p_partkey % 20 < 3 AND p_partkey % 3 = 1"""


def _batch_sql(before: str, n: int) -> str:
    """CTEs of one batch: operations o{n}, and the state s{n} after it."""
    return f"""o{n} AS (SELECT * FROM operations WHERE batch = {n}),
m{n} AS (SELECT code, arg_max(name, seq) FILTER (name IS NOT NULL) AS name, arg_max(definition, seq) FILTER (definition IS NOT NULL) AS definition FROM o{n} WHERE op = 'modify' GROUP BY code),
e{n} AS (SELECT s.code, coalesce(m.name, s.name) AS name, coalesce(m.definition, s.definition) AS definition FROM {before} s LEFT JOIN m{n} m USING (code)),
f{n} AS (SELECT other AS code, arg_min(o.code, seq) AS target, min(seq) AS seq FROM o{n} o WHERE op = 'merge' AND o.code <> other AND other IN (SELECT code FROM e{n}) AND o.code IN (SELECT code FROM e{n}) GROUP BY other),
g{n} AS (SELECT * FROM f{n} WHERE target NOT IN (SELECT code FROM f{n})),
h{n} AS (SELECT target AS code, string_agg(definition, '；' ORDER BY seq, code) FILTER (definition <> '') AS more FROM g{n} JOIN e{n} USING (code) GROUP BY target),
l{n} AS (SELECT code, name, CASE WHEN coalesce(more, '') = '' THEN definition ELSE concat_ws('；', nullif(definition, ''), more) END AS definition FROM e{n} LEFT JOIN h{n} USING (code) WHERE code NOT IN (SELECT code FROM g{n})),
a{n} AS (SELECT name, min(seq) AS seq, arg_min(o.definition, seq) FILTER (true) AS definition FROM (SELECT name, seq, definition FROM o{n} WHERE op = 'add' AND name IS NOT NULL) o WHERE name NOT IN (SELECT name FROM l{n}) GROUP BY name),
s{n} AS (SELECT * FROM l{n} UNION ALL SELECT 'T-' || CASE WHEN r < 10 THEN '0' || r ELSE r::VARCHAR END, name, definition FROM (SELECT *, (SELECT max(substr(code, 3)::INT) FROM {before}) + row_number() OVER (ORDER BY seq, name) AS r FROM (SELECT a.name, a.seq, o.definition FROM a{n} a JOIN o{n} o ON o.seq = a.seq)))"""


@query("taxonomy_versions", f"WITH s0 AS ({_BASE}), operations AS ({_OPERATIONS}), {_batch_sql('s0', 1)}, {_batch_sql('s1', 2)}, {_batch_sql('s2', 3)} " + " UNION ALL ".join(f"SELECT {v} AS version, code, name, definition FROM s{v}" for v in (0, 1, 3)))
def taxonomy_versions(spark, sf_dir):
    """A taxonomy and three batches of operations as versions of a table, read as of the first two versions and the last."""
    load(spark, sf_dir, "part").createOrReplaceTempView("_part")
    operations = spark.sql(_OPERATIONS.replace("FROM part", "FROM _part"))
    table = store.VersionedTable(spark, f"{shared_dir(spark)}/taxonomy-{uuid.uuid4().hex}", ["code"])
    table.write(spark.sql(_BASE.replace("FROM part", "FROM _part")).withColumn("gone", F.lit(False)), 0)
    for batch in (1, 2, 3):
        table.write(store.mutate(table.read(), operations.where(F.col("batch") == batch)), batch)
    read = [table.read(v).select(F.lit(v).alias("version"), "code", "name", "definition") for v in (0, 1, None) if v is not None] + [table.read().select(F.lit(3).alias("version"), "code", "name", "definition")]
    return read[0].unionByName(read[1]).unionByName(read[2])


_NEEDS = "SELECT DISTINCT l_orderkey AS item, concat(p_name, ' ', p_type) AS name FROM lineitem JOIN part ON l_partkey = p_partkey"
_KNOWN = "SELECT DISTINCT concat(p_name, ' ', p_type) AS name FROM part WHERE p_size <= 12"


def _round_sql(n: int) -> str:
    return f"""p{n} AS (SELECT item, min(name) AS name FROM needs WHERE item IN (SELECT item FROM w{n}) AND name NOT IN (SELECT name FROM k{n}) GROUP BY item),
y{n} AS (SELECT name FROM p{n} GROUP BY name HAVING count(*) >= 12), k{n + 1} AS (SELECT name FROM k{n} UNION SELECT name FROM y{n}), w{n + 1} AS (SELECT item FROM p{n} WHERE name IN (SELECT name FROM y{n}))"""


@query("refine_fixpoint", f"WITH needs AS MATERIALIZED ({_NEEDS}), k1 AS ({_KNOWN}), w1 AS (SELECT DISTINCT item FROM needs), {_round_sql(1)}, {_round_sql(2)}, {_round_sql(3)} " + " UNION ALL ".join(f"SELECT {n} AS attempt, name, count(*) AS n, name IN (SELECT name FROM y{n}) AS approved FROM p{n} GROUP BY name" for n in (1, 2, 3)))
def refine_fixpoint(spark, sf_dir):
    """Orders propose the first item that the store lacks, three times at most; what twelve orders propose is approved."""
    lines = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    needs = lines.select(F.col("l_orderkey").alias("item"), F.concat("p_name", F.lit(" "), "p_type").alias("name")).distinct()
    known = load(spark, sf_dir, "part").where("p_size <= 12").select(F.concat("p_name", F.lit(" "), "p_type").alias("name")).distinct()

    def propose(work, state):
        missing = work.select("item", F.explode("needs").alias("name")).join(state.select("name").distinct(), "name", "left_anti")
        return missing.groupBy("item").agg(F.min("name").alias("name"))

    work = needs.groupBy("item").agg(F.collect_set("name").alias("needs"))
    _, log = store.refine(work, known, propose, lambda names, state: names.where("support >= 12"))
    return log.groupBy("attempt", "name").agg(F.count("*").alias("n"), F.first("approved").alias("approved"))


@query("resume_fresh", "SELECT doc_id, source FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL)")
def resume_fresh(spark, sf_dir):
    """Documents whose text no earlier run took: two batches of a third of the documents were taken before, by the hash of their text."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("key"))
    taken = resume.Consumed(spark, f"{shared_dir(spark)}/consumed-{uuid.uuid4().hex}")
    taken.add(docs.where("doc_id % 6 = 0"), 1)
    taken.add(docs.where("doc_id % 6 = 3"), 2)
    return taken.fresh(docs).select("doc_id", "source")


_CHAIN = """{name}_d AS (SELECT strftime(o_orderdate, '%Y-%m') AS "window", count(*) || ':' || sum(('0x' || substr(md5(o_orderkey || '|' || o_orderpriority || '|' || o_orderstatus), 1, 15))::HUGEINT) AS own FROM orders WHERE {where} GROUP BY 1),
{name}_n AS (SELECT *, row_number() OVER (ORDER BY "window") AS i FROM {name}_d),
{name} AS (SELECT i, "window", md5(md5('{params}') || '/' || "window" || '/' || own) AS fingerprint FROM {name}_n WHERE i = 1 UNION ALL SELECT n.i, n."window", md5(c.fingerprint || '/' || n."window" || '/' || n.own) FROM {name} c JOIN {name}_n n ON n.i = c.i + 1)"""


@query("replay_plan", f"""WITH RECURSIVE {_CHAIN.format(name='recorded', where="NOT (strftime(o_orderdate, '%Y-%m') = '1998-05' AND o_orderkey % 7 = 0)", params='v1')}, {_CHAIN.format(name='now', where='true', params='v1')},
b AS (SELECT coalesce(r."window", n."window") AS "window", r.fingerprint AS old, n.fingerprint AS new FROM recorded r FULL JOIN now n ON r."window" = n."window")
SELECT "window", new AS fingerprint, CASE WHEN new IS NULL THEN 'gone' WHEN "window" >= (SELECT min("window") FROM b WHERE old IS DISTINCT FROM new) THEN 'stale' ELSE 'ok' END AS status FROM b""")
def replay_plan(spark, sf_dir):
    """Orders that came late for one month make it and all later months stale."""
    orders = load(spark, sf_dir, "orders").withColumn("window", F.date_format("o_orderdate", "yyyy-MM"))
    chain = lambda rows: resume.chained(resume.window_digests(rows, "window", ["o_orderkey", "o_orderpriority", "o_orderstatus"]), "v1")
    now = chain(orders)
    told = resume.stale_windows(chain(orders.where("NOT (window = '1998-05' AND o_orderkey % 7 = 0)")), now)
    return told.join(now, "window", "left").select("window", "fingerprint", "status")
