"""Items brought to canonical names, and markers of proficiency in résumés."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomgraph.functions import markers, points
from loomgraph.operators import canonical, intake
from loomgraph.plans.registry import registry
from loomgraph.plans.resumes import RESUME_SQL, resumes
from loomgraph.sources.interim import shared_dir
from loomgraph.sources.tables import load

QUERIES, ORACLES, query = registry()

#: Names as they are written in lines of orders: in capitals, with a hyphen, with two parts in one, with a misspelt word.
_WRITTEN = """SELECT l_orderkey AS doc, p_brand AS skill, l_linenumber * 100 + p_partkey % 100 AS place, CASE p_partkey % 6 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, ' ', '-') WHEN 2 THEN concat(p_name, '/', p_type) WHEN 3 THEN replace(p_name, 'i', 'y') ELSE p_name END AS name
FROM lineitem JOIN part ON l_partkey = p_partkey"""
_CANONICALS = "SELECT DISTINCT p_name AS canonical, substr(p_name, 1, instr(p_name, ' ') - 1) AS category FROM part WHERE p_name NOT LIKE 'small%'"
_ALIASES = "SELECT DISTINCT replace(p_name, 'i', 'y') AS name, p_name AS canonical, 'misspelt' AS category FROM part WHERE p_name LIKE '%i%' AND p_name NOT LIKE 'old%'"
_RETIRED = "SELECT DISTINCT p_name AS id, replace(p_name, 'hot ', 'red ') AS target FROM part WHERE p_name LIKE 'hot %' UNION SELECT DISTINCT p_name, replace(p_name, 'red ', 'blue ') FROM part WHERE p_name LIKE 'red g%'"
_EXPANSIONS = "SELECT DISTINCT concat(p_name, ' / ', p_type) AS name, p_name AS one, lower(p_type) AS two FROM part WHERE p_type <> 'PROMO'"
_FOLD = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"

_RESOLVED = f"""written AS ({_WRITTEN}), canonicals AS ({_CANONICALS}), aliases AS ({_ALIASES}), retired AS ({_RETIRED}), expansions AS ({_EXPANSIONS}),
ends AS (SELECT a.id, coalesce(c.target, b.target, a.target) AS target FROM retired a LEFT JOIN retired b ON b.id = a.target LEFT JOIN retired c ON c.id = b.target),
names AS (SELECT DISTINCT name, {_FOLD.format('name')} AS key FROM written),
exact AS (SELECT name, arg_min(canonical, (o, canonical)) AS canonical, arg_min(category, (o, canonical)) AS category FROM (SELECT name, canonical, category, 0 AS o FROM aliases UNION ALL SELECT canonical, canonical, category, 1 FROM canonicals) GROUP BY name),
folded AS (SELECT {_FOLD.format('canonical')} AS key, min(canonical) AS canonical, arg_min(category, canonical) AS category FROM canonicals GROUP BY 1),
found AS (SELECT n.name, n.key, coalesce(e.canonical, f.canonical) AS hit, coalesce(e.category, f.category, '') AS category, CASE WHEN e.name IS NOT NULL THEN 'l2' WHEN f.key IS NOT NULL THEN 'l1' ELSE 'keep' END AS layer FROM names n LEFT JOIN exact e ON e.name = n.name LEFT JOIN folded f ON f.key = n.key),
resolved AS (SELECT name, key, coalesce(target, hit, name) AS canonical, category, layer FROM found LEFT JOIN ends ON id = hit),
several AS (SELECT {_FOLD.format('name')} AS key, min([one, two]) AS targets FROM expansions GROUP BY 1),
meant AS (SELECT r.name, 0 AS nth, r.canonical FROM resolved r WHERE key NOT IN (SELECT key FROM several) UNION ALL
  SELECT name, nth, coalesce(target, t) FROM (SELECT name, unnest([0, 1]) AS nth, unnest(targets) AS t FROM names JOIN several USING (key)) LEFT JOIN ends ON id = t),
firsts AS (SELECT doc, skill, canonical, min((place, nth)) AS first FROM written JOIN meant USING (name) GROUP BY ALL),
normal AS (SELECT doc, skill, canonical, (row_number() OVER (PARTITION BY doc, skill ORDER BY first, canonical) - 1)::INT AS place FROM firsts)"""


def _inputs(spark, sf_dir):
    for name in ("lineitem", "part"):
        load(spark, sf_dir, name).createOrReplaceTempView(f"_{name}")
    run = lambda text: spark.sql(text.replace("FROM lineitem", "FROM _lineitem").replace("JOIN part", "JOIN _part").replace("FROM part", "FROM _part"))
    expansions = run(_EXPANSIONS).select("name", F.array("one", "two").alias("targets"))
    return run(_WRITTEN), canonical.Registry(run(_CANONICALS), run(_ALIASES), run(_RETIRED), expansions)


@query("canonical_names", f"WITH {_RESOLVED} SELECT name, canonical, category, layer FROM resolved")
def canonical_names(spark, sf_dir):
    return canonical.resolve(*_inputs(spark, sf_dir))


@query("normalised_points", f"WITH {_RESOLVED} SELECT * FROM normal")
def normalised_points(spark, sf_dir):
    return canonical.normalised(*_inputs(spark, sf_dir), ["doc", "skill"])


@query("backfill_stats", f"WITH {_RESOLVED}, a AS (SELECT skill, count(*) AS n_raw FROM written GROUP BY skill), b AS (SELECT skill, count(*) AS n_canonical, count(DISTINCT canonical) AS n_distinct FROM normal GROUP BY skill) SELECT skill, n_raw, n_canonical, n_raw - n_canonical AS n_merged, n_distinct FROM a JOIN b USING (skill)")
def backfill_stats(spark, sf_dir):
    rows, told = _inputs(spark, sf_dir)
    return canonical.backfill_stats(rows, canonical.normalised(rows, told, ["doc", "skill"]), "skill")


_WORDS, _YEARS = ("STANDARD", "PROMO", "baseline"), (r"[0-9]{4}[.][0-9]{2}-[0-9]{4}", r"[0-9]{1,2}%")


@query("proficiency_markers", f"""WITH {RESUME_SQL}, lines AS (SELECT candidate, list_filter(string_split(text, chr(10)), lambda l: contains(l, 'Order') OR starts_with(l, '- Delivered')) AS s FROM resumes),
r AS (SELECT candidate, array_to_string([substr(x, 1, 300) FOR x IN s[1:6]], ' ') AS t FROM lines), y AS (SELECT candidate, t, regexp_extract_all(t, '{_YEARS[0]}') || regexp_extract_all(t, '{_YEARS[1]}') AS h FROM r)
SELECT candidate, array_to_string([w FOR w IN {list(_WORDS)} IF contains(t, w)], ',') AS markers, len(list_distinct(h)) AS n_hints, CASE WHEN len(h) > 0 THEN least(15, list_max([n::INT FOR n IN flatten([regexp_extract_all(x, '[0-9]{{1,2}}') FOR x IN h])])) END AS years, len([w FOR w IN {list(_WORDS)} IF contains(t, w)]) = 0 AS gated FROM y""")
def proficiency_markers(spark, sf_dir):
    """Markers, year hints and the gate over the first six lines that tell of an order."""
    rows = resumes(spark, sf_dir).select("candidate", F.filter(F.split("text", "\n"), lambda x: F.contains(x, F.lit("Order")) | F.startswith(x, F.lit("- Delivered"))).alias("s"))
    text = rows.select("candidate", markers.read(F.col("s")).alias("t"))
    told = text.select("candidate", markers.markers(F.col("t"), _WORDS).alias("m"), markers.year_hints(F.col("t"), _YEARS).alias("h"))
    return told.select("candidate", F.array_join("m", ",").alias("markers"), F.size("h").cast("long").alias("n_hints"), markers.most_years(F.col("h")).alias("years"), markers.gated(F.lit("X"), F.col("m"), True).alias("gated"))


_TYPES = "CASE p_partkey % 5 WHEN 0 THEN concat('none or ', p_type) WHEN 1 THEN concat(p_name, ' or ', p_type) WHEN 2 THEN concat(' ', p_type, '  or ', p_name) WHEN 3 THEN 'none..' ELSE p_name END"


@query("stratum_resolve", f"""WITH t AS (SELECT p_partkey, {_TYPES} AS types FROM part), m AS (SELECT DISTINCT p_name AS part, substr(p_name, 1, instr(p_name, ' ') - 1) AS stratum FROM part WHERE p_name LIKE '%widget' UNION SELECT DISTINCT p_type, lower(p_type) FROM part WHERE p_type <> 'PROMO'),
k AS (SELECT part, min(stratum) AS stratum FROM m GROUP BY part), x AS (SELECT p_partkey, types, unnest(string_split_regex(types, '\\s+or\\s+')) AS raw, unnest(range(len(string_split_regex(types, '\\s+or\\s+')))) AS i FROM t)
SELECT t.p_partkey, arg_min(stratum, i) FILTER (stratum IS NOT NULL) AS stratum FROM t LEFT JOIN x USING (p_partkey) LEFT JOIN k ON part = trim(raw) GROUP BY t.p_partkey""")
def stratum_resolve(spark, sf_dir):
    parts = load(spark, sf_dir, "part")
    mapping = parts.where("p_name LIKE '%widget'").selectExpr("p_name AS part", "substring_index(p_name, ' ', 1) AS stratum").unionByName(parts.where("p_type <> 'PROMO'").selectExpr("p_type AS part", "lower(p_type) AS stratum"))
    return intake.strata(parts.selectExpr("p_partkey", f"{_TYPES} AS types"), "types", mapping).select("p_partkey", "stratum")


@query("mention_units", """WITH s AS (SELECT conv_id, turn, text, [trim(regexp_replace(x, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) FOR x IN string_split_regex(text, '[\\n]')] AS parts FROM conversations WHERE NOT regexp_matches(text, '[。；;！？!?]')),
u AS (SELECT conv_id, turn, ['标题：' || role_] || [substr(p, 1, 200) FOR p IN parts IF length(p) >= 4] || [trim(split_part(text, '.', 1))] AS units FROM (SELECT s.*, c.role AS role_ FROM s JOIN conversations c USING (conv_id, turn)))
SELECT conv_id, turn, len(list_distinct([x FOR x IN units IF x <> '']))::INT AS n, units[1] AS first FROM u""")
def mention_units(spark, sf_dir):
    """Units of turns as if they were papers: the role is the title, the text the abstract, its first sentence evidence."""
    rows = load(spark, sf_dir, "conversations").where("text NOT RLIKE '[。；;！？!?]'")
    units = intake.paper_units(F.col("role"), F.array().cast("array<string>"), F.col("text"), F.array(F.substring_index("text", ".", 1)))
    return rows.select("conv_id", "turn", units.alias("u")).select("conv_id", "turn", F.size("u").alias("n"), F.col("u")[0].alias("first"))


_VERDICTS = """SELECT CASE WHEN p_partkey % 17 = 0 THEN 'x' ELSE concat(' ', p_partkey) END AS index, CASE p_partkey % 4 WHEN 0 THEN 'Reject ' WHEN 1 THEN 'keep' WHEN 2 THEN 'maybe' END AS status, CASE p_partkey % 3 WHEN 0 THEN 'NEW_SKILL' WHEN 1 THEN 'thing' END AS final_kind, CASE WHEN p_partkey % 2 = 0 THEN ' ' ELSE p_name END AS name_zh, NULL AS name_en,
  CASE p_partkey % 5 WHEN 0 THEN 'Skills' WHEN 1 THEN 'roles' END AS taxonomy, CASE WHEN p_partkey % 7 > 0 THEN p_brand END AS code, CASE WHEN p_partkey % 3 > 0 THEN concat('E', p_size) END AS merge_into, CASE WHEN p_partkey % 8 = 0 THEN 'no' END AS reject_reason, p_type AS reason FROM part"""


@query("validated_decisions", f"""WITH d AS (SELECT *, try_cast(trim(index) AS BIGINT) AS i FROM ({_VERDICTS})), c AS (SELECT p_partkey AS i, p_type AS own_zh, p_brand AS own_en FROM part WHERE p_size > 10),
x AS (SELECT *, coalesce(lower(trim(status)) = 'reject', false) AS bad, coalesce(lower(taxonomy) = 'skills' AND code IS NOT NULL, false) AS mapped FROM d JOIN c USING (i))
SELECT i AS index, CASE WHEN lower(final_kind) = 'new_skill' THEN 'new_skill' ELSE 'new_task' END AS final_kind, coalesce(nullif(trim(name_zh), ''), own_zh) AS name_zh, own_en AS name_en, CASE WHEN bad THEN 'reject' ELSE 'keep' END AS status, CASE WHEN mapped THEN 'skills' END AS taxonomy, CASE WHEN mapped THEN code END AS code,
  CASE WHEN NOT mapped THEN merge_into END AS merge_into, coalesce(reject_reason, CASE WHEN bad THEN '粒度不符或与现有体系重复（未说明）' ELSE '' END) AS reject_reason, reason FROM x""")
def validated_decisions(spark, sf_dir):
    load(spark, sf_dir, "part").createOrReplaceTempView("_part")
    candidates = load(spark, sf_dir, "part").where("p_size > 10").selectExpr("p_partkey AS index", "'new_task' AS kind", "p_type AS name_zh", "p_brand AS name_en")
    return intake.validated(spark.sql(_VERDICTS.replace("FROM part", "FROM _part")), candidates)


@query("fitted_names", "WITH n AS (SELECT p_partkey, p_name || '/' || p_type || ',' || p_brand AS name FROM part), e AS (SELECT *, right(name, 20) AS e FROM n), j AS (SELECT *, [i FOR i IN range(1, 17) IF contains(',;/', substr(e, i, 1))] AS places FROM e) SELECT p_partkey, CASE WHEN length(name) <= 20 THEN name WHEN len(places) > 0 THEN substr(e, places[1] + 1) ELSE ltrim(e, ' ,;/') END AS name FROM j")
def fitted_names(spark, sf_dir):
    name = F.concat("p_name", F.lit("/"), "p_type", F.lit(","), "p_brand")
    return load(spark, sf_dir, "part").select("p_partkey", intake.fitted_name(name).alias("name"))


@query("forecast_ingest", """SELECT '2026-Q3' AS quarter, 'J' || r_regionkey AS job, 'S' || n_nationkey AS skill, round(n_nationkey * 0.01::DOUBLE, 6) AS uni, round(n_nationkey * 0.01::DOUBLE + n_regionkey * 0.1::DOUBLE, 6) AS cov, round(n_regionkey * 0.1::DOUBLE, 6) AS signal, CASE WHEN n_nationkey % 2 = 0 THEN round(0.5 + n_nationkey, 6) ELSE 0 END::DOUBLE AS last_share, n_nationkey AS n_hist
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 6 > 0 AND r_name <> 'ASIA'""")
def forecast_ingest(spark, sf_dir):
    """Forecasts written as a CSV file of names and read back, some without numbers, some of jobs that have no code."""
    nation, region = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).selectExpr("' 2026-Q3' AS forecast_quarter", "r_name AS job", "n_name AS skill", "CASE WHEN n_nationkey % 6 = 0 THEN 'NaN' ELSE CAST(n_nationkey * 0.01D AS STRING) END AS p50_uni", "CAST(n_nationkey * 0.01D + n_regionkey * 0.1D AS STRING) AS p50_cov", "CASE WHEN n_nationkey % 2 = 0 THEN CAST(0.5D + n_nationkey AS STRING) END AS last_share", "CAST(n_nationkey AS STRING) AS n_hist_quarters")
    path = f"{shared_dir(spark)}/forecast-{uuid.uuid4().hex}"
    rows.write.option("header", True).csv(path)
    read = spark.read.option("header", True).csv(path)
    return intake.forecasts(read, region.where("r_name <> 'ASIA'").selectExpr("r_name AS name", "concat('J', r_regionkey) AS code"), nation.selectExpr("n_name AS name", "concat('S', n_nationkey) AS code"))


_RULES = points.PointRules(brands=("old bolt", "Brand#5"), devices=("red widget",), general=("PROMO",), endings=("anvil",), makers=("small ", "large "), products=("ring", "plate"), shortest=5, longest=12)
_MESSY = """SELECT l_orderkey, l_linenumber * 1000 + p_partkey % 1000 AS spot, CASE p_partkey % 5 WHEN 0 THEN concat('；', p_name, ' ,') WHEN 1 THEN upper(p_name) WHEN 2 THEN replace(p_name, ' ', '   ') WHEN 3 THEN p_brand ELSE p_type END AS point FROM lineitem JOIN part ON l_partkey = p_partkey"""


@query("cleaned_points", f"""WITH m AS ({_MESSY}), f AS (SELECT l_orderkey, spot, point, trim(regexp_replace(point, '\\s+', ' ', 'g'), ' ，,、；;·') AS p FROM m),
n AS (SELECT l_orderkey, spot, point, CASE WHEN p IN ('small ring', 'small plate', 'large ring', 'large plate') THEN substr(p, 7) ELSE p END AS p FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, lower(p) ORDER BY spot, point) AS nth FROM n WHERE length(p) BETWEEN 5 AND 12 AND p NOT IN ('old bolt', 'Brand#5', 'red widget', 'PROMO') AND NOT ends_with(p, 'anvil')),
o AS (SELECT l_orderkey, string_agg(p, '|' ORDER BY spot, point) AS points FROM k WHERE nth = 1 GROUP BY l_orderkey) SELECT l_orderkey, coalesce(points, '') AS points FROM (SELECT DISTINCT l_orderkey FROM m) LEFT JOIN o USING (l_orderkey)""")
def cleaned_points(spark, sf_dir):
    for name in ("lineitem", "part"):
        load(spark, sf_dir, name).createOrReplaceTempView(f"_{name}")
    rows = spark.sql(_MESSY.replace("FROM lineitem", "FROM _lineitem").replace("JOIN part", "JOIN _part"))
    listed = rows.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("spot", "point"))), lambda x: x["point"]).alias("p"))
    return listed.select("l_orderkey", F.array_join(points.cleaned(F.col("p"), _RULES), "|").alias("points"))
