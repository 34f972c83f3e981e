"""Grounding of quotes in `documents`, passages echoed from `benchmark`, audits of résumés."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import layout
from loomgraph.operators import audit, grounding, setsim
from loomgraph.operators.intervals import within
from loomgraph.operators.mentions import with_hits
from loomgraph.plans.registry import registry
from loomgraph.plans.resumes import RESUME_SQL, experiences, resumes
from loomgraph.sources.tables import load

QUERIES, ORACLES, query = registry()

_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_WIDE = "".join(chr(ord(c) + 0xFEE0) for c in _ASCII)
_CUT = "string_split_regex(trim(text, ' ' || chr(9) || chr(10)), '[ \\t\\n]+')"


def quotes(spark, sf_dir):
    """Of each document: eight words from the third with single blanks, four words in full-width letters, the second word, and the
    first six words of a benchmark item."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.split(F.trim(F.col("text"), F.lit(" \t\n")), r"[ \t\n]+").alias("w"))
    items = load(spark, sf_dir, "benchmark").select(F.col("item_id"), F.array_join(F.slice(F.split("text", r"[ \t\n]+"), 1, 6), " ").alias("passage"))
    known = docs.join(items, F.pmod("doc_id", F.lit(40)) == F.col("item_id"), "left")
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    made = F.array(part(3, 8), F.translate(part(5, 4), _ASCII, _WIDE), part(2, 1), F.col("passage"))
    return known.select(F.col("doc_id").alias("doc"), F.explode(made).alias("quote")).where("quote <> ''")


@query("evidence_grounding", f"""WITH RECURSIVE w AS (SELECT doc_id, text, {_CUT} AS w FROM documents),
q AS (SELECT DISTINCT doc_id, text, quote FROM (SELECT doc_id, text, unnest([array_to_string(w[3:10], ' '), translate(array_to_string(w[5:8], ' '), '{_ASCII}', '{_WIDE}'), coalesce(w[2], ''),
   (SELECT array_to_string(string_split_regex(b.text, '[ \\t\\n]+')[1:6], ' ') FROM benchmark b WHERE b.item_id = doc_id % 40)]) AS quote FROM w) WHERE quote <> ''),
hits AS (SELECT doc_id, text, quote, instr(text, quote) AS pos FROM q UNION ALL
  SELECT doc_id, text, quote, CASE WHEN instr(substr(text, pos + 1), quote) > 0 THEN pos + instr(substr(text, pos + 1), quote) ELSE 0 END FROM hits WHERE pos > 0),
exact AS (SELECT doc_id, quote, pos - 1 AS start, length(quote) AS size FROM hits WHERE pos > 0),
loose AS (SELECT doc_id, text, quote, translate(quote, '{_WIDE}', '{_ASCII}') AS bare, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS whole FROM q ANTI JOIN exact USING (doc_id, quote)),
told AS (SELECT *, CASE WHEN NOT contains(whole, bare) THEN 'unlocated' WHEN contains(substr(whole, instr(whole, bare) + 1), bare) THEN 'ambiguous' ELSE 'normalized' END AS status FROM loose),
placed AS (SELECT doc_id, quote, status, text, CASE WHEN status = 'normalized' THEN regexp_extract(text, replace(regexp_escape(bare), '\\ ', '\\s+')) END AS source FROM told)
SELECT doc_id, quote, 'exact' AS status, start::INT AS start, (start + size)::INT AS "end", quote AS source FROM exact
UNION ALL SELECT doc_id, quote, status, (instr(text, source) - 1)::INT, (instr(text, source) - 1 + length(source))::INT, source FROM placed""")
def evidence_grounding(spark, sf_dir):
    return grounding.ground(load(spark, sf_dir, "documents").withColumnRenamed("doc_id", "doc"), quotes(spark, sf_dir)).withColumnRenamed("doc", "doc_id")


@query("grounding_stats", f"SELECT status, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM ({ORACLES['evidence_grounding']}) GROUP BY status")
def grounding_stats(spark, sf_dir):
    return evidence_grounding(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def _sentences(rows, key: str):
    parts = F.transform(F.split("text", r"[.\n]"), lambda s: F.trim(s))
    return rows.select(F.col(key).alias("doc"), F.explode(parts).alias("text")).where(F.size(setsim.word_set(F.col("text"))) >= 4)


@query("passage_echo", """WITH s AS (SELECT doc_id, list_sort(list_distinct(list_filter(string_split_regex(lower(unnest(string_split_regex(text, '[.\\n]'))), '[^\\pL\\pN]+'), lambda w: w <> ''))) AS items FROM documents),
b AS (SELECT DISTINCT list_sort(list_distinct(list_filter(string_split_regex(lower(unnest(string_split_regex(text, '[.\\n]'))), '[^\\pL\\pN]+'), lambda w: w <> ''))) AS items FROM benchmark),
one AS (SELECT DISTINCT items FROM s WHERE len(items) >= 4), x AS (SELECT items, unnest(items) AS w FROM one), y AS (SELECT items, unnest(items) AS w FROM b WHERE len(items) >= 4),
p AS (SELECT x.items AS a, y.items AS b, count(*)::DOUBLE / (any_value(len(x.items)) + any_value(len(y.items)) - count(*)) AS similarity FROM x JOIN y USING (w) GROUP BY x.items, y.items),
k AS (SELECT a, max(similarity) AS similarity, count(*) AS n FROM p WHERE similarity >= 0.5 GROUP BY a)
SELECT doc_id, round(max(similarity), 6) AS similarity, sum(n)::BIGINT AS n FROM s JOIN k ON items = a GROUP BY doc_id""")
def passage_echo(spark, sf_dir):
    """Documents with a sentence that shares half its words with one of the benchmark, the greatest such share and how many pairs there are."""
    lines = _sentences(load(spark, sf_dir, "documents"), "doc_id")
    snippets = _sentences(load(spark, sf_dir, "benchmark"), "item_id").select(F.lit("all").alias("job"), "text")
    people = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.lit("all").alias("job"))
    found = audit.echoes(lines, snippets, people, 0.5, setsim.word_set)
    return found.select(F.col("doc").alias("doc_id"), F.round("echo", 6).alias("similarity"), F.col("n_lines").alias("n"))


_COUNTED = "([0-9]+) ([a-z]+ [a-z]+) (as)"
_PAIRS = "list_distinct([substr(t, i, 2) FOR i IN range(1, length(t))])"


@query("authenticity_audit", f"""WITH {RESUME_SQL},
facts AS (SELECT o_custkey AS doc, p_name AS name, l_returnflag <> 'R' AS told, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey),
points AS (SELECT doc, name, count(*) FILTER (told) AS anchors, avg(l_quantity) / 50 AS proficiency, string_split(name, ' ')[1] AS category FROM facts GROUP BY doc, name),
of_points AS (SELECT doc, count(*) FILTER (anchors = 0) AS n_listed_only, count(*) FILTER (round(proficiency, 9) >= 0.7::DOUBLE AND anchors <= 1) AS n_overrated FROM points GROUP BY doc),
of_categories AS (SELECT doc, count(*) AS n_categories, max(n)::DOUBLE / sum(n) AS focus FROM (SELECT doc, category, count(*) AS n FROM points GROUP BY ALL) GROUP BY doc),
of_months AS (SELECT candidate AS doc, sum(year(ended) * 12 + month(ended) - year(started) * 12 - month(started) + 1)::BIGINT AS months FROM experiences GROUP BY candidate),
lines AS (SELECT doc, text FROM (SELECT candidate AS doc, trim(unnest(string_split(text, chr(10)))) AS text FROM resumes) WHERE text NOT IN ('Summary', 'Experience', '')),
of_lines AS (SELECT doc, count(*) FILTER (contains(text, '%') AND NOT contains(text, 'baseline')) AS n_unbacked, sum(contains(text, 'gizmo as PROMO')::INT + contains(text, 'bolt as PROMO')::INT)::BIGINT AS n_boilerplate FROM lines GROUP BY doc),
counted AS (SELECT doc, regexp_extract(text, '{_COUNTED}', 2) AS thing, regexp_extract(text, '{_COUNTED}', 1)::INT AS n FROM lines WHERE regexp_matches(text, '{_COUNTED}')),
of_counts AS (SELECT doc, count(*) AS n_conflicts FROM (SELECT doc, thing FROM counted GROUP BY ALL HAVING count(DISTINCT n) > 1) GROUP BY doc),
people AS (SELECT candidate AS doc, years, c_mktsegment AS job FROM resumes JOIN customer ON c_custkey = candidate),
snippets AS (SELECT DISTINCT c_mktsegment AS job, 'Delivered ' || p_name || ' as ' || p_type AS text FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderpriority = '1-URGENT' AND l_returnflag = 'R' AND l_quantity > 45),
a AS (SELECT text, {_PAIRS} AS g FROM (SELECT DISTINCT text, regexp_replace(text, '[\\s()/]', '', 'g') AS t FROM lines)), b AS (SELECT text, {_PAIRS} AS g FROM (SELECT DISTINCT text, regexp_replace(text, '[\\s()/]', '', 'g') AS t FROM snippets)),
x AS (SELECT text, len(g) AS n, unnest(g) AS p FROM a), y AS (SELECT text, len(g) AS n, unnest(g) AS p FROM b),
pairs AS (SELECT x.text AS line, y.text AS snippet, count(*)::DOUBLE / (any_value(x.n) + any_value(y.n) - count(*)) AS s FROM x JOIN y USING (p) GROUP BY ALL HAVING count(*)::DOUBLE / (any_value(x.n) + any_value(y.n) - count(*)) >= 0.8),
best AS (SELECT line, job, max(s) AS s FROM pairs JOIN snippets ON snippet = snippets.text GROUP BY ALL),
of_echo AS (SELECT doc, max(s) AS echo FROM lines JOIN people USING (doc) JOIN best ON best.line = lines.text AND best.job = people.job GROUP BY doc),
m AS (SELECT doc, n_listed_only, n_overrated, n_categories, round(focus, 6) AS focus, months, n_unbacked, n_boilerplate, round(coalesce(echo, 0), 6) AS echo, coalesce(n_conflicts, 0) AS n_conflicts, round(CASE WHEN years > 0 THEN months::DOUBLE / (years * 12) ELSE 1 END, 6) AS month_ratio
  FROM people JOIN of_points USING (doc) JOIN of_categories USING (doc) JOIN of_months USING (doc) JOIN of_lines USING (doc) LEFT JOIN of_echo USING (doc) LEFT JOIN of_counts USING (doc)),
l AS (SELECT *, CASE WHEN n_listed_only = 0 THEN 'pass' WHEN n_listed_only <= 2 THEN 'watch' ELSE 'risk' END AS claims_level, CASE WHEN n_overrated = 0 THEN 'pass' WHEN n_overrated <= 2 THEN 'watch' ELSE 'risk' END AS proficiency_level,
  CASE WHEN month_ratio > 1.25 OR month_ratio < 0.7 THEN 'watch' ELSE 'pass' END AS timeline_level, CASE WHEN n_unbacked = 0 THEN 'pass' WHEN n_unbacked <= 2 THEN 'watch' ELSE 'risk' END AS basis_level,
  CASE WHEN echo >= 0.8 OR n_boilerplate >= 2 THEN 'watch' ELSE 'pass' END AS echo_level, CASE WHEN n_categories >= 5 AND focus < 0.4 THEN 'watch' ELSE 'pass' END AS focus_level, CASE WHEN n_conflicts > 0 THEN 'watch' ELSE 'pass' END AS counts_level FROM m),
c AS (SELECT *, [claims_level, proficiency_level, timeline_level, basis_level, echo_level, focus_level, counts_level] AS levels FROM l)
SELECT * EXCLUDE (levels), len(list_filter(levels, lambda x: x = 'risk'))::INT AS risk, len(list_filter(levels, lambda x: x = 'watch'))::INT AS watch, greatest(0, 100 - 18 * len(list_filter(levels, lambda x: x = 'risk')) - 8 * len(list_filter(levels, lambda x: x = 'watch')))::INT AS score FROM c""")
def authenticity_audit(spark, sf_dir):
    orders, people = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer").selectExpr("c_custkey AS o_custkey", "c_mktsegment AS job")
    sold = orders.join(load(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(load(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    told = F.col("l_returnflag") != "R"
    points = sold.groupBy(F.col("o_custkey").alias("doc"), F.col("p_name").alias("name")).agg(F.count_if(told).alias("anchors"), F.round(F.avg("l_quantity") / 50, 9).alias("proficiency"))
    points = points.withColumns({"listed": F.lit(True), "told": F.col("anchors") > 0, "category": F.substring_index("name", " ", 1)})
    months = F.year("ended") * 12 + F.month("ended") - F.year("started") * 12 - F.month("started") + 1
    done = experiences(spark, sf_dir).select(F.col("candidate").alias("doc"), months.alias("months"), F.lit("work").alias("kind"))
    texts = resumes(spark, sf_dir)
    lines = texts.select(F.col("candidate").alias("doc"), F.inline(layout.lines(F.col("text"), ("Summary", "Experience"), ""))).select("doc", "text")
    snippets = sold.join(people, "o_custkey").where("o_orderpriority = '1-URGENT' AND l_returnflag = 'R' AND l_quantity > 45").select("job", F.concat(F.lit("Delivered "), "p_name", F.lit(" as "), "p_type").alias("text")).distinct()
    who = texts.select(F.col("candidate").alias("doc"), "years").join(people.withColumnRenamed("o_custkey", "doc"), "doc")
    found = audit.audit(who, points, done, lines, snippets, ("gizmo as PROMO", "bolt as PROMO"), "baseline", "%", (_COUNTED, 2, 1, 3), 0.8)
    return found.withColumns({c: F.round(c, 6) for c in ("focus", "echo", "month_ratio")})


@query("experience_links", f"""WITH {RESUME_SQL}, facts AS (SELECT o_custkey AS doc, o_orderkey AS experience, c_mktsegment AS job, p_brand AS skill, l_quantity / 50 AS owned FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey),
claims AS (SELECT doc, experience, job, skill, max(owned) AS owned FROM facts GROUP BY ALL), docs AS (SELECT job, count(DISTINCT experience) AS n FROM facts GROUP BY job),
required AS (SELECT job, skill, count(DISTINCT experience)::DOUBLE / any_value(n) AS required FROM facts JOIN docs USING (job) GROUP BY job, skill), totals AS (SELECT job, sum(required) AS total FROM required GROUP BY job),
met AS (SELECT doc, experience, skill, required, owned, total, required * least(1, owned / greatest(required, 0.05::DOUBLE)) AS part FROM claims JOIN required USING (job, skill) JOIN totals USING (job) WHERE required >= 0.08::DOUBLE)
SELECT doc, experience, round(least(1, coalesce(sum(part) / max(total), 0)), 6) AS coverage, coalesce(array_to_string(list(skill ORDER BY required DESC, skill) FILTER (skill IS NOT NULL), ','), '') AS skills FROM (SELECT DISTINCT doc, experience FROM claims) LEFT JOIN met USING (doc, experience) GROUP BY doc, experience""")
def experience_links(spark, sf_dir):
    sold = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(load(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(load(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    claims = sold.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("experience"), F.col("c_mktsegment").alias("job"), F.col("p_brand").alias("skill"), (F.col("l_quantity") / 50).alias("owned"))
    docs = claims.groupBy("job").agg(F.count_distinct("experience").alias("n"))
    required = claims.groupBy("job", "skill").agg(F.count_distinct("experience").alias("m")).join(docs, "job").select("job", "skill", (F.col("m") / F.col("n")).alias("required"))
    found = audit.link_experiences(claims, required, most=1000)
    return found.select("doc", "experience", F.round("coverage", 6).alias("coverage"), F.array_join(F.transform("hits", lambda h: h["skill"]), ",").alias("skills"))


_SEGMENTS = {"Summary": ("summary", None), "Experience": ("work", 0), "Certificates: plan reading": (None, None)}
_ORDER_LINE = r"\d{4}\.\d{2}-\d{4}\.\d{2} Order .*"
#: An experience is a segment; it begins behind those before it and ends with its last task.
_SEGMENT_SQL = f"""{RESUME_SQL}, ordered AS (SELECT e.candidate, body, points, row_number() OVER w AS number, sum(length(body) + 1) OVER w - length(body) - 1 AS before FROM experiences e WINDOW w AS (PARTITION BY e.candidate ORDER BY started, orderkey)),
segs AS (SELECT candidate, 'work' AS kind, number::INT AS number, (instr(text, chr(10) || 'Experience' || chr(10)) + 11 + before)::INT AS start, length(body) AS size, body FROM ordered JOIN resumes USING (candidate))"""


@query("resume_segments", f"""WITH {_SEGMENT_SQL} SELECT candidate, kind, number, start, (start + size)::INT AS "end" FROM segs
UNION ALL SELECT candidate, 'summary', 1, 10, instr(text, chr(10) || 'Experience' || chr(10)) - 1 FROM resumes""")
def resume_segments(spark, sf_dir):
    texts = resumes(spark, sf_dir)
    return texts.select("candidate", F.inline(layout.segments(F.col("text"), _SEGMENTS, _ORDER_LINE)))


@query("segment_mentions", f"""WITH {_SEGMENT_SQL}, lines AS (SELECT candidate, number, unnest(string_split(body, chr(10))) AS line FROM segs),
named AS (SELECT candidate, number, regexp_extract(line, '^- Delivered [0-9]+ (.*) as ', 1) AS name FROM lines WHERE line LIKE '- Delivered%')
SELECT candidate, number, count(*) AS n_mentions, count(DISTINCT name) AS n_names FROM named GROUP BY ALL""")
def segment_mentions(spark, sf_dir):
    """Mentions of parts' names within each experience, by the overlap of their spans in the text."""
    texts = resumes(spark, sf_dir).select("candidate", "text")
    rows = with_hits(texts, "text", load(spark, sf_dir, "part").select(F.col("p_name").alias("name")))
    spans = F.filter(layout.segments(F.col("text"), _SEGMENTS, _ORDER_LINE), lambda x: x["kind"] == "work")
    rows = rows.select("candidate", spans.alias("spans"), "hits").withColumn("pairs", within(F.col("spans"), F.col("hits")))
    named = F.transform("pairs", lambda p: F.struct(F.get("spans", p["a"])["number"].alias("number"), F.get("hits", p["b"])["name"].alias("name")))
    pairs = rows.select("candidate", F.inline(named))
    return pairs.groupBy("candidate", "number").agg(F.count("*").alias("n_mentions"), F.count_distinct("name").alias("n_names"))
