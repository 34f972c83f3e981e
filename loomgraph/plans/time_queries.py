"""Strengths at every month's end from order lines as evidence, overlapping times and spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import layout
from loomgraph.operators import asof, intervals, policy
from loomgraph.operators.mentions import mentions
from loomgraph.plans.registry import registry
from loomgraph.plans.resumes import RESUME_SQL, experiences, resumes
from loomgraph.sources.interim import settle
from loomgraph.sources.tables import load

QUERIES, ORACLES, query = registry()

#: A part is an entity of its type's layer; an order's line is evidence of it, some without a date.
_KIND_COLUMNS = (
    "CASE WHEN l_linenumber % 7 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS date",
    "CASE WHEN o_orderpriority = '1-URGENT' THEN 'jd' WHEN o_orderpriority < '4' THEN 'papers' ELSE 'news' END AS source",
    "CASE o_orderpriority WHEN '2-HIGH' THEN 'B' WHEN '3-MEDIUM' THEN 'C' ELSE '' END AS tier",
    "CASE WHEN l_quantity < 20 THEN 'low' WHEN l_quantity < 40 THEN 'medium' ELSE 'high' END AS confidence",
)
_EVIDENCE = f"evidence AS (SELECT p_partkey AS entity, p_type AS layer, {", ".join(_KIND_COLUMNS)} FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"
_WINDOWS = "windows AS (SELECT DISTINCT last_day(o_orderdate) AS end_date FROM orders)"
_CONTRIB = """CASE WHEN source = 'jd' THEN 1.0::DOUBLE WHEN tier = 'B' THEN 0.5::DOUBLE WHEN tier = 'C' THEN 0.3::DOUBLE ELSE 0.4::DOUBLE END
  * CASE confidence WHEN 'high' THEN 1.0::DOUBLE WHEN 'medium' THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END
  * CASE WHEN date IS NULL THEN 0.5::DOUBLE ELSE pow(0.5::DOUBLE, date_diff('day', date, end_date)::DOUBLE / CASE WHEN source = 'jd' THEN 365 WHEN tier <> '' THEN 730 ELSE 180 END) END"""
#: Each window recomputed from all evidence that it knows.
_PAIRS = f"{_EVIDENCE}, {_WINDOWS}, pairs AS (SELECT entity, layer, source, date, end_date, {_CONTRIB} AS c FROM evidence JOIN windows ON date IS NULL OR date <= end_date)"


def evidence(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = lines.join(load(spark, sf_dir, "part").selectExpr("p_partkey AS entity", "p_type AS layer"), F.col("l_partkey") == F.col("entity"))
    return rows.selectExpr("entity", "layer", *_KIND_COLUMNS)


def windows(spark, sf_dir):
    return load(spark, sf_dir, "orders").select(F.last_day("o_orderdate").alias("end_date"))


@query("asof_strengths", f"WITH {_PAIRS} SELECT entity, end_date, count(*) AS n, round(1 - product(1 - c) + 1e-9::DOUBLE, 4) AS strength, round(max(c) + 1e-9::DOUBLE, 4) AS max_contrib, min(date) AS first_seen, max(date) AS last_seen FROM pairs GROUP BY ALL")
def asof_strengths(spark, sf_dir):
    """Rounded as in the SQL: what lies half-way (0.49425) goes up in either engine."""
    rows = asof.strengths_at(evidence(spark, sf_dir), windows(spark, sf_dir), ["entity"], digits=None)
    return rows.withColumns({c: F.round(F.col(c) + 1e-9, 4) for c in ("strength", "max_contrib")})


_SERIES = f"""WITH {_PAIRS}, strengths AS (SELECT entity, layer, source, end_date, 1 - product(1 - c) AS strength FROM pairs GROUP BY ALL),
lines AS (SELECT entity, layer, last_day(date) AS end_date, count(*) AS n FROM evidence WHERE source = 'jd' AND date IS NOT NULL GROUP BY ALL),
demand AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY layer, end_date) AS value FROM lines), peaks AS (SELECT layer, max(value) AS peak FROM demand GROUP BY layer),
series AS (SELECT entity, layer, end_date, coalesce(max(strength) FILTER (source = 'papers'), 0) AS paper, coalesce(max(strength) FILTER (source = 'news'), 0) AS news, coalesce(max(value / peak), 0) AS jd
  FROM strengths FULL JOIN (SELECT * FROM demand JOIN peaks USING (layer)) USING (entity, layer, end_date) GROUP BY ALL)"""


def _series(spark, sf_dir):
    rows = settle(evidence(spark, sf_dir), "evidence")
    parts = asof.parts_of(rows)
    counted = settle(rows.where("source = 'jd' AND date IS NOT NULL").groupBy("entity", "layer", F.last_day("date").alias("end_date")).agg(F.count("*").alias("n")), "counted")
    totals = counted.groupBy("layer", "end_date").agg(F.sum("n").alias("total"))
    demand = counted.join(F.broadcast(totals), ["layer", "end_date"]).select("entity", "layer", "end_date", (F.col("n") / F.col("total")).alias("value"))
    return asof.signal_series(asof.strengths_at(rows, windows(spark, sf_dir), ["entity", "layer", "source"], digits=None, parts=parts), demand, parts=parts)


@query("signal_series", f"{_SERIES} SELECT entity, layer, end_date, round(paper + 1e-9::DOUBLE, 5) AS paper, round(news + 1e-9::DOUBLE, 5) AS news, round(jd + 1e-9::DOUBLE, 5) AS jd, round(greatest(0, 0.7::DOUBLE * paper + 0.3::DOUBLE * news - jd) + 1e-9::DOUBLE, 5) AS gap FROM series")
def signal_series(spark, sf_dir):
    return _series(spark, sf_dir).withColumns({c: F.round(F.col(c) + 1e-9, 5) for c in ("paper", "news", "jd", "gap")})


@query("signal_freshness", f"{_SERIES} SELECT entity, round(arg_max(0.7::DOUBLE * paper + 0.3::DOUBLE * news, end_date) / nullif(max(0.7::DOUBLE * paper + 0.3::DOUBLE * news), 0), 6) AS freshness FROM series GROUP BY entity")
def signal_freshness(spark, sf_dir):
    return asof.freshness(_series(spark, sf_dir)).withColumn("freshness", F.round("freshness", 6))


@query("latest_window", "SELECT coalesce((SELECT strftime(max(o_orderdate), '%Y-%m') FROM orders), (SELECT strftime(max(ts), '%Y-%m') FROM events)) AS window")
def latest_window(spark, sf_dir):
    return asof.latest_window(load(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("date")), load(spark, sf_dir, "events").select(F.col("ts").alias("date")))


@query("parallel_experiences", f"""WITH {RESUME_SQL}, x AS (SELECT candidate, orderkey, date_diff('day', DATE '1970-01-01', started) AS s, date_diff('day', DATE '1970-01-01', ended) + 1 AS e FROM experiences)
SELECT a.candidate, a.orderkey AS first, b.orderkey AS second, least(a.e, b.e) - greatest(a.s, b.s) AS days, round((least(a.e, b.e) - greatest(a.s, b.s))::DOUBLE / least(a.e - a.s, b.e - b.s), 6) AS share
FROM x a JOIN x b ON a.candidate = b.candidate AND a.orderkey < b.orderkey AND a.s < b.e AND b.s < a.e WHERE a.e > a.s AND b.e > b.s""")
def parallel_experiences(spark, sf_dir):
    """Experiences of one candidate at the same time, with the days they share."""
    day = lambda c: F.datediff(c, F.lit("1970-01-01"))
    rows = experiences(spark, sf_dir).select("candidate", "orderkey", day("started").alias("start"), (day("ended") + 1).alias("end"))
    pairs = intervals.overlapping(rows, rows, ["candidate"]).where("a.orderkey < b.orderkey")
    share = F.col("overlap") / F.least(F.col("a.end") - F.col("a.start"), F.col("b.end") - F.col("b.start"))
    return pairs.select("candidate", F.col("a.orderkey").alias("first"), F.col("b.orderkey").alias("second"), F.col("overlap").alias("days"), F.round(share, 6).alias("share"))


@query("overlapping_events", """WITH x AS (SELECT event_id, event_type, epoch(date_trunc('second', ts))::BIGINT AS s, epoch(date_trunc('second', ts))::BIGINT + floor(value * 60)::BIGINT AS e FROM events)
SELECT a.event_id AS outage, count(*) AS n, sum(least(a.e, b.e) - greatest(a.s, b.s))::BIGINT AS seconds FROM x a JOIN x b ON a.event_type = 'error' AND b.event_type = 'purchase' AND a.s < b.e AND b.s < a.e WHERE a.e > a.s AND b.e > b.s GROUP BY ALL""")
def overlapping_events(spark, sf_dir):
    """Purchases that go on (a minute for each unit of value) while an error does, over all users: an overlap join without any key."""
    start = F.unix_seconds(F.date_trunc("second", "ts"))
    rows = load(spark, sf_dir, "events").select("event_id", "event_type", start.alias("start"), (start + F.floor(F.col("value") * 60)).alias("end"))
    pairs = intervals.overlapping(rows.where("event_type = 'error'"), rows.where("event_type = 'purchase'"))
    return pairs.groupBy(F.col("a.event_id").alias("outage")).agg(F.count("*").alias("n"), F.sum("overlap").alias("seconds"))


_POLICY = policy.EvidencePolicy(opening="Opening", headings=("Summary", "Experience"), result_only=("Summary",), result_text="above plan \\(", campus="Experience", campus_admin="STANDARD|PROMO", campus_technical="widget|gear",
                                eligible=("Experience",), actions=("Delivered",), technical=("widget", "gear", "ring", "bolt", "plate", "PROMO", "STANDARD", "ECONOMY"), duties=("baseline",), shortest=8, longest=60)

_LINES = f"""{RESUME_SQL}, cut AS (SELECT candidate, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS i FROM resumes),
at AS (SELECT candidate, i, trim(raw) AS line, sum(length(raw) + 1) OVER (PARTITION BY candidate ORDER BY i) - length(raw) - 1 + length(raw) - length(ltrim(raw)) AS start FROM cut),
lines AS (SELECT candidate, line AS text, start::INT AS start, (start + length(line))::INT AS "end", last_value(CASE WHEN line IN ('Summary', 'Experience') THEN line END IGNORE NULLS) OVER (PARTITION BY candidate ORDER BY i) AS section FROM at WHERE line <> '')"""


def _evidence_lines(spark, sf_dir):
    texts = resumes(spark, sf_dir).select(F.col("candidate").alias("doc"), "text")
    rows = texts.select("doc", F.inline(layout.lines(F.col("text"), _POLICY.headings, _POLICY.opening)))
    told = rows.where("text LIKE '- Delivered%' OR section = 'Summary'").select("doc", F.regexp_extract("text", "([a-z]+) as", 1).alias("ability"), "text", "start", "end")
    unplaced = texts.select("doc", F.lit("widget").alias("ability"), F.lit("says so").alias("text"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    return texts, told.unionByName(unplaced)


@query("direct_evidence", f"""WITH {_LINES.replace("at AS", "placed AS").replace("FROM at", "FROM placed")},
e AS (SELECT candidate, regexp_extract(text, '([a-z]+) as', 1) AS ability, text, start, "end", section FROM lines WHERE (text LIKE '- Delivered%' OR section = 'Summary') AND text NOT IN ('Summary', 'Experience')
  UNION ALL SELECT candidate, 'widget', 'says so', NULL, NULL, NULL FROM resumes),
k AS (SELECT *, section IS NULL OR NOT (section = 'Summary' OR contains(text, 'above plan (') OR section = 'Experience' AND regexp_matches(text, 'STANDARD|PROMO') AND NOT regexp_matches(text, 'widget|gear')) AS kept FROM e)
SELECT candidate, ability, count(*) AS n, count(*) FILTER (kept) AS n_kept, count(section) > 0 AND count(*) FILTER (kept AND section IS NOT NULL) = 0 AS dropped FROM k GROUP BY candidate, ability""")
def direct_evidence(spark, sf_dir):
    rows = policy.direct_evidence(*_evidence_lines(spark, sf_dir), _POLICY)
    return rows.groupBy(F.col("doc").alias("candidate"), "ability").agg(F.count("*").alias("n"), F.count_if("kept").alias("n_kept"), F.first("dropped").alias("dropped"))


@query("uncovered_lines", f"""WITH {_LINES.replace("at AS", "placed AS").replace("FROM at", "FROM placed")},
tasks AS (SELECT *, regexp_extract(text, '^- Delivered [0-9]+ (.*) as ', 1) AS name FROM lines WHERE text LIKE '- Delivered%'),
scored AS (SELECT *, CASE WHEN contains(text, '9% above') THEN 1.0::DOUBLE ELSE length(name)::DOUBLE / length(text) END AS covered,
  list_sum([contains(text, m)::INT FOR m IN {list(_POLICY.technical)}])::INT AS technical FROM tasks WHERE length(text) BETWEEN 8 AND 60 AND NOT contains(text, 'above plan (')),
kept AS (SELECT *, row_number() OVER (PARTITION BY candidate, regexp_replace(text, '\\s', '', 'g') ORDER BY start) AS nth FROM scored WHERE technical > 0 AND covered < 0.6::DOUBLE),
ranked AS (SELECT candidate, section, text, start, covered, 2.0::DOUBLE + technical + 4.0::DOUBLE * (1 - covered) + least(length(text)::DOUBLE / 100, 1.5::DOUBLE) AS score FROM kept WHERE nth = 1)
SELECT * FROM (SELECT candidate, row_number() OVER (PARTITION BY candidate ORDER BY round(score, 9) DESC, start)::INT AS rank, text, start, round(covered, 6) AS covered, round(score, 6) AS score FROM ranked) WHERE rank <= 4""")
def uncovered_lines(spark, sf_dir):
    """Task lines that neither a part's name nor, where they tell of 9 %, the whole line as evidence covers."""
    texts, told = _evidence_lines(spark, sf_dir)
    names = load(spark, sf_dir, "part").select(F.col("p_name").alias("name"))
    spans = mentions(texts, "doc", "text", names, rule="any").select("doc", "start", "end").unionByName(told.where("text LIKE '%9\\% above%'").select("doc", "start", "end"))
    found = policy.uncovered_lines(texts, spans, _POLICY)
    return found.select(F.col("doc").alias("candidate"), "rank", "text", "start", F.round("covered", 6).alias("covered"), F.round("score", 6).alias("score"))
