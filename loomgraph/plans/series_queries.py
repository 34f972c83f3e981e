"""Series over orders by month and events by day."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from loomgraph.operators import series
from loomgraph.plans.registry import registry
from loomgraph.sources.tables import load

QUERIES, ORACLES, query = registry()

_MONTHLY = """m AS (SELECT c_mktsegment AS job, year(o_orderdate) * 12 + month(o_orderdate) AS idx, count(*)::DOUBLE AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def monthly(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").selectExpr("o_custkey AS c_custkey", "year(o_orderdate) * 12 + month(o_orderdate) AS idx")
    return orders.join(load(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("job")), "c_custkey").groupBy("job", "idx").agg(F.count("*").cast("double").alias("v"))


# purchases of a user by day: days without one are gaps
_SPARSE = "s AS (SELECT user_id, date_diff('day', DATE '2024-01-01', ts::DATE) AS day, round(sum(value), 4) AS v FROM events WHERE event_type = 'purchase' GROUP BY ALL)"


def sparse(spark, sf_dir):
    rows = load(spark, sf_dir, "events").where("event_type = 'purchase'")
    return rows.groupBy("user_id", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01")).alias("day")).agg(F.round(F.sum("value"), 4).alias("v"))


@query("window_label", "SELECT strftime(o_orderdate, '%Y-%m') AS window, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS quarter, min(date_trunc('month', o_orderdate))::DATE AS start_date, max(last_day(o_orderdate)) AS end_date, count(*) AS n FROM orders GROUP BY 1, 2")
def window_label(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d"))
    return rows.groupBy(F.date_format("d", "yyyy-MM").alias("window"), F.concat(F.year("d"), F.lit("-Q"), F.quarter("d")).alias("quarter")).agg(F.min(F.trunc("d", "month")).alias("start_date"), F.max(F.last_day("d")).alias("end_date"), F.count("*").alias("n"))


@query("prev_window", """WITH l AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS label, date_trunc('month', o_orderdate) AS d, false AS q FROM orders UNION SELECT DISTINCT year(o_orderdate) || '-Q' || quarter(o_orderdate), date_trunc('quarter', o_orderdate), true FROM orders)
SELECT label, CASE WHEN q THEN year(d - INTERVAL 3 MONTH) || '-Q' || quarter(d - INTERVAL 3 MONTH) ELSE strftime(d - INTERVAL 1 MONTH, '%Y-%m') END AS previous FROM l""")
def prev_window(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select(F.explode(F.array(F.date_format("o_orderdate", "yyyy-MM"), F.concat(F.year("o_orderdate"), F.lit("-Q"), F.quarter("o_orderdate")))).alias("label")).distinct()
    return rows.select("label", series.previous_label(F.col("label")).alias("previous"))


@query("status_trend", f"WITH {_MONTHLY}, p AS (SELECT *, lag(v) OVER (PARTITION BY job ORDER BY idx) AS b FROM m) SELECT job, idx, CASE WHEN b > 0 AND v / b > 1.03 THEN 'strengthening' WHEN b > 0 AND v / b < 0.97 THEN 'weakening' ELSE 'active' END AS status FROM p")
def status_trend(spark, sf_dir):
    return monthly(spark, sf_dir).withColumn("status", series.status(["job"], "idx", "v")).drop("v")


@query("change_events", f"WITH {_MONTHLY}, p AS (SELECT *, lag(v) OVER (PARTITION BY job ORDER BY idx) AS b FROM m), k AS (SELECT job, idx, CASE WHEN coalesce(b, 0) <= 0 THEN CASE WHEN v > 0 THEN 'add' END WHEN abs(v / b - 1) >= 0.08 THEN 'modify' END AS kind, v FROM p) SELECT * FROM k WHERE kind IS NOT NULL")
def change_events(spark, sf_dir):
    return series.change_events(monthly(spark, sf_dir), ["job"], "idx", "v")


@query("relative_to_last", f"WITH {_MONTHLY} SELECT job, idx, round(v / last_value(v) OVER (PARTITION BY job ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 6) AS r FROM m")
def relative_to_last(spark, sf_dir):
    return monthly(spark, sf_dir).select("job", "idx", F.round(series.relative_to_last(["job"], "idx", "v"), 6).alias("r"))


@query("first_positive_month", f"WITH {_MONTHLY} SELECT job, min(idx) FILTER (v > 0) AS first FROM m GROUP BY job")
def first_positive_month(spark, sf_dir):
    return monthly(spark, sf_dir).groupBy("job").agg(F.min(F.when(F.col("v") > 0, F.col("idx"))).alias("first"))


@query("decay_factor", f"WITH {_MONTHLY} SELECT DISTINCT job, round(least(1, greatest(0, last_value(v) OVER w / max(v) OVER w)), 6) AS factor FROM m WINDOW w AS (PARTITION BY job ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def decay_factor(spark, sf_dir):
    return monthly(spark, sf_dir).groupBy("job").agg(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.max_by("v", "idx") / F.max("v"))), 6).alias("factor"))


@query("layer_peak_norm", f"WITH {_MONTHLY} SELECT job, idx, round(v / max(v) OVER (), 6) AS r FROM m")
def layer_peak_norm(spark, sf_dir):
    rows = monthly(spark, sf_dir)
    return rows.join(F.broadcast(rows.agg(F.max("v").alias("peak")))).select("job", "idx", F.round(F.col("v") / F.col("peak"), 6).alias("r"))


@query("consecutive_diff", f"WITH {_SPARSE} SELECT user_id, day, CASE WHEN day - lag(day) OVER w = 1 THEN round(v - lag(v) OVER w, 4) END AS diff FROM s WINDOW w AS (PARTITION BY user_id ORDER BY day)")
def consecutive_diff(spark, sf_dir):
    return sparse(spark, sf_dir).select("user_id", "day", F.round(series.difference(["user_id"], "day", "v"), 4).alias("diff"))


@query("dense_calendar", f"WITH {_SPARSE} SELECT a.user_id, x.day, s.v FROM (SELECT DISTINCT user_id FROM s) a CROSS JOIN (SELECT DISTINCT day FROM s) x LEFT JOIN s ON s.user_id = a.user_id AND s.day = x.day")
def dense_calendar(spark, sf_dir):
    return series.dense(sparse(spark, sf_dir), ["user_id"], "day", "v")


@query("baseline_compare", f"WITH {_MONTHLY}, p AS (SELECT job, max(v) FILTER (idx = 1995 * 12 + 6) AS a, max(v) FILTER (idx = 1996 * 12 + 6) AS b FROM m GROUP BY job) SELECT job, CASE WHEN coalesce(a, 0) = 0 THEN 'new' WHEN coalesce(b, 0) = 0 THEN 'gone' WHEN b / a > 1.04 THEN 'up' WHEN b / a < 0.96 THEN 'down' ELSE 'flat' END AS state FROM p")
def baseline_compare(spark, sf_dir):
    at = lambda y: F.coalesce(F.max(F.when(F.col("idx") == y * 12 + 6, F.col("v"))), F.lit(0.0))
    rows = monthly(spark, sf_dir).groupBy("job").agg(at(1995).alias("a"), at(1996).alias("b"))
    ratio = F.try_divide("b", "a")
    return rows.select("job", F.when(F.col("a") == 0, "new").when(F.col("b") == 0, "gone").when(ratio > 1.04, "up").when(ratio < 0.96, "down").otherwise("flat").alias("state"))


@query("quarter_rollup", f"WITH {_MONTHLY}, s AS (SELECT job, idx, v / sum(v) OVER (PARTITION BY idx) AS share, (idx - 1) // 3 AS q FROM m), a AS (SELECT job, q, avg(share) AS x FROM s GROUP BY ALL), l AS (SELECT max(q) AS last FROM a) SELECT job, q, round(x / sum(x) OVER (PARTITION BY q), 6) AS share FROM a, l WHERE q > last - 8")
def quarter_rollup(spark, sf_dir):
    shares = monthly(spark, sf_dir).withColumn("share", F.col("v") / F.sum("v").over(Window.partitionBy("idx"))).withColumn("q", F.floor((F.col("idx") - 1) / 3))
    quarters = shares.groupBy("job", "q").agg(F.avg("share").alias("x"))
    last = quarters.agg(F.max("q").alias("last"))
    kept = quarters.join(F.broadcast(last)).where("q > last - 8")
    return kept.select("job", "q", F.round(F.col("x") / F.sum("x").over(Window.partitionBy("q")), 6).alias("share"))


@query("topk_renorm", "WITH c AS (SELECT c_mktsegment AS job, p_brand AS skill, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY n DESC, skill) AS rank FROM c) SELECT job, skill, n, rank, round(n::DOUBLE / sum(n) OVER (PARTITION BY job), 6) AS share FROM r WHERE rank <= 12")
def topk_renorm(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("skill"))
    customer = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("job"))
    counts = lines.join(orders, "l_orderkey").join(customer, "c_custkey").join(part, "l_partkey").groupBy("job", "skill").agg(F.count("*").alias("n"))
    return series.top_k_shares(counts, ["job"], "n", "skill", 12).withColumn("share", F.round("share", 6))


_DAILY = "d AS (SELECT event_type, date_diff('day', DATE '2024-01-01', ts::DATE) AS day, sum(value)::DOUBLE AS v FROM events GROUP BY ALL)"


def daily(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("event_type", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01")).alias("day")).agg(F.sum("value").alias("v"))


@query("best_lag", f"""WITH {_DAILY}, p AS (SELECT k AS lag, corr(a.v, b.v) AS r, count(*) AS n FROM d a, range(1, 11) t(k), d b WHERE a.event_type = 'view' AND b.event_type = 'purchase' AND b.day = a.day + k GROUP BY k)
SELECT lag::INT AS lag, round(r, 6) AS r, n FROM p WHERE n >= 8 AND r >= -1 ORDER BY r DESC, lag LIMIT 1""")
def best_lag(spark, sf_dir):
    rows = daily(spark, sf_dir)
    found = series.best_lag(rows.where("event_type = 'view'"), rows.where("event_type = 'purchase'"), "day", "v", 10, least=-1.0)
    return found.withColumn("r", F.round("r", 6))


@query("lead_quantile", """WITH f AS (SELECT user_id, min(ts) FILTER (event_type = 'view') AS a, min(ts) FILTER (event_type = 'purchase') AS b FROM events GROUP BY user_id), l AS (SELECT date_diff('day', a::DATE, b::DATE) AS lag FROM f WHERE b > a), s AS (SELECT list(lag ORDER BY lag) AS x, list(lag ORDER BY lag) FILTER (lag > 1) AS y FROM l)
SELECT p, CASE WHEN len(y) > 0 THEN y[floor(len(y) * p)::INT + 1] ELSE x[floor(len(x) * p)::INT + 1] END AS lag FROM s, (VALUES (0.25::DOUBLE), (0.5), (0.75)) q(p)""")
def lead_quantile(spark, sf_dir):
    at = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("ts")))
    first = load(spark, sf_dir, "events").groupBy("user_id").agg(at("view").alias("a"), at("purchase").alias("b")).where("b > a")
    counts = first.select(F.datediff(F.col("b").cast("date"), F.col("a").cast("date")).alias("lag")).groupBy("lag").count()
    # counts by lag, not lags by user: a histogram of days
    waited = counts.agg(F.coalesce(F.sum(F.when(F.col("lag") > 1, F.col("count"))), F.lit(0)).alias("w"))
    chosen = counts.join(F.broadcast(waited)).where("w = 0 OR lag > 1")
    up_to = chosen.withColumn("hi", F.sum("count").over(Window.orderBy("lag"))).withColumn("lo", F.col("hi") - F.col("count")).withColumn("total", F.sum("count").over(Window.partitionBy()))
    quantiles = spark.createDataFrame([(0.25,), (0.5,), (0.75,)], "p double")
    place = F.floor(F.col("total") * F.col("p"))
    return up_to.join(F.broadcast(quantiles), (place >= F.col("lo")) & (place < F.col("hi"))).select("p", F.col("lag").cast("long").alias("lag"))


@query("nullable_totals", f"WITH {_MONTHLY}, n AS (SELECT idx, CASE WHEN idx % 4 = 0 THEN NULL WHEN (idx + length(job)) % 3 = 0 THEN NULL ELSE v END AS v FROM m) SELECT idx, sum(v) AS total FROM n GROUP BY idx")
def nullable_totals(spark, sf_dir):
    value = F.when((F.col("idx") % 4 != 0) & ((F.col("idx") + F.length("job")) % 3 != 0), F.col("v"))
    return monthly(spark, sf_dir).groupBy("idx").agg(F.sum(value).alias("total"))


@query("event_tumbling", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start_ts, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def event_tumbling(spark, sf_dir):
    rows = load(spark, sf_dir, "events")
    return rows.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start_ts"), "event_type", "n", "total")


@query("event_sliding", "SELECT time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR * k AS start_ts, count(*) AS n FROM events, range(0, 4) t(k) GROUP BY ALL")
def event_sliding(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy(F.window("ts", "24 hours", "6 hours").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start_ts"), "n")


@query("event_session", """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM s)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM g GROUP BY user_id, session""")
def event_session(spark, sf_dir):
    rows = load(spark, sf_dir, "events")
    grouped = rows.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    return grouped.drop("w")


@query("event_dedup", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type, ts::DATE")
def event_dedup(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("user_id", "event_type", F.col("ts").cast("date").alias("d")).agg(F.min("event_id").alias("event_id")).drop("d")
