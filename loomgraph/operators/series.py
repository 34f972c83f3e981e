"""Monthly and daily series: labels, dense calendars, changes, trends, lags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def previous_label(label: Column) -> Column:
    """Label of the month or quarter before, with the year's wrap: `2024-01` -> `2023-12`, `2024-Q1` -> `2023-Q4`."""
    year = F.substring(label, 1, 4).cast("int")
    quarter = F.regexp_extract(label, r"-Q(\d)$", 1)
    month = F.when(quarter == "", F.substring(label, 6, 2)).try_cast("int")
    q = quarter.try_cast("int")
    by_quarter = F.when(q == 1, F.concat((year - 1).cast("string"), F.lit("-Q4"))).otherwise(F.concat(year.cast("string"), F.lit("-Q"), (q - 1).cast("string")))
    by_month = F.when(month == 1, F.concat((year - 1).cast("string"), F.lit("-12"))).otherwise(F.format_string("%04d-%02d", year, month - 1))
    return F.when(quarter != "", by_quarter).otherwise(by_month)


def month_index(label: Column) -> Column:
    return F.substring(label, 1, 4).cast("int") * 12 + F.substring(label, 6, 2).cast("int")


def dense(series: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """Every key at every index that any key has; what a key lacks is null (not measured), never zero."""
    axis = series.select(index).distinct()
    return series.select(*keys).distinct().crossJoin(F.broadcast(axis)).join(series, [*keys, index], "left").select(*keys, index, value)


def _along(keys: list[str], index: str):
    return Window.partitionBy(*keys).orderBy(index)


def status(keys: list[str], index: str, value: str) -> Column:
    """strengthening or weakening when the ratio to the value before leaves [0.97, 1.03], else active."""
    before = F.lag(value).over(_along(keys, index))
    ratio = F.when(before > 0, F.col(value) / before)
    return F.when(ratio > 1.03, "strengthening").when(ratio < 0.97, "weakening").otherwise("active")


def change_events(series: DataFrame, keys: list[str], index: str, value: str, least: float = 0.08) -> DataFrame:
    """(keys, index, kind, value): `add` when a value follows none or zero, `modify` when it moves by `least` or more."""
    rows = series.withColumn("_before", F.lag(value).over(_along(keys, index)))
    moved = F.abs(F.col(value) / F.nullif(F.col("_before"), F.lit(0.0)) - 1) >= least
    kind = F.when(F.coalesce("_before", F.lit(0.0)) <= 0, F.when(F.col(value) > 0, "add")).when(moved, "modify")
    return rows.where(F.col(value).isNotNull()).withColumn("kind", kind).where("kind IS NOT NULL").select(*keys, index, "kind", value)


def relative_to_last(keys: list[str], index: str, value: str) -> Column:
    last = F.last(value).over(_along(keys, index).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.when(last > 0, F.col(value) / last)


def difference(keys: list[str], index: str, value: str) -> Column:
    """Difference to the step just before; null across gaps."""
    w = _along(keys, index)
    return F.when(F.col(index) - F.lag(index).over(w) == 1, F.col(value) - F.lag(value).over(w))


def top_k_shares(rows: DataFrame, by: list[str], value: str, item: str, k: int) -> DataFrame:
    """The k largest items of each group (ties by item) with their shares among themselves."""
    order = Window.partitionBy(*by).orderBy(F.desc(value), item)
    top = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.withColumn("share", F.col(value) / F.sum(value).over(Window.partitionBy(*by)))


def best_lag(leader: DataFrame, follower: DataFrame, index: str, value: str, lags: int, least: float = 0.35, n: int = 8) -> DataFrame:
    """(lag, r, n) of the shift of the leader that correlates best with the follower; ties to the smaller lag.

    Shifts are rows of a literal table, so all correlations are one grouped aggregation.
    """
    shifts = leader.sparkSession.range(1, lags + 1).select(F.col("id").cast("int").alias("lag"))
    moved = leader.select(F.col(index).alias("_i"), F.col(value).alias("x")).crossJoin(F.broadcast(shifts)).withColumn("at", F.col("_i") + F.col("lag"))
    pairs = moved.join(follower.select(F.col(index).alias("at"), F.col(value).alias("y")), "at").where("x IS NOT NULL AND y IS NOT NULL")
    scored = pairs.groupBy("lag").agg(F.corr("x", "y").alias("r"), F.count("*").alias("n"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    good = scored.where((F.col("n") >= n) & (F.col("sx") > 0) & (F.col("sy") > 0) & (F.col("r") >= least))
    return good.orderBy(F.desc("r"), "lag").limit(1).select("lag", "r", "n")
