"""Deterministic samples: by hash order, stratified with weights, capped by group, allocated by largest remainder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def hash_order(key: Column, salt: str) -> Column:
    """MD5 of key and salt as fixed-width lower-case hex, which orders like the number."""
    return F.md5(F.concat(key.cast("string"), F.lit(salt)))


def hash_top_k(keys: DataFrame, key: str, cap: int, salt: str) -> DataFrame:
    """The first `cap` keys in hash order with weight N / cap (4 digits), or all with weight 1. A larger cap keeps all of a smaller one's.

    The limit is a distributed top-k; only the count is joined, as a scalar.
    """
    n = keys.agg(F.count("*").alias("n"))
    top = keys.orderBy(hash_order(F.col(key), salt), key).limit(cap)
    w0 = F.when(F.col("n") <= cap, 1.0).otherwise(F.bround(F.col("n") / cap, 4))
    return top.join(F.broadcast(n)).withColumn("w0", w0).drop("n")


def stratified_sample(rows: DataFrame, key: str, stratum: str, cap: int, floor: int, salt: str) -> DataFrame:
    """Rows with weight n / k. rate = min(1, cap / N); strata up to `floor` rows or rate 1 stay whole, others keep
    k = min(n, max(floor, round half even of rate * n)) in hash order.

    No stratum is sorted whole: rows are counted by stratum and the first three digits of their hash, which tells the digits
    at which k is reached; rows before are in, rows after are out, and only those at the cut are ranked.
    """
    hashed = rows.withColumn("_h", hash_order(F.col(key), salt)).withColumn("_p", F.substring("_h", 1, 3))
    sums = hashed.groupBy(stratum, "_p").agg(F.count("*").alias("c"))
    whole = Window.partitionBy(stratum)
    total = sums.agg(F.sum("c").alias("total"))
    counted = sums.withColumn("n", F.sum("c").over(whole)).withColumn("up_to", F.sum("c").over(whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)))
    rate = F.least(F.lit(1.0), F.lit(float(cap)) / F.col("total"))
    k = F.when((rate >= 1) | (F.col("n") <= floor), F.col("n")).otherwise(F.least(F.col("n"), F.greatest(F.lit(floor), F.bround(rate * F.col("n"), 0).cast("long"))))
    cut = F.min(F.when(F.col("up_to") >= F.col("k"), F.struct(F.col("_p").alias("p"), (F.col("up_to") - F.col("c")).alias("before"))))
    bounds = counted.join(F.broadcast(total)).withColumn("k", k).groupBy(stratum, "n", "k").agg(cut.alias("cut"))
    placed = hashed.join(bounds.select(F.col(stratum).alias("_s"), "n", "k", "cut"), F.col(stratum).eqNullSafe(F.col("_s")))
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy("_h", key))
    at_cut = placed.where("_p = cut.p").withColumn("_r", F.col("cut.before") + rank).where("_r <= k").drop("_r")
    kept = placed.where("_p < cut.p").unionByName(at_cut)
    return kept.select(*rows.columns, F.bround(F.col("n") / F.col("k"), 4).alias("weight"))


def per_group_limit(rows: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group in a given order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def largest_remainder(sizes: DataFrame, group: str, total: int, floor: int) -> DataFrame:
    """(group, size, quota): at least min(size, floor) each, the rest of `total` in proportion to size, by largest remainder."""
    everything = Window.partitionBy()
    based = sizes.withColumn("base", F.least("size", F.lit(floor)))
    rest = F.greatest(F.lit(0), F.lit(total) - F.sum("base").over(everything))
    exact = F.col("rest") * F.col("size") / F.sum("size").over(everything)
    shared = based.withColumn("rest", rest).withColumn("exact", exact).withColumn("whole", F.floor("exact"))
    spare = F.col("rest") - F.sum("whole").over(everything)
    place = F.row_number().over(Window.orderBy(F.desc(F.col("exact") - F.col("whole")), group))
    return shared.withColumn("spare", spare).withColumn("place", place).select(group, "size", F.least("size", F.col("base") + F.col("whole") + (F.col("place") <= F.col("spare")).cast("long")).cast("long").alias("quota"))


def no_replacement_batches(rows: DataFrame, key: str, salt: str, size: int) -> DataFrame:
    """Adds batch numbers in hash order: batch b holds ranks [b * size, (b + 1) * size). Ranks come from a range partitioning's
    counts, not from one sorted partition."""
    ordered = rows.withColumn("_h", hash_order(F.col(key), salt)).withColumn("_p", F.substring("_h", 1, 2))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = ordered.groupBy("_p").count().withColumn("_s", F.coalesce(F.sum("count").over(before), F.lit(0))).select("_p", "_s")
    within = F.row_number().over(Window.partitionBy("_p").orderBy("_h", key)) - 1
    return ordered.withColumn("_w", within).join(F.broadcast(starts), "_p").withColumn("batch", F.floor((F.col("_s") + F.col("_w")) / size).cast("int")).select(*rows.columns, "batch")
