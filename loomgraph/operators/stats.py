"""Distributions: shares, multi-label shares, grouping sets, products of attributes, facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def shares(counts: DataFrame, by: list[str], n: str, digits: int = 6) -> DataFrame:
    """Adds `share` of n within each group."""
    return counts.withColumn("share", F.round(F.col(n) / F.sum(n).over(Window.partitionBy(*by)), digits))


def multi_label_share(rows: DataFrame, labels: Column, digits: int = 6) -> DataFrame:
    """(label, n, share): share of rows that hold a label; shares may sum to more than 1. The total is a scalar join."""
    total = rows.agg(F.count("*").alias("total"))
    counts = rows.select(F.explode(F.array_distinct(labels)).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(total)).select("label", "n", F.round(F.col("n") / F.col("total"), digits).alias("share"))


def facet_filter(distribution: DataFrame, entity: str, picks: dict[str, list[str]]) -> DataFrame:
    """Entities that are biased to the picked buckets in every dimension: there the picked shares sum to at least picked / all
    buckets of the dimension. `distribution` is (entity, attr, bucket, share)."""
    sizes = distribution.groupBy("attr").agg(F.countDistinct("bucket").alias("size"))
    wanted = F.lit(False)
    for attr, buckets in picks.items():
        wanted = wanted | ((F.col("attr") == attr) & F.col("bucket").isin(buckets))
    rows = distribution.where(F.col("attr").isin(list(picks))).join(F.broadcast(sizes), "attr")
    chosen = F.create_map(*[F.lit(x) for attr, buckets in picks.items() for x in (attr, float(len(buckets)))])
    held = rows.groupBy(entity, "attr").agg(F.coalesce(F.sum(F.when(wanted, F.col("share"))), F.lit(0.0)).alias("got"), (F.max(chosen[F.col("attr")]) / F.max("size")).alias("need"))
    return held.groupBy(entity).agg(F.count_if(F.col("got") >= F.col("need") - 1e-12).alias("ok")).where(F.col("ok") == len(picks)).select(entity)


def attribute_product(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """(by, a, b, n) = posts * share of a * share of b, the attributes taken as independent."""
    return left.join(right, by).select(by, "a", "b", (F.col("posts") * F.col("share_a") * F.col("share_b")).alias("n"))


def tail_trim(rows: DataFrame, value: str, share: float = 0.025) -> DataFrame:
    """Rows at `share` of the peak or more, with the number of rows trimmed."""
    peak = rows.agg(F.max(value).alias("_peak"))
    marked = rows.join(F.broadcast(peak)).withColumn("_keep", F.col(value) >= share * F.col("_peak"))
    trimmed = marked.agg(F.count_if(~F.col("_keep")).alias("trimmed"))
    return marked.where("_keep").drop("_peak", "_keep").join(F.broadcast(trimmed))
