"""Order statistics of groups without sorting them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomgraph.sources.interim import settle

#: Bits of a value by which rows are counted in one pass.
BITS = 16


def _ordered_bits(values: pa.Array) -> pa.Array:
    """Doubles as longs in the same order; -0.0 is 0.0, NaN is the largest."""
    bits = (values.to_numpy(zero_copy_only=False) + 0.0).view(np.int64)
    return pa.array(bits ^ (bits >> 63 & np.int64(2**63 - 1)))


def _value(bits: pa.Array) -> pa.Array:
    own = bits.to_numpy(zero_copy_only=False)
    return pa.array((own ^ (own >> 63 & np.int64(2**63 - 1))).view(np.float64))


def values_at(rows: DataFrame, value: str, by: list[str], ranks: dict[str, Column]) -> DataFrame:
    """(by..., n, one column per rank): the value at each rank (from 0) of the group's sorted values; rank columns are expressions of `n`,
    the number of values. Null values don't count, groups with null keys do.

    Rows are counted by the first 16 bits of their value, which include its magnitude, then those that begin as the value at a rank does by
    the next 16 bits, and so on: after four passes the value is known. Nothing is sorted, equal values are counted where they are,
    and outliers, however far, are in bits of their own.
    """
    keyed = rows.where(F.col(value).isNotNull()).select(F.to_json(F.struct(*by), {"ignoreNullFields": "false"}).alias("_key"), *by, F.arrow_udf(_ordered_bits, "long")(F.col(value).cast("double")).alias("_bits"))
    # distinct values with their counts: what all passes read
    counted = settle(keyed.groupBy("_key", "_bits").agg(F.count("*").alias("_c"), *[F.first(b).alias(b) for b in by]), "values")
    sizes = settle(counted.groupBy("_key").agg(F.sum("_c").alias("n"), *[F.first(b).alias(b) for b in by]), "sizes")
    named = F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()])
    wanted = sizes.select("_key", F.explode(named).alias("_r")).select("_key", "_r.name", "_r.rank", F.lit(0).cast("long").alias("_begins"))
    for shift in range(64 - BITS, -1, -BITS):
        begins = F.shiftright("_bits", shift + BITS) if shift + BITS < 64 else F.lit(0).cast("long")
        held = counted.select("_key", begins.alias("_begins"), F.shiftright("_bits", shift).alias("_next"), "_c").join(wanted.select("_key", "_begins").distinct(), ["_key", "_begins"], "left_semi")
        counts = held.groupBy("_key", "_begins", "_next").agg(F.sum("_c").alias("_c"))
        up = F.sum("_c").over(Window.partitionBy("_key", "_begins").orderBy("_next").rowsBetween(Window.unboundedPreceding, 0))
        found = counts.withColumn("_up", up).join(wanted, ["_key", "_begins"]).where("rank < _up AND rank >= _up - _c")
        wanted = settle(found.select("_key", "name", (F.col("rank") - F.col("_up") + F.col("_c")).alias("rank"), F.col("_next").alias("_begins")), "ranks")
    told = wanted.withColumn("_v", F.arrow_udf(_value, "double")("_begins"))
    pivoted = told.groupBy("_key").agg(*[F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in ranks])
    return pivoted.join(sizes, "_key").select(*by, "n", *ranks)
