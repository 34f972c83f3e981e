"""Going on where a run ended: keys that were consumed, and chains of windows that tell what must be built again."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.sources.interim import settle

#: Bits of a Bloom filter (4 MB). More keys make it let through more, never less; what it lets through is looked up exactly.
BITS = 1 << 25
HASHES = 5


def _places(key: Column, bits: int) -> Column:
    """Places of a key's bits: two 64-bit hashes, combined."""
    one, two = F.pmod(F.xxhash64(key), F.lit(bits)), F.pmod(F.xxhash64(key, F.lit(1)), F.lit(bits)).bitwiseOR(F.lit(1))
    return F.array(*[F.pmod(one + F.lit(i) * two, F.lit(bits)) for i in range(HASHES)])


class Consumed:
    """Keys that earlier batches took, kept below a path: a part for each batch, with the batch's own bits of a Bloom filter.

    A batch that is written again replaces itself. `fresh` gives the rows of a table whose key was never taken. Most of them
    are told by the filter in their own task, without a shuffle; only what it lets through is joined with the keys.
    """

    def __init__(self, spark, path: str, bits: int = BITS):
        self.spark, self.path, self.bits = spark, path, bits

    def add(self, keys: DataFrame, batch: int, key: str = "key") -> None:
        """Keeps the distinct keys of a table that aren't null; a key that another batch has is kept by both."""
        taken = settle(keys.select(F.col(key).cast("string").alias("key")).where("key IS NOT NULL").distinct(), "taken")
        taken.write.mode("overwrite").parquet(f"{self.path}/keys/batch={batch}")
        at = taken.select(F.explode(_places(F.col("key"), self.bits)).alias("place"))
        words = at.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(place % 64 AS INT))")).alias("set"))
        words.write.mode("overwrite").parquet(f"{self.path}/bits/batch={batch}")

    def _filter(self) -> np.ndarray:
        """The bits of all batches together: `bits` / 64 words at most, whatever the number of keys."""
        words = self.spark.read.parquet(f"{self.path}/bits").groupBy("word").agg(F.bit_or("set").alias("set")).toArrow()
        found = np.zeros(self.bits // 64, np.int64)
        found[words["word"].to_numpy()] = words["set"].to_numpy()
        return found

    def maybe(self, key: Column) -> Column:
        """Whether a key may have been taken; false is certain."""
        shared = self.spark.sparkContext.broadcast(self._filter())

        def test(places: pa.Array) -> pa.Array:
            at = places.flatten().to_numpy().reshape(-1, HASHES)
            return pa.array(((shared.value[at >> 6] >> (at & 63)) & 1).all(axis=1))

        return F.arrow_udf(test, "boolean")(_places(F.coalesce(key.cast("string"), F.lit("")), self.bits))

    def fresh(self, rows: DataFrame, key: str = "key") -> DataFrame:
        """The rows whose key no batch has taken, repeats included; rows with a null key are always fresh."""
        held = rows.withColumn("_maybe", F.col(key).isNotNull() & self.maybe(F.col(key)))
        held = settle(held, "asked")
        sure = held.where("NOT _maybe").drop("_maybe")
        taken = self.spark.read.parquet(f"{self.path}/keys").select(F.col("key").alias("_key")).distinct()
        looked_up = held.where("_maybe").join(taken, F.col(key).cast("string") == F.col("_key"), "left_anti")
        return sure.unionByName(looked_up.drop("_maybe"))


def _short(value: Column) -> Column:
    """The first 60 bits of an MD5, as a number."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")


def window_digests(rows: DataFrame, window: str, columns: Sequence[str]) -> DataFrame:
    """(window, n, digest): how many rows a window has and the sum of their digests, whatever their order; repeats count."""
    value = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("∅")) for c in columns])
    return rows.groupBy(F.col(window).alias("window")).agg(F.count("*").alias("n"), F.sum(_short(value)).alias("digest")).where("window IS NOT NULL")


def chained(digests: DataFrame, params: str) -> DataFrame:
    """(window, fingerprint): each window's fingerprint is over that of the window before, its own digest and the parameters.

    A change in one window changes its fingerprint and all later ones. The windows of a calendar are chained in one row.
    """
    told = digests.select("window", F.concat_ws(":", F.col("n").cast("string"), F.col("digest").cast("string")).alias("own"))
    chain = told.agg(F.array_sort(F.collect_list(F.struct("window", "own"))).alias("w"))
    start = F.struct(F.md5(F.lit(params).cast("binary")).alias("last"), F.array().cast("array<struct<window:string,fingerprint:string>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        print_ = F.md5(F.concat_ws("/", state["last"], x["window"], x["own"]).cast("binary"))
        return F.struct(print_.alias("last"), F.concat(state["out"], F.array(F.struct(x["window"].cast("string").alias("window"), print_.alias("fingerprint")))).alias("out"))

    return chain.select(F.inline(F.aggregate("w", start, step)["out"]))


def stale_windows(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """(window, status) of each window of two chains: `ok` before the first that differs, is new or is gone; from there on `stale`, or
    `gone` where the current chain doesn't have it."""
    both = recorded.toDF("window", "old").join(current.toDF("window", "new"), "window", "full")
    first = both.where("NOT (old <=> new)").agg(F.min("window").alias("first"))
    status = F.when(F.col("new").isNull(), "gone").when(F.col("window") >= F.col("first"), "stale").otherwise("ok")
    return both.crossJoin(F.broadcast(first)).select("window", status.alias("status"))


def replay(recorded: DataFrame, current: DataFrame, kept: DataFrame, build: Callable[[DataFrame, list[str]], DataFrame], windows_of: Sequence[str] = ("window",)) -> DataFrame:
    """What a full run would give, built from the first stale window on: rows of `kept` for the windows that are still right, and those
    that build(state, stale) makes. `state` is what `kept` has for the last right window (empty if there is none), `stale` the windows to build, in order."""
    told = stale_windows(recorded, current).collect()  # a row for each window of the calendar
    right = sorted(r.window for r in told if r.status == "ok")
    stale = sorted(r.window for r in told if r.status == "stale")
    column = windows_of[0]
    good = kept.where(F.col(column).isin(right)) if right else kept.limit(0)
    if not stale:
        return good
    state = kept.where(F.col(column) == right[-1]) if right else kept.limit(0)
    return good.unionByName(build(state, stale))
