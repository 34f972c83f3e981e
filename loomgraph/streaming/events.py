"""Streaming forms of the window operators: tumbling counts, deduplication, decayed monthly state, upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling_counts(events: DataFrame, width: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Counts and sums by window and type; rows later than the watermark are left to a batch recomputation."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start_ts"), "event_type", "n", "total")


def sliding_counts(events: DataFrame, width: str = "24 hours", slide: str = "6 hours", late: str = "1 day") -> DataFrame:
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start_ts"), "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start_ts"), "n")


def first_deliveries(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """Each key once, however often it is delivered within the watermark."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark([key])


def monthly_labels(events: DataFrame) -> DataFrame:
    """Calendar months aren't legal window widths, so the label is a grouping key."""
    return events.withColumn("window", F.date_format("ts", "yyyy-MM"))


def decayed_state(rows: DataFrame, key: str, step: str, value: str, alpha: float) -> DataFrame:
    """Running state per key: each new step's value plus alpha ** gap times the state before; one output row per key and batch.

    State is (last step, weight), a few bytes a key. Steps before the last are added with the decay they have missed.
    """

    def fold(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, weight = state.get if state.exists else (None, 0.0)
        for part in parts:
            for at, amount in part.groupby(step)[value].sum().sort_index().items():
                if last is None or at >= last:
                    weight = amount + (weight * alpha ** (int(at) - last) if last is not None else 0.0)
                    last = int(at)
                else:
                    weight += amount * alpha ** (last - int(at))
        state.update((last, weight))
        yield pd.DataFrame({key: [name[0]], "step": [last], "w": [weight]})

    kind = dict(rows.dtypes)[key]
    return rows.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, step int, w double", "step int, w double", "update", GroupStateTimeout.NoTimeout)


def upsert_sink(stream: DataFrame, path: str, key: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Write a stream so that each key's last row by `order` can be read back: batches are appended under their number, a batch that
    is delivered again replaces itself, and `read_upserts` takes the last row of each key."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_upserts(spark, path: str, key: list[str], order: str) -> DataFrame:
    rows = spark.read.parquet(path)
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(order, "batch")).alias("r")).select(*key, "r.*").drop("batch")
