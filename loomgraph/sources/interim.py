"""Interim tables below the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession, functions as F

_local: dict[str, str] = {}
#: Where the frames that `settle` returned and that are still in use are kept.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names. Where it is unset a local master gets a temporary one; a cluster raises, since
    its executors don't see the driver's folders."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _local.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="loomgraph-"))


def settle(df: DataFrame, name: str = "interim") -> DataFrame:
    """Write `df` below the shared folder and read it back: cuts the lineage, survives lost executors.

    Unlike checkpoint() the rows are computed once, since the write itself is the action.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[kept] = path
    return kept


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows by `keys` in as many parts as `spark.sql.shuffle.partitions` says, which adaptive execution doesn't merge: for steps that make
    many rows of each, and groupings by the keys and more, which then happen in place."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def fits(df: DataFrame, column: str, limit: int = 32 << 20) -> bool:
    """Whether a table's `column` has at most `limit` bytes."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0] <= limit


def at_hand(df: DataFrame, column: str, limit: int = 32 << 20) -> DataFrame:
    """A table for a join: sent to every executor if its `column` has at most `limit` bytes, so that a few very frequent values don't deal all rows."""
    return F.broadcast(df) if fits(df, column, limit) else df


def discard(df: DataFrame) -> None:
    """Delete the table behind a frame that `settle` returned. Nothing that reads it may be used afterwards."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_paths.pop(df))
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
