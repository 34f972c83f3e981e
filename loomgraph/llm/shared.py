"""What several corpus operators need: word rule, shared folder, settled intermediate tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

from loomgraph.sources.interim import settle, shared_dir

__all__ = ["WORD_PATTERN", "bounded_batches", "settle", "shared_dir", "tasks"]

#: A word is a run of anything but the six ASCII white-space characters (space, tab, LF, VT, FF, CR).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def tasks(spark: SparkSession) -> int:
    """Partitions that the session deals shuffles to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes that Spark sends a Python worker at once: whole texts come in batches of rows, and a batch of long ones is held several times over.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep the batches of this session within BATCH_BYTES (or one row); a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(name).rstrip("b"))
    if now < 0 or now > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
