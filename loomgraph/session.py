"""Session settings that the library relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings every job of the library expects; a cluster's own values for anything else stay.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches; cluster jobs bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("loomgraph")
    settings = SETTINGS | {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("LOOMGRAPH_DRIVER_MEMORY", "8g"),
        "spark.driver.host": "127.0.0.1",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
