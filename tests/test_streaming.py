from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomgraph.streaming import events as ev

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('events')}/e"
    rows = [(i, START + timedelta(hours=i % 50, minutes=i % 7), i % 5, "ab"[i % 2], float(i)) for i in range(300)]
    frame = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    frame.repartition(3).write.parquet(path)
    return path


def drain(stream, tmp_path, mode="append", name="out"):
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return stream.sparkSession.table(name)


def source(spark, table):
    return spark.readStream.schema(spark.read.parquet(table).schema).option("maxFilesPerTrigger", 1).parquet(table)


def test_tumbling_matches_batch(spark, table, tmp_path):
    found = drain(ev.tumbling_counts(source(spark, table), late="10 days"), tmp_path, "complete", "tumbling").collect()
    assert sorted(found) == sorted(ev.tumbling_counts(spark.read.parquet(table)).collect())


def test_sliding_matches_batch(spark, table, tmp_path):
    found = drain(ev.sliding_counts(source(spark, table), late="10 days"), tmp_path, "complete", "sliding").collect()
    assert sorted(found) == sorted(ev.sliding_counts(spark.read.parquet(table)).collect())
    assert sum(r.n for r in found) == 300 * 4  # each event is in as many windows as slides fit in one


def test_sessions_match_batch(spark, table, tmp_path):
    """Gaps of over 40 minutes end a session; sessions that a later file joins are one."""
    found = drain(ev.sessions(source(spark, table), gap="40 minutes", late="10 days"), tmp_path, "complete", "sessions").collect()
    assert sorted(found) == sorted(ev.sessions(spark.read.parquet(table), gap="40 minutes").collect())
    assert sum(r.n for r in found) == 300 and len(found) > 5


def test_deduplication(spark, table, tmp_path):
    twice = source(spark, table).unionByName(source(spark, table))
    assert drain(ev.first_deliveries(twice, late="10 days"), tmp_path, name="firsts").count() == 300


def test_decayed_state_is_the_closed_form(spark, table, tmp_path):
    steps = lambda rows: rows.select("user_id", F.floor(F.hour("ts") / 6).cast("int").alias("at"), "value")
    out = drain(ev.decayed_state(steps(source(spark, table)), "user_id", "at", "value", 0.85), tmp_path, "update", "decayed")
    found = {r.user_id: r.w for r in out.groupBy("user_id").agg(F.max_by("w", "w").alias("w")).collect()}
    rows = steps(spark.read.parquet(table)).collect()
    for user, w in found.items():
        mine = [(r["at"], r["value"]) for r in rows if r.user_id == user]
        last = max(a for a, _ in mine)
        assert w == pytest.approx(sum(v * 0.85 ** (last - a) for a, v in mine))


def test_upserts(spark, table, tmp_path):
    stream = source(spark, table).select("user_id", "event_id", "value")
    path = f"file://{tmp_path}/up"
    ev.upsert_sink(stream, path, ["user_id"], "event_id", f"file://{tmp_path}/ck").awaitTermination(120)
    assert sorted((r.user_id, r.event_id) for r in ev.read_upserts(spark, path, ["user_id"], "event_id").collect()) == [(u, 295 + u) for u in range(5)]
