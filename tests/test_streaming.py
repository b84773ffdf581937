"""Streams against the same operators on tables."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pageloom.operators.tasks import chunk_stats
from pageloom.streaming import live


def drained(df, name, mode, checkpoint):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_log_stream_equals_batch(spark, tmp_path):
    rows = [(1, "info", "processing", 0, 3, m, datetime(2024, 1, 1)) for m in ("Processing chunk 0", "Chunk 0 completed", "LLM response for Chunk 0 completed", "Fallback used")]
    rows += [(2, "error", "processing", 1, None, "Chunk 1 failed", datetime(2024, 1, 1))]
    spark.createDataFrame(rows, live.LOGS).repartition(3).write.parquet(str(tmp_path / "logs"))
    got = drained(live.live_chunk_stats(live.log_stream(spark, str(tmp_path / "logs"), 1)), "live_stats", "complete", tmp_path / "c")
    want = chunk_stats(spark.read.schema(live.LOGS).parquet(str(tmp_path / "logs")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == [(1, 3, 1, 0, 1, 1), (2, 0, 0, 1, 0, 0)]


def test_windows_on_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    got = drained(live.tumbling(stream), "live_windows", "append", tmp_path / "c")
    want = {(r.start, r.event_type): r.n for r in live.tumbling(events).collect()}
    rows = got.collect()
    assert rows and all(want[r.start, r.event_type] == r.n for r in rows)
    last = events.agg(F.max("ts")).first()[0] - timedelta(hours=2)
    assert {k for k in want if k[0] < last} <= {(r.start, r.event_type) for r in rows}


def test_task_states(spark, tmp_path):
    path = str(tmp_path / "s")
    for i, s in enumerate(["processing", "paused", "completed", "processing", "completed"]):
        spark.createDataFrame([(7, s)], "task_id long, status string").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("task_id long, status string").option("maxFilesPerTrigger", 1).parquet(path)
    rows = drained(live.task_states(stream), "states", "append", tmp_path / "c").collect()
    assert len(rows) == 5 and sum(not r.legal for r in rows) <= 2 and {r.task_id for r in rows} == {7}


def test_sessions(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    assert live.sessions(events).agg(F.sum("n")).first()[0] == events.count()
    assert live.sliding(events).agg(F.sum("n")).first()[0] == 4 * events.count()
