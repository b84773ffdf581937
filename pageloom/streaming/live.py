"""Structured Streaming: live task reports, windowed events and task control."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pageloom.operators.tasks import LEGAL_MOVES, chunk_counts, chunk_stats
from pageloom.sources.keyed import KeyedTable

LOGS = T.StructType([
    T.StructField("task_id", T.LongType()), T.StructField("level", T.StringType()), T.StructField("stage", T.StringType()), T.StructField("chunk_index", T.IntegerType()),
    T.StructField("total_chunks", T.IntegerType()), T.StructField("message", T.StringType()), T.StructField("created_at", T.TimestampType()),
])


def log_stream(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """The append-only log table as a stream of new files."""
    return spark.readStream.schema(LOGS).option("maxFilesPerTrigger", per_trigger).parquet(path)


def live_chunk_stats(logs: DataFrame) -> DataFrame:
    """Chunk statistics of every task, kept up to date (output mode complete or update)."""
    return chunk_stats(logs)


def start_live(stats: DataFrame, name: str, checkpoint: str, seconds: int = 2):
    """A query that refreshes an in-memory table every few seconds."""
    return stats.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) by tumbling windows; on a stream, rows later than the watermark are left out."""
    return _windowed(events, F.window("ts", width), late)


def sliding(events: DataFrame, width: str = "1 hour", slide: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    return _windowed(events, F.window("ts", width, slide), late)


def _timed(events: DataFrame, late: str) -> DataFrame:
    """A stream gets a watermark, which needs timestamps with a zone; a table stays as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def _windowed(events: DataFrame, window, late: str) -> DataFrame:
    rows = _timed(events, late)
    out = rows.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, stop, n): runs of a user's events with less than ``gap`` between them."""
    rows = _timed(events, late)
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def task_states(signals: DataFrame) -> DataFrame:
    """(task_id, status, legal) for each signal (task_id, status) of a stream: the state a task is in after it.

    A signal that isn't allowed in the present state is marked and changes nothing.
    """
    moves = LEGAL_MOVES

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else "pending"
        out = []
        for pdf in batches:
            for asked in pdf["status"]:
                legal = asked == now or (now, asked) in moves
                now = asked if legal else now
                out.append((key[0], now, legal))
        state.update((now,))
        yield pd.DataFrame(out, columns=["task_id", "status", "legal"])

    return signals.groupBy("task_id").applyInPandasWithState(step, "task_id long, status string, legal boolean", "status string", "append", GroupStateTimeout.NoTimeout)


def progress_of(logs: DataFrame) -> DataFrame:
    """(task_id, percent, message, total, completed, failed): where each task of the log lines stands, on a table or a stream.

    Percent runs from 10 to 90 while chunks are worked on, as share of the chunks that are done.
    """
    newest = F.max_by("message", F.struct("created_at", "message")).alias("message")
    stats = logs.groupBy("task_id").agg(newest, *chunk_counts())
    done = F.when(F.col("total") > 0, F.least(F.lit(1.0), (F.col("completed") + F.col("failed")) / F.col("total"))).otherwise(0.0)
    return stats.select("task_id", (F.lit(10) + F.floor(done * 80)).cast("int").alias("percent"), "message", "total", "completed", "failed")


def progress_table(spark: SparkSession, path: str) -> KeyedTable:
    """The table that start_progress keeps: one row for each task."""
    return KeyedTable(spark, path, "task_id long, percent int, message string, total long, completed long, failed long", "task_id", buckets=8)


def start_progress(logs: DataFrame, path: str, checkpoint: str, name: str | None = None, seconds: int = 2, keep: int = 20):
    """A query that keeps the progress of all tasks in a table below ``path`` (progress_table reads it, in any session).

    Counts are the stream's state, over all batches; a batch hands on the tasks that it changed, which are merged into
    the table under the batch's number. So a batch that is run again, or a restart from the checkpoint, counts nothing
    twice. Percent never falls, also where the number of chunks only becomes known later. After ``keep`` batches the
    table is compacted.
    """
    table = progress_table(logs.sparkSession, path)

    def merge(batch: DataFrame, number: int) -> None:
        before = table.read(below=number).select("task_id", F.col("percent").alias("_before"))
        rows = batch.join(before, "task_id", "left").withColumn("percent", F.greatest("percent", "_before")).drop("_before")
        table.put(rows, number)
        if len(table.versions()) >= keep:
            table.compact()

    writer = progress_of(logs).writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds")
    return (writer if name is None else writer.queryName(name)).start()


class Cancelled(Exception):
    """A task was told to end."""


class TaskControl:
    """Pause, resume and cancel for a task's work.

    Jobs started within the context carry the task's tag and end when it is cancelled. A batch flow calls ``point`` between its steps
    (Settings.point): it waits there while the task is paused, and ends with Cancelled. A stream is given as a function
    that starts it: pause stops it, resume starts it again from its checkpoint.

    signals: the folder of signals.start_signals. Then the state is that of the durable table, which every session
    sees and which outlives this one: ``point`` follows what others have sent, and a control opened anew takes the task up
    as it stands.
    """

    def __init__(self, spark: SparkSession, task_id: int, start=None, poll: float = 1.0, signals: str | None = None):
        self.spark, self.tag, self.start, self.poll = spark, f"task-{task_id}", start, poll
        self.task_id, self.signals = task_id, signals
        self.state, self.query = "processing", None
        self._follow()
        if start is not None and self.state == "processing":
            self.query = start()

    def _follow(self) -> None:
        """Take over what the durable table says, and let the stream follow."""
        if self.signals is None:
            return
        from pageloom.streaming.signals import state_of

        seen = state_of(self.spark, self.signals, self.task_id)
        if seen is None or seen == self.state:
            return
        self.state = seen
        if seen == "processing":
            if self.start is not None and self.query is None:
                self.query = self.start()
        else:
            self._stop()

    def __enter__(self) -> TaskControl:
        self.spark.addTag(self.tag)
        return self

    def __exit__(self, *_) -> None:
        self.spark.removeTag(self.tag)

    def point(self) -> None:
        self._follow()
        while self.state == "paused":
            time.sleep(self.poll)
            self._follow()
        if self.state == "cancelled":
            raise Cancelled(self.tag)

    def pause(self) -> bool:
        """False where the task isn't running."""
        if self.state != "processing":
            return False
        self.state = "paused"
        self._stop()
        return True

    def resume(self) -> bool:
        if self.state != "paused":
            return False
        self.state = "processing"
        if self.start is not None:
            self.query = self.start()
        return True

    def cancel(self) -> None:
        self.state = "cancelled"
        self.spark.interruptTag(self.tag)
        self._stop()
        for query in self.spark.streams.active:
            if query.name == self.tag:
                query.stop()

    def _stop(self) -> None:
        if self.query is not None:
            self.query.stop()
            self.query = None
