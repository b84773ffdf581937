"""Pause, resume and cancel signals of tasks that outlive the driver that sent or that follows them.

Signals are appended to a folder, by any session. A stream keeps the state of each registered task (transformWithState:
a value for each task, and a timer that forgets a task some time after it has ended, by the time of the signals), and
writes what changed into a table with one row for each task. Flows look their task up there (live.TaskControl with ``signals``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pageloom.sources.keyed import KeyedTable

SIGNALS = "task_id long, signal string, sent_at timestamp"
STATES = "task_id long, state string, paused_at timestamp, cancelled_at timestamp"
#: Milliseconds after which an ended task is forgotten, and how late a signal may come in beside others.
KEEP_MS, LATE = 3_600_000, "1 hour"


def send(spark: SparkSession, path: str, task_id: int, signal: str, at: datetime | None = None) -> None:
    """Append a signal: register, pause, resume, cancel or unregister."""
    if signal not in ("register", "pause", "resume", "cancel", "unregister"):
        raise ValueError(signal)
    spark.createDataFrame([(task_id, signal, at or datetime.now())], SIGNALS).coalesce(1).write.mode("append").parquet(f"{path}/signals")


def after(state: str | None, signal: str) -> str | None:
    """The state that a signal leads to; the same where it changes nothing. None: not registered."""
    if signal == "register":
        return "processing"
    if state is None or state == "cancelled" and signal != "unregister":
        return state
    return {"pause": "paused", "resume": "processing", "cancel": "cancelled", "unregister": None}[signal]


class SignalState(StatefulProcessor):
    """One value for each task: its state and since when it is paused or cancelled.

    It takes and gives rows: a task has few signals in a batch, and a frame for each would cost more than they do.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        value = T.StructType([T.StructField("state", T.StringType()), T.StructField("paused_at", T.TimestampType()), T.StructField("cancelled_at", T.TimestampType())])
        self.value = handle.getValueState("state", value)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        state, paused, cancelled = self.value.get() if self.value.exists() else (None, None, None)
        waiting = sorted((-math.inf if r.sent_at is None else r.sent_at.timestamp(), r.signal, r.sent_at) for r in rows)
        for _, signal, at in waiting:
            now = after(state, signal)
            if now != state or signal == "register":
                paused = at if now == "paused" else None
                cancelled = at if now == "cancelled" else None
            state = now
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state == "cancelled":
            self.handle.registerTimer(int(cancelled.timestamp() * 1000) + self.keep_ms)
        if state is None:
            self.value.clear()
        else:
            self.value.update((state, paused, cancelled))
        yield Row(task_id=key[0], state=state, paused_at=paused, cancelled_at=cancelled)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.value.clear()
        yield Row(task_id=key[0], state=None, paused_at=None, cancelled_at=None)

    def close(self) -> None:
        pass


def signal_states(signals: DataFrame, keep_ms: int = KEEP_MS) -> DataFrame:
    """(task_id, state, paused_at, cancelled_at) of each task that a batch has signals for; state null: not registered, or forgotten.

    Signals of one batch count in order of time. A task that isn't registered takes no other signal, a cancelled one
    none but its end.
    """
    timed = signals.withWatermark("sent_at", LATE)
    return timed.groupBy("task_id").transformWithState(SignalState(keep_ms), STATES, "Update", "EventTime")


def state_table(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, f"{path}/states", STATES, "task_id", buckets=8)


def state_of(spark: SparkSession, path: str, task_id: int) -> str | None:
    """The state of a task by the table, or null where it isn't registered."""
    row = state_table(spark, path).get([task_id]).select("state").first()
    return None if row is None else row[0]


def all_states(spark: SparkSession, path: str) -> DataFrame:
    return state_table(spark, path).read()


def start_signals(spark: SparkSession, path: str, seconds: float = 1, keep_ms: int = KEEP_MS, keep: int = 20):
    """The stream that follows the signals below ``path`` and keeps its state there; started anew it goes on where it stood.

    It runs with the RocksDB state store, which timers need.
    """
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.createDataFrame([], SIGNALS).write.mode("append").parquet(f"{path}/signals")  # the folder is there before the first signal
    table = state_table(spark, path)

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        if rows.isEmpty():
            return
        table.put(rows.where("state is not null"), number, rows.where("state is null").select("task_id"))
        rows.unpersist()
        if len(table.versions()) >= keep:
            table.compact()

    stream = spark.readStream.schema(SIGNALS).parquet(f"{path}/signals")
    writer = signal_states(stream, keep_ms).writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", f"{path}/checkpoint")
    try:
        return writer.trigger(processingTime=f"{seconds} seconds").start()
    finally:
        spark.conf.unset(store) if before is None else spark.conf.set(store, before)
