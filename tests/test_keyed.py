"""Keyed tables, cumulative progress and durable signals."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pageloom.sources.keyed import KeyedTable
from pageloom.streaming import live, signals

SCHEMA = "id long, name string, n int"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_puts_deletes_and_compaction(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "id", buckets=4)
    rows = lambda: {r.id: (r.name, r.n) for r in table.read().collect()}
    assert rows() == {}
    want = {}
    for v in range(7):
        new = {i: (f"v{v}", i * v) for i in range(v, 40, v + 2)}
        gone = [i for i in range(0, 40, 5) if v % 2 and i not in new]
        table.put(spark.createDataFrame([(i, *x) for i, x in new.items()], SCHEMA), v, spark.createDataFrame([(i,) for i in gone], "id long"))
        want = {i: x for i, x in want.items() if i not in gone} | new
        assert rows() == want
        if v == 3:
            table.compact()
            assert rows() == want and table.versions() == [] and table.base_version() == 3
            table.put(spark.createDataFrame([(1, "again", 0)], SCHEMA), 3)  # a version that the base holds
            assert rows() == want
    table.compact()
    table.delete(spark.createDataFrame([(2,)], "id long"), 9)
    other = KeyedTable(spark.newSession(), str(tmp_path / "t"), SCHEMA, "id", buckets=4)
    assert {r.id for r in other.read().collect()} == set(want) - {2} and [r.n for r in other.get([3]).collect()] == [want[3][1]]
    table.put(spark.createDataFrame([(None, "x", 1)], SCHEMA), 10)
    assert table.read().where("id is null").isEmpty() and len(table.read(below=9).collect()) == len(want)


def test_base_is_not_shuffled(spark, tmp_path):
    """A change moves its own rows only: the base is met in the buckets that it is stored in."""
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "id", buckets=4)
    table.put(spark.range(1000).selectExpr("id", "'a' as name", "1 as n"), 0)
    table.compact()
    table.put(spark.range(5).selectExpr("id", "'b' as name", "2 as n"), 1)
    read = table.read()
    assert read.where("name = 'b'").count() == 5 and read.count() == 1000
    lines = plan_of(table.read()).splitlines()
    at = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    above, d = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < d:
            above.append(line)
            d = depth(line)
    assert any("SortMergeJoin" in x for x in above) and not any("Exchange" in x for x in above)


def log_files(spark, path, lines):
    """One file, so one micro-batch, for each line."""
    for i, (task, total, message) in enumerate(lines):
        spark.createDataFrame([(task, "info", "processing", 0, total, message, datetime(2024, 1, 1, 0, i))], live.LOGS).coalesce(1).write.mode("append").parquet(path)


def test_progress_over_batches_and_restart(spark, tmp_path):
    logs, out, check = (str(tmp_path / x) for x in ("logs", "out", "c"))
    lines = [(1, 4, "Chunk 0 completed"), (2, None, "Processing chunk 0"), (1, 4, "Chunk 1 completed"), (2, None, "Chunk 0 completed"), (1, 4, "Chunk 2 completed"), (2, None, "Processing chunk 1"), (1, 4, "Chunk 3 completed"), (2, None, "Chunk 1 completed")]
    seen = []

    def follow(more):
        log_files(spark, logs, more)
        stream = live.log_stream(spark, logs, 1)
        query = live.start_progress(stream, out, check, "progress", 0, keep=3)
        query.processAllAvailable()
        query.stop()
        seen.append({r.task_id: r.percent for r in live.progress_table(spark, out).read().collect()})

    for i in range(0, 6, 2):
        follow(lines[i : i + 2])
    follow(lines[6:])
    assert [s[1] for s in seen] == [30, 50, 70, 90] and [s[2] for s in seen] == [10, 90, 90, 90]
    batch = {tuple(r) for r in live.progress_of(spark.read.schema(live.LOGS).parquet(logs)).collect()}
    assert {tuple(r) for r in live.progress_table(spark, out).read().select("task_id", "percent", "message", "total", "completed", "failed").collect()} == batch


def test_batch_run_twice_counts_once(spark, tmp_path):
    """The merge of a batch is by its number: running one again leaves the table as it is."""
    table = live.progress_table(spark, str(tmp_path / "p"))
    row = lambda percent: spark.createDataFrame([(1, percent, "m", 4, 1, 0)], table.schema)
    table.put(row(30), 0)
    table.put(row(30), 0)
    assert table.read().count() == 1 and table.versions() == [0]


def test_signals_survive_the_driver(spark, tmp_path):
    """What one session sends and follows, another one finds; the stream goes on from its checkpoint."""
    path = str(tmp_path / "signals")
    states = lambda s: {r.task_id: r.state for r in signals.all_states(s, path).collect()}

    def follow(session, *sent):
        for task, signal in sent:
            signals.send(session, path, task, signal)
        query = signals.start_signals(session, path, 0)
        query.processAllAvailable()
        query.stop()

    follow(spark, (1, "register"), (2, "register"), (3, "pause"), (1, "pause"))
    assert states(spark) == {1: "paused", 2: "processing"}
    one = live.TaskControl(spark, 2, poll=0.01, signals=path)
    one.point()
    other = spark.newSession()
    assert live.TaskControl(other, 1, signals=path).state == "paused"
    follow(other, (1, "resume"), (2, "cancel"), (2, "resume"), (1, "pause"))
    assert states(other) == {1: "paused", 2: "cancelled"}
    with pytest.raises(live.Cancelled):
        one.point()
    row = signals.all_states(spark, path).where("task_id = 2").first()
    assert row.cancelled_at is not None and row.paused_at is None
    follow(spark, (1, "unregister"))
    assert states(spark) == {2: "cancelled"}


def test_waiting_control_follows_other_sessions(spark, tmp_path):
    import threading

    path = str(tmp_path / "signals")
    for s in ("register", "pause"):
        signals.send(spark, path, 7, s)
    query = signals.start_signals(spark, path, 0)
    query.processAllAvailable()
    control, passed = live.TaskControl(spark, 7, poll=0.05, signals=path), []
    flow = threading.Thread(target=lambda: (control.point(), passed.append(1)))
    flow.start()
    assert control.state == "paused" and not passed
    signals.send(spark.newSession(), path, 7, "resume")
    query.processAllAvailable()
    flow.join(60)
    query.stop()
    assert passed and control.state == "processing"


def test_ended_tasks_are_forgotten(spark, tmp_path):
    path = str(tmp_path / "signals")
    for i, s in enumerate(("register", "cancel")):
        signals.send(spark, path, 5, s, datetime(2024, 1, 1, 0, 0, i))
    query = signals.start_signals(spark, path, 0, keep_ms=1)
    query.processAllAvailable()
    assert {r.task_id for r in signals.all_states(spark, path).collect()} == {5}
    signals.send(spark, path, 6, "register", datetime(2024, 1, 1, 3))
    query.processAllAvailable()
    query.stop()
    assert {r.task_id for r in signals.all_states(spark, path).collect()} == {6}


def test_order_of_signals():
    run = lambda *xs: [s := None] and [s := signals.after(s, x) for x in xs][-1]
    assert run("pause") is None and run("register", "pause") == "paused" and run("register", "pause", "resume") == "processing"
    assert run("register", "cancel", "resume") == "cancelled" and run("register", "cancel", "unregister") is None and run("register", "cancel", "register") == "processing"


def test_progress_columns_on_a_table(spark):
    rows = [(1, "error", "processing", 0, None, "Chunk 0 failed", datetime(2024, 1, 1)), (1, "info", "processing", 0, None, "Processing chunk 0", datetime(2024, 1, 2))]
    got = live.progress_of(spark.createDataFrame(rows, live.LOGS)).select("percent", "message", F.col("total").cast("int"), "failed").first()
    assert tuple(got) == (90, "Processing chunk 0", 1, 1)
