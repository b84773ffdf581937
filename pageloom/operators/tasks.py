"""Tasks, logs and lineage: reports, snapshots of event-sourced tables, and checks of task states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.text import retry_name
from pageloom.session import cut

LEGAL_MOVES = {("pending", "processing"), ("processing", "completed"), ("processing", "failed"), ("processing", "paused"), ("paused", "processing"), ("failed", "processing")}


def task_stats(tasks: DataFrame) -> DataFrame:
    c = lambda s: F.count_if(F.col("status") == s).alias(s)
    return tasks.agg(F.count("*").alias("total"), c("completed"), c("processing"), c("failed"), F.coalesce(F.sum("extracted_count"), F.lit(0)).alias("extracted"))


def chunk_counts() -> list[Column]:
    """Aggregates of log lines: total, completed, failed, model_calls, fallback_used."""
    has = lambda *xs: F.coalesce(F.expr(" or ".join(f"contains(message, '{x}')" for x in xs)), F.lit(False))
    started = F.count_if(has("开始处理Chunk", "Processing chunk"))
    total = F.coalesce(F.max("total_chunks"), F.lit(0))
    return [
        F.when(total > 0, total).otherwise(started).alias("total"),
        F.count_if(has("Chunk") & has("完成", "completed", "处理完毕") & ~has("LLM")).alias("completed"),
        F.count_if((F.col("level") == "error") & (has("Chunk") | (F.col("stage") == "processing"))).alias("failed"),
        F.count_if(has("LLM响应", "LLM response")).alias("model_calls"), F.count_if(has("Fallback")).alias("fallback_used"),
    ]


def chunk_stats(logs: DataFrame) -> DataFrame:
    """(task_id, total, completed, failed, model_calls, fallback_used) of (task_id, level, stage, message, total_chunks)."""
    return logs.groupBy("task_id").agg(*chunk_counts())


def latest(rows: DataFrame, by: str, n: int, tie: str) -> DataFrame:
    """The n newest rows: a top-k, not a full sort."""
    return rows.orderBy(F.desc(by), F.desc(tie)).limit(n)


def page_logs(logs: DataFrame, task_id: int, status: str | None = None) -> DataFrame:
    """A task's page logs in order of pages, all or those of one status."""
    own = logs.where(F.col("task_id") == task_id)
    return (own if status is None else own.where(F.col("status") == status)).orderBy("page_index")


def latest_task_logs(tasks: DataFrame, logs: DataFrame, n: int = 20, by: str = "created_at", tie: str = "id", log_tie: str = "id") -> DataFrame:
    """The newest logs of the newest task: the task is a top-1, its logs a top-n."""
    newest = latest(tasks, by, 1, tie).select(F.col("id").alias("task_id"))
    return latest(logs.join(newest, "task_id", "left_semi"), by, n, log_tie)


def stage_slice(logs: DataFrame, stage: str = "extracting", n: int = 20, by: str = "created_at", tie: str = "id", newest_first: bool = False) -> DataFrame:
    """The first n logs of a stage for each task, in order or the other way round."""
    w = Window.partitionBy("task_id").orderBy(by, tie)
    first = logs.where(F.col("stage") == stage).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    return first.orderBy("task_id", F.desc("_n") if newest_first else F.asc("_n")).drop("_n")


def inserted(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """rows with ids that follow the table's greatest, in a gapless run: counts of partitions give each its offset."""
    top = table.agg(F.coalesce(F.max(F.col(key).cast("long")), F.lit(0))).first()[0]
    numbered = cut(rows.withColumn("_m", F.monotonically_increasing_id())).withColumn("_p", F.shiftright("_m", 33))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = numbered.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")  # a row for each partition
    place = F.col("_m") - F.shiftleft("_p", 33)
    return numbered.join(starts, "_p").select((F.lit(top) + F.col("_start") + place + 1).alias(key), *[c for c in rows.columns if c != key])


def snapshot(events: DataFrame, key: str, version: str, deleted: str | None = None) -> DataFrame:
    """The last version of each key of an append-only table, without keys whose last version is a tombstone."""
    w = Window.partitionBy(key).orderBy(F.desc(version))
    out = events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return out if deleted is None else out.where(~F.coalesce(F.col(deleted), F.lit(False)))


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of the table replaced by, or joined with, those of changes (one for each key)."""
    return table.join(changes.select(key), key, "left_anti").select(*table.columns).unionByName(changes)


def delete(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(key).distinct(), key, "left_anti").select(*table.columns)


def single_default(configs: DataFrame) -> DataFrame:
    """Of each user's default configurations only the one changed last stays the default."""
    w = Window.partitionBy("user_id").orderBy(F.desc("is_default"), F.desc("updated_at"), F.desc("id"))
    return configs.withColumn("is_default", F.col("is_default") & (F.row_number().over(w) == 1))


def lineage(tasks: DataFrame, root: int) -> DataFrame:
    """A task family: the root task and all that name it as their root, newest first."""
    return tasks.where((F.col("root_task_id") == root) | (F.col("id") == root)).orderBy(F.desc("created_at"), F.desc("id"))


def roots(tasks: DataFrame) -> DataFrame:
    """(id, root_id, depth) by following parents: pointers are doubled each round, so long chains need few joins.

    A chain has as many tasks as there are at most; parents that still lead on after that many steps form a ring, an error.
    """
    at = tasks.select("id", F.coalesce("parent_task_id", "id").alias("up"), F.when(F.col("parent_task_id").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    for _ in range(tasks.count().bit_length() + 1):
        hop = at.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"))
        after = at.join(hop, "up", "left").select("id", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), (F.coalesce("d2", F.lit(0)) > 0).alias("moved"))
        after = cut(after)
        at = after.drop("moved")
        if after.where("moved").isEmpty():
            return at.select("id", F.col("up").alias("root_id"), F.col("depth").cast("int").alias("depth"))
    raise ValueError("the parents of some tasks form a ring")


def retried(tasks: DataFrame) -> DataFrame:
    """The child tasks that a retry of each task makes."""
    count = F.coalesce("retry_count", F.lit(0)) + 1
    return tasks.select(F.col("id").alias("parent_task_id"), F.coalesce("root_task_id", "id").alias("root_task_id"), retry_name("name", count).alias("name"), count.alias("retry_count"), F.lit("processing").alias("status"), "total_pages")


def page_logs_of(tasks: DataFrame) -> DataFrame:
    """(task_id, page_index, status): pending page logs of new tasks, one less than their pages."""
    return tasks.where("total_pages > 1").select(F.col("id").alias("task_id"), F.explode(F.sequence(F.lit(0), F.col("total_pages") - 2)).alias("page_index"), F.lit("pending").alias("status"))


def retry_failed(page_logs: DataFrame) -> DataFrame:
    failed = F.col("status") == "failed"
    return page_logs.withColumn("error_message", F.when(~failed, F.col("error_message"))).withColumn("status", F.when(failed, "pending").otherwise(F.col("status")))


def illegal_moves(states: DataFrame) -> DataFrame:
    """(task_id, at, before, after) where a task's status changed in a way that isn't allowed."""
    w = Window.partitionBy("task_id").orderBy("at")
    rows = states.select("task_id", "at", F.lag("status").over(w).alias("before"), F.col("status").alias("after")).where("before is not null and before <> after")
    return rows.where(~F.concat_ws(">", "before", "after").isin([f"{a}>{b}" for a, b in sorted(LEGAL_MOVES)]))


def compare_results(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Rows of two results by key: only_a, only_b, same or changed."""
    cols = [c for c in a.columns if c not in key]
    x, y = a.select(*key, F.struct(*cols).alias("x")), b.select(*key, F.struct(*cols).alias("y"))
    kind = F.when(F.col("y").isNull(), "only_a").when(F.col("x").isNull(), "only_b").when(F.col("x") == F.col("y"), "same").otherwise("changed")
    return x.join(y, key, "full_outer").select(*key, kind.alias("change"))


def pages_of_text(texts: DataFrame, size: int = 10) -> DataFrame:
    """(doc_id, item, page, body): the items of a Markdown result between rules of dashes, in pages."""
    parts = F.filter(F.split("text", r"\n-{3,}\n"), lambda x: F.trim(x) != "")
    rows = texts.select("doc_id", F.posexplode(parts).alias("item", "body"))
    return rows.select("doc_id", "item", F.floor(F.col("item") / size).cast("int").alias("page"), F.trim("body").alias("body"))


def page_of_text(pages: DataFrame, page: int) -> DataFrame:
    """One page of each document of pages_of_text; a number beyond the last page gives the last, one below 0 the first."""
    last = pages.groupBy("doc_id").agg(F.max("page").alias("_last"))
    wanted = F.least(F.greatest(F.lit(page), F.lit(0)), F.col("_last"))
    return pages.join(last, "doc_id").where(F.col("page") == wanted).drop("_last")
