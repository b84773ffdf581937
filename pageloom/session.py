"""Session and lineage helpers shared by every module."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset (tests on one machine)
    a temporary folder of this machine takes its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named is None:
        current = context._jsc.sc().getCheckpointDir()
        if current.isEmpty() and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="pageloom-ckpt-")
        spark.conf.set("spark.checkpoint.dir", named)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise a frame in the shared folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def let_go(spark: SparkSession) -> None:
    """Have the driver collect garbage now, at which Spark deletes shuffle files that no frame needs any more.

    For a step after ``cut`` whose own shuffle would else lie on disk beside the one before.
    """
    spark._jvm.System.gc()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder for a written table."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """The frame dealt out by a key where its input has fewer splits than would keep the cores busy.

    Steps that group by the key then need no shuffle of their own. Inputs of many splits stay as they are.
    """
    few = df.rdd.getNumPartitions() < 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(key) if few else df


def spread(df: DataFrame, like: DataFrame, *keys: str) -> DataFrame:
    """A small table dealt by keys over as many tasks as ``like`` is read by, two for each core at least.

    For rows that are few bytes but much work: by their size alone they would be put together into few tasks.
    """
    return df.repartition(max(like.rdd.getNumPartitions(), 2 * df.sparkSession.sparkContext.defaultParallelism), *keys)


_open_scope: ContextVar[list[str] | None] = ContextVar("stored tables of the open scope", default=None)


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that ``stored`` writes inside are discarded at the end, also after an error.

    Frames made inside read those tables, so what is to last must be written or collected before the end.
    """
    paths: list[str] = []
    token = _open_scope.set(paths)
    try:
        yield paths
    finally:
        _open_scope.reset(token)
        for path in paths:
            discard(spark, path)


def stored(df: DataFrame, label: str, made: list[str] | None = None) -> DataFrame:
    """The frame written as a compressed table in the shared folder, and read again; its path goes to ``made``.

    It lasts until the scope that it is written in ends; without one, until the folder is emptied.
    """
    path = scratch_path(df.sparkSession, label)
    for paths in (made, _open_scope.get()):
        if paths is not None:
            paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, label: str) -> DataFrame:
    """A frame that gives the same rows in the same partitions each time it is read.

    A projection or filter of files does; anything else (a shuffle may be coalesced or fetched in another way the next
    time) is written first. For steps that cut their input into chunks and read it twice.
    """

    def nodes(plan):
        yield plan.nodeName()
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))

    steady = all(name in ("Project", "Filter") or name.startswith("LogicalRelation") for name in nodes(df._jdf.queryExecution().optimizedPlan()))
    return df if steady else stored(df, label)


def estimated_bytes(df: DataFrame) -> int:
    """What the optimizer takes a frame's size to be; for files and stored tables about their size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that ``stored`` wrote, once nothing reads it any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
