"""Tables with one row for each key that are changed in small steps: a base in hash buckets, and numbered deltas.

A change (rows to put, keys to delete) is one delta, written under its version; writing a version again replaces it, so
a step that is run twice changes the table once. A read meets the base with the newest change of each key by a join on
the key: the base is stored in sorted hash buckets of the key, so only the deltas are shuffled, however large the base
is. Compaction writes the next base, of all versions up to one; a base counts once it is whole, and readers of the one
before go on with it until it is discarded.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.session import discard

#: Columns of deltas beside the table's own.
GONE, VERSION = "_gone", "_version"


class KeyedTable:
    """A table below a folder that driver and executors share; every session that opens the folder sees its state."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        self.columns = self.schema.names

    def _children(self, folder: str) -> list[str]:
        """Names in a folder; a base without the mark of a finished write is none."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = [s.getPath() for s in fs.listStatus(path)]
        return [p.getName() for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]

    def base_version(self) -> int | None:
        found = [int(name.removeprefix("upto=")) for name in self._children("base")]
        return max(found, default=None)

    def versions(self, below: int | None = None) -> list[int]:
        """Versions written since the base (and before one, if given)."""
        least = self.base_version()
        found = sorted(int(name.removeprefix("v=")) for name in self._children("delta"))
        return [v for v in found if (least is None or v > least) and (below is None or v < below)]

    def put(self, rows: DataFrame, version: int, gone: DataFrame | None = None) -> None:
        """Change the table: rows (one for each key; none where the key is null) come in or replace, keys of ``gone`` go.

        A version that the base already holds is left out: a step that is run again after a compaction changes nothing.
        """
        held = self.base_version()
        if held is not None and version <= held:
            return
        delta = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema], F.lit(False).alias(GONE))
        if gone is not None:
            keys = gone.select(F.col(self.key).cast(self.schema[self.key].dataType).alias(self.key)).distinct()
            none = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != self.key else F.col(f.name) for f in self.schema]
            delta = delta.join(keys, self.key, "left_anti").select(*delta.columns).unionByName(keys.select(*none, F.lit(True).alias(GONE)))
        delta.where(F.col(self.key).isNotNull()).write.mode("overwrite").parquet(f"{self.path}/delta/v={version}")

    def delete(self, keys: DataFrame, version: int) -> None:
        self.put(self.spark.createDataFrame([], self.schema), version, keys)

    def _base(self) -> DataFrame | None:
        """The base as a bucketed table: its place is registered with the session, as a catalog may not outlive one."""
        version = self.base_version()
        if version is None:
            return None
        name = f"keyed_{uuid.uuid5(uuid.NAMESPACE_URL, f'{self.path}/{version}').hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        key = f"`{self.key}`"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/base/upto={version}'")
        return self.spark.table(name)

    def _changes(self, below: int | None = None) -> DataFrame | None:
        """The newest change of each key since the base."""
        versions = self.versions(below)
        if not versions:
            return None
        schema = T.StructType([*self.schema.fields, T.StructField(GONE, T.BooleanType())])
        read = [self.spark.read.schema(schema).parquet(f"{self.path}/delta/v={v}").withColumn(VERSION, F.lit(v)) for v in versions]
        rows = read[0]
        for more in read[1:]:
            rows = rows.unionByName(more)
        newest = Window.partitionBy(self.key).orderBy(F.desc(VERSION))
        return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", VERSION)

    def read(self, below: int | None = None) -> DataFrame:
        """The table as it is, or as it was before a version that isn't in the base yet."""
        base, changes = self._base(), self._changes(below)
        if changes is None:
            return self.spark.createDataFrame([], self.schema) if base is None else base
        if base is None:
            return changes.where(f"not {GONE}").drop(GONE)
        c = changes.select(self.key, F.struct(*changes.columns).alias("_c"))
        both = base.select(self.key, F.struct(*self.columns).alias("_b")).hint("merge").join(c.hint("merge"), self.key, "full_outer")
        own = [F.when(F.col("_c").isNull(), F.col("_b")[x]).otherwise(F.col("_c")[x]).alias(x) for x in self.columns if x != self.key]
        rows = both.where(F.col("_c").isNull() | ~F.col("_c")[GONE]).select(self.key, *own)
        return rows.select(*self.columns)

    def get(self, keys: list) -> DataFrame:
        """The rows of some keys; bucket pruning reads no other bucket of the base."""
        return self.read().where(F.col(self.key).isin(keys))

    def compact(self) -> None:
        """Write the next base and discard what it holds: deltas up to it, and bases before the one it was made of."""
        versions, old = self.versions(), self.base_version()
        if not versions:
            return
        top = versions[-1]
        place = f"{self.path}/base/upto={top}"
        name = f"keyed_{uuid.uuid4().hex}"
        self.read().write.mode("overwrite").format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key).option("path", place).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # its files stay; the folder names them
        for v in versions:
            discard(self.spark, f"{self.path}/delta/v={v}")
        for v in [int(n.removeprefix("upto=")) for n in self._children("base")]:
            if old is not None and v < old:
                discard(self.spark, f"{self.path}/base/upto={v}")
