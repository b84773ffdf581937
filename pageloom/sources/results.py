"""Result files under their names: a data source that writes one file for each document, all of a job or none.

``rows.write.format("results").mode("append").option("path", folder).save()`` takes (name, content) and writes each
content to ``folder/name``. Tasks write below a folder of their own; the driver moves the files to their names once all
tasks have ended, and takes the folder away. A task that fails or is run twice leaves nothing. Paths are what pyarrow's file systems open.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from pageloom.operators.exports import json_text, markdown_text, result_names
from pageloom.sources.layouts import _system

SCHEMA = "name string, content string"


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, root: str):
        self.root, self.job = root, uuid.uuid4().hex

    def _pending(self, place: str) -> str:
        return f"{place.rstrip('/')}/_pending-{self.job}"

    def write(self, iterator: Iterator) -> Written:
        system, place = _system(self.root)
        folder = f"{self._pending(place)}/{uuid.uuid4().hex}"  # each attempt of a task has its own
        system.create_dir(folder, recursive=True)
        names = []
        for row in iterator:
            if not row.name or row.name.startswith((".", "_")) or "/" in row.name:
                raise ValueError(f"{row.name!r} is no file name")
            with system.open_output_stream(f"{folder}/{row.name}") as f:
                f.write((row.content or "").encode())
            names.append(row.name)
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        system, place = _system(self.root)
        parts = [m for m in messages if m is not None]
        names = [n for m in parts for n in m.names]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two results have one name")
        for m in parts:
            for name in m.names:
                system.move(f"{m.folder}/{name}", f"{place.rstrip('/')}/{name}")
        system.delete_dir(self._pending(place))

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, place = _system(self.root)
        if system.get_file_info(self._pending(place)).type == fs.FileType.Directory:
            system.delete_dir(self._pending(place))


class ResultSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "results"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def result_files(questions: DataFrame, tasks: DataFrame, folder: str | None = None) -> DataFrame:
    """(name, content): the JSON and the Markdown of each document (doc_id) under its task's names; tasks: (id, name)."""
    names = result_names(tasks)
    texts = json_text(questions, folder).join(markdown_text(questions, folder).drop("total"), "doc_id")
    rows = texts.join(names, texts["doc_id"] == names["id"])
    both = F.explode(F.array(F.struct(F.col("json_name").alias("name"), F.col("json").alias("content")), F.struct(F.col("markdown_name").alias("name"), F.col("markdown").alias("content"))))
    return rows.select(both.alias("f")).select("f.name", "f.content")


def write_result_files(questions: DataFrame, tasks: DataFrame, path: str, folder: str | None = None) -> None:
    questions.sparkSession.dataSource.register(ResultSink)
    result_files(questions, tasks, folder).write.format("results").mode("append").option("path", path).save()
