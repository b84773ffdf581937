"""Layout files as a data source: one row for each raw block, read as a stream of elements, so that no file is a row.

``spark.read.format("layout").load(folder)`` gives (doc_id, pos, block fields); a schema of some fields reads only
those. ``spark.readStream.format("layout")`` gives the blocks of files that are new. Files are dealt to partitions by
size, so many small ones share a task. Paths are what pyarrow's file systems open: local and mounted folders, and object stores by address.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from pageloom.operators.blocks import RAW_BLOCK

FIELDS = [StructField("doc_id", StringType()), StructField("pos", IntegerType())]
#: Bytes of files that one partition reads, about, and bytes of a file that are read at a time.
PARTITION_BYTES, READ_BYTES = 32 << 20, 1 << 20


def elements(pieces: Iterator[bytes]) -> Iterator[object]:
    """The elements of a JSON array whose text comes in pieces; what isn't an array has none, and a broken end ends it."""
    decode, scan = codecs.getincrementaldecoder("utf-8-sig")(errors="replace"), json.JSONDecoder(strict=False).raw_decode
    text, begun = "", False
    for piece in _ended(pieces):
        text += decode.decode(piece or b"", final=piece is None)
        at = 0
        while True:
            while at < len(text) and text[at] in " \t\r\n,":
                at += 1
            if at == len(text):
                break
            if not begun:
                if text[at] != "[":
                    return
                begun, at = True, at + 1
                continue
            if text[at] == "]":
                return
            try:
                value, end = scan(text, at)
            except ValueError:
                break  # the element goes on in the next piece
            if piece is not None and text[end : end + 1] not in tuple(" \t\r\n,]"):
                break  # a number may go on
            yield value
            at = end
        text = text[at:]


def _ended(pieces: Iterator[bytes]) -> Iterator[bytes | None]:
    yield from pieces
    yield None


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str, suffix: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files below a folder whose name ends so, in order."""
    from pyarrow import fs

    system, root = _system(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)) if system.get_file_info(root).type != fs.FileType.File else [system.get_file_info(root)]
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(suffix) and not f.base_name.startswith(("_", ".")))


def _as(kind, value):
    """A JSON value as a field's type; what doesn't fit is null, as Spark's own reader has it."""
    name = kind.typeName()
    if value is None:
        return None
    if name == "array":
        return [_as(kind.elementType, v) for v in value] if isinstance(value, list) else None
    if name == "struct":
        return tuple(_as(f.dataType, value.get(f.name)) for f in kind.fields) if isinstance(value, dict) else None
    if name == "string":
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    return float(value) if name == "double" else value if isinstance(value, int) and -(1 << 31) <= value < 1 << 31 else None


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


def _rows(root: str, paths: list[str], schema: StructType) -> Iterator[tuple]:
    system, _ = _system(root)
    for path in paths:
        with system.open_input_stream(path) as f:
            pieces = iter(lambda: f.read(READ_BYTES), b"")
            for pos, block in enumerate(elements(pieces)):
                block = block if isinstance(block, dict) else {}
                yield tuple(path if f.name == "doc_id" else pos if f.name == "pos" else _as(f.dataType, block.get(f.name)) for f in schema.fields)


def _dealt(found: list[tuple[str, int]]) -> list[Files]:
    """Files in groups of about PARTITION_BYTES."""
    out: list[list[str]] = []
    held = PARTITION_BYTES
    for path, size in found:
        if held + size > PARTITION_BYTES:
            out.append([])
            held = 0
        out[-1].append(path)
        held += size
    return [Files(paths) for paths in out]


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, root: str, suffix: str):
        self.wanted, self.root, self.suffix = schema, root, suffix

    def partitions(self) -> list[Files]:
        return _dealt(listed(self.root, self.suffix))

    def read(self, partition: Files | None) -> Iterator[tuple]:
        return _rows(self.root, partition.paths if partition else [], self.wanted)  # none where there are no files


class _StreamReader(DataSourceStreamReader):
    """New files in order of name: an offset is the last name seen, so names must grow, as those of dated folders do."""

    def __init__(self, schema: StructType, root: str, suffix: str):
        self.wanted, self.root, self.suffix, self.seen = schema, root, suffix, ""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"after": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        self.seen = max([self.seen, *[p for p, _ in listed(self.root, self.suffix)]])
        return {"after": self.seen}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return _dealt([x for x in listed(self.root, self.suffix) if start["after"] < x[0] <= end["after"]])

    def read(self, partition: Files) -> Iterator[tuple]:
        return _rows(self.root, partition.paths, self.wanted)


class LayoutSource(DataSource):
    """Options: path, suffix (of file names, ``content_list.json`` by default)."""

    @classmethod
    def name(cls) -> str:
        return "layout"

    def schema(self) -> StructType:
        return StructType([*FIELDS, *[StructField(f.name, f.dataType) for f in RAW_BLOCK.fields]])

    def _options(self) -> tuple[str, str]:
        return self.options["path"], self.options.get("suffix", "content_list.json")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, *self._options())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(schema, *self._options())
