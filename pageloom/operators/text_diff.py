"""Differences of two texts line by line."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the table of one comparison that is traced back at once; larger ones are halved first.
TABLE_BITS = 1 << 29


def _rows(a: list[str], b: list[str]) -> Iterator[int]:
    """Rows of the table of longest common subsequences, one for each line of b: a bit of a is clear where the length grows."""
    at: dict[str, int] = {}
    for i, line in enumerate(a):
        at[line] = at.get(line, 0) | (1 << i)
    full = row = (1 << len(a)) - 1
    for line in b:
        met = row & at.get(line, 0)
        row = ((row + met) | (row - met)) & full
        yield row


def common_lines(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of two lists of lines; a row of the usual table is one long integer."""
    row = (1 << len(a)) - 1
    for row in _rows(a, b):
        pass
    return len(a) - row.bit_count()


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of b and the first k lines of a, for each k."""
    row = (1 << len(a)) - 1
    for row in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(a)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def matches(a: list[str], b: list[str], table_bits: int = TABLE_BITS) -> list[tuple[int, int]]:
    """Places (in a, in b) of a longest common subsequence, in order.

    Small tables are kept whole and traced back; a larger one is cut where both halves of b have most in common with the
    two parts of a, so that memory stays bounded.
    """
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    x, y = a[start : len(a) - end], b[start : len(b) - end]
    found: list[tuple[int, int]] = []
    if x and y and len(x) * len(y) > table_bits and len(y) > 1:
        half = len(y) // 2
        cut = int(np.argmax(_lengths(x, y[:half]) + _lengths(x[::-1], y[half:][::-1])[::-1]))
        found = matches(x[:cut], y[:half], table_bits) + [(i + cut, j + half) for i, j in matches(x[cut:], y[half:], table_bits)]
    elif x and y:
        rows = list(_rows(x, y))
        i, j = len(x), len(y)
        while i and j:
            if rows[j - 1] >> (i - 1) & 1:  # the length doesn't grow with this line of a
                i -= 1
                continue
            j -= 1
            if j and not rows[j - 1] >> (i - 1) & 1:  # it grew before this line of b
                continue
            i -= 1
            found.append((i, j))
        found.reverse()
    same = [(k, k) for k in range(start)] + [(i + start, j + start) for i, j in found]
    return same + [(len(a) - end + k, len(b) - end + k) for k in range(end)]


def edit_runs(a: list[str], b: list[str], table_bits: int = TABLE_BITS) -> Iterator[tuple[str, int, int, list[str]]]:
    """(kind, place in a, place in b, lines): runs of equal, removed and added lines in order; what goes stands before what comes."""
    i = j = 0
    equal: list[str] = []
    for at, to in [*matches(a, b, table_bits), (len(a), len(b))]:
        if (at, to) != (i, j) or at == len(a) and to == len(b):
            if equal:
                yield "equal", i - len(equal), j - len(equal), equal
                equal = []
            if at > i:
                yield "removed", i, j, a[i:at]
            if to > j:
                yield "added", at, j, b[j:to]
        if at < len(a) and to < len(b):
            equal.append(a[at])
        i, j = at + 1, to + 1


@F.udtf(returnType="ord int, kind string, a_line int, b_line int, lines array<string>")
class Hunks:
    """The edit script of two texts; null is an empty text."""

    def eval(self, a: str | None, b: str | None):
        for n, run in enumerate(edit_runs((a or "").split("\n"), (b or "").split("\n"))):
            yield n, *run


def diff_hunks(texts: DataFrame) -> DataFrame:
    """(doc_id, ord, kind, a_line, b_line, lines) of (doc_id, a, b): ordered runs of equal, removed and added lines.

    The fewest lines are added and removed. Equal and removed runs in order give a, equal and added runs give b.
    """
    return texts.lateralJoin(Hunks(F.col("a").outer(), F.col("b").outer())).select("doc_id", "ord", "kind", "a_line", "b_line", "lines")


def line_diff(texts: DataFrame) -> DataFrame:
    """(doc_id, same, added, removed) of (doc_id, a, b): the fewest lines to add and remove, whatever the size."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x, y = (a or "").split("\n"), (b or "").split("\n")
                same = common_lines(x, y)
                out.append((same, len(y) - same, len(x) - same))
            cols = list(zip(*out, strict=True)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols]], names=["doc_id", "same", "added", "removed"])

    return texts.select("doc_id", "a", "b").mapInArrow(run, f"doc_id {kind}, same long, added long, removed long")
