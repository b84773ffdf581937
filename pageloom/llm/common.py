"""Helpers shared by the corpus operators."""

from __future__ import annotations

import string
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z and leave every other character alone."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (null ids: 0)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n)), F.lit(0))


def crc_mod_py(doc_id: int | None, n: int) -> int:
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def byte_rows(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text of an Arrow column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pack_ints(values: np.ndarray, width: int = 4) -> bytes:
    """Non-negative integers as byte planes under zstd: small values cost about a byte."""
    import zstandard

    raw = np.ascontiguousarray(values.astype(f"<u{width}")).view(np.uint8).reshape(-1, width)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T).tobytes())


def unpack_ints(blob: bytes, width: int = 4) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(f"<u{width}").reshape(-1).astype(np.int64)
