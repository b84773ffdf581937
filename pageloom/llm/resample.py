"""Importance resampling towards a target corpus, by hashed word n-grams.

Texts are read in chunks. A chunk maps its distinct words to whole numbers, so that a run of words is a tuple of
numbers (one 64-bit code); equal tuples are found by sorting codes, the bytes of each distinct tuple are put together
from the dictionary and hashed once, and the hashes are joined back to all places of the tuple. A dictionary is a
chunk's own: it needs no shuffle, is bounded by the chunk, and a chunk read again makes the same rows. Each document's
buckets are written once as a compressed table, which both the corpus counts and the weights are made of. Counts are
summed for each task before they meet, and gains are one number for each bucket, whatever the size of the corpus.

The draw is by rank of weight plus Gumbel noise from a hash of the id. Ranks come from ranges of the order: rows are
dealt into ranges, numbered inside each, and moved by what the ranges before hold; equal ids are told apart by a number
of their own, so that no key fills a range.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import byte_rows, pack_ints, unpack_ints
from pageloom.session import stored

BUCKETS = 10_000
#: Bytes of text after which a chunk ends; a longer document is a chunk of its own.
CHUNK_BYTES = 8 << 20
#: A-Z become small letters; bytes that are in no word become spaces.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def tuple_buckets(words: list[bytes], sequence: np.ndarray, lengths: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every single word and every pair of neighbours, where documents follow each other in sequence."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    crcs = [zlib.crc32(w) for w in words]
    inside = np.flatnonzero(doc[1:] == doc[:-1])
    codes, place = np.unique((sequence[inside] << 32) | sequence[inside + 1], return_inverse=True)
    spaced = [b" " + w for w in words]
    first, second = (codes >> 32).tolist(), (codes & 0xFFFFFFFF).tolist()
    pairs = np.fromiter((zlib.crc32(spaced[b], crcs[a]) for a, b in zip(first, second, strict=True)), np.int64, len(codes))  # goes on from the first word's bytes
    singles = np.array(crcs, np.int64)[sequence] if len(sequence) else np.empty(0, np.int64)
    return np.concatenate([doc, doc[inside]]), np.concatenate([singles, pairs[place]]) % buckets


def document_buckets(texts: DataFrame, id_column: str, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, buckets) for each row; buckets: a packed, sorted list with repeats."""

    def rows_of(ids: list, sequences: list[list[int]], number: dict[bytes, int]) -> pa.RecordBatch:
        lengths = np.array([len(s) for s in sequences], np.int64)
        sequence = np.concatenate([np.array(s, np.int64) for s in sequences])
        doc, bucket = tuple_buckets(list(number), sequence, lengths, buckets)
        both = np.sort((doc << 32) | bucket)
        ends = np.searchsorted(both, np.arange(1, len(ids) + 1) << 32)
        n = np.diff(ends, prepend=0)
        packed = [pack_ints(both[e - k : e] & 0xFFFFFFFF) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths), pa.array(n), pa.array(packed, pa.binary())], names=["doc_id", "n_words", "n_features", "buckets"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sequences, number, size = [], [], {}, 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), byte_rows(batch.column(1)), strict=True):
                if ids and size + len(text) > CHUNK_BYTES:
                    yield rows_of(ids, sequences, number)
                    ids, sequences, number, size = [], [], {}, 0
                ids.append(i)
                sequences.append([number.setdefault(w, len(number)) for w in words_of(text)])
                size += len(text)
        if ids:
            yield rows_of(ids, sequences, number)

    return texts.select(F.col(id_column).cast("long"), "text").mapInArrow(read, "doc_id long, n_words long, n_features long, buckets binary")


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows each bucket holds; one row for each task and bucket is summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                total += np.bincount(unpack_ints(blob), minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["bucket", "n"])

    sums = rows.select("buckets").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most one row for each bucket
    out = np.zeros(buckets, np.int64)
    for bucket, n in sums:
        out[bucket] = n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down."""
    all_source, all_target, buckets = int(source.sum()), int(target.sum()), len(source)
    ratio = lambda s, t: ((t + 1) * (all_source + buckets)) / ((s + 1) * (all_target + buckets))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(rows: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the mean gain of a document's features, rounded down (none: 0)."""
    known = rows.sparkSession.sparkContext.broadcast(gains)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        for batch in batches:
            counts = batch.column(2).to_pylist()
            weights = [int(table[unpack_ints(blob)].sum()) // n if n else 0 for n, blob in zip(counts, batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(weights, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return rows.select("doc_id", "n_words", "n_features", "buckets").mapInArrow(sums, "doc_id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame) -> DataFrame:
    """rows with ``rank`` from 1 by score descending and doc_id ascending (null ids first); no task holds more than a range."""
    order = [F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("_tie")]
    ranges = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranges = stored(ranges, "resample-ranges")  # written, so that ranges stay as they were cut
    held = sorted(ranges.groupBy("_range").count().collect())  # one row for each range
    starts, at = [], 0
    for part, n in held:
        starts.append((part, at))
        at += n
    offsets = rows.sparkSession.createDataFrame(starts, "_range int, _start long")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.withColumn("_n", inside).join(F.broadcast(offsets), "_range").withColumn("rank", F.col("_start") + F.col("_n")).drop("_tie", "_range", "_start", "_n")


def resample(docs: DataFrame, target: DataFrame, share: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS, target_id: str = "item_id") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row of documents; rank is null where a document isn't drawn.

    Of the rows with ``least_words`` words or more, ``share`` percent (rounded down) are drawn. Null and empty texts
    have no features, weight 0 and are never drawn. A null doc_id stays null, and its noise is that of an empty id.
    Repeated rows count as often as they are there; rows with one doc_id have one noise, and of equal scores the smaller
    doc_id and then the smaller number of features comes first. With an empty target, or no documents, counts are zero
    and the formulas hold. Other columns are ignored.
    """
    rows = stored(document_buckets(docs, "doc_id", buckets), "resample-buckets")
    gains = bucket_gains(bucket_counts(rows, buckets), bucket_counts(document_buckets(target, target_id, buckets), buckets))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    noise = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0)))
    scored = stored(weigh(rows, gains).withColumn("score", (F.col("weight") + gumbel).cast("long")), "resample-scores")
    eligible = scored.where(F.col("n_words") >= least_words)
    drawn = share * eligible.count() // 100
    out = ["doc_id", "n_features", "weight", "score"]
    chosen = ranked(eligible).select(*out, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return chosen.union(scored.where(F.col("n_words") < least_words).select(*out, F.lit(None).cast("long").alias("rank")))
