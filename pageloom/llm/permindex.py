"""Approximate nearest neighbours by a permutation index.

Every vector becomes the ordered list of its nearest pivots, cut after PREFIX places. The lists are posted in inverted
files, one for each pivot, that hold (vector, place of the pivot in its list). A query opens only the files of its own
READ nearest pivots and adds up how far the places differ (footrule; a pivot missing from a list has the last place).
The best by footrule, a number that grows as the square root of the table, are reranked by exact cosine.

The number of pivots grows with the square root, too, so that a query meets READ * PREFIX / pivots of all postings.
The index is dealt out by vectors, as search engines do: a block of BLOCK_ROWS vectors has its own inverted files, so
the sums of a query stay in one task, and packed queries are sent to each block. Equal vectors are indexed once, with
the few smallest ids that a result can hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.session import cut

#: Pivots for the square root of the number of distinct vectors; the least and most of them, and the bytes they take at most.
PIVOT_ROOT, LEAST_PIVOTS, MOST_PIVOTS, PIVOT_BYTES = 4.5, 64, 1 << 14, 64 << 20
#: Pivots come from a bounded sample by hash, this many times their number; none is nearly equal to another.
PIVOT_SAMPLE, PIVOT_LIKENESS = 2, 0.8
#: Places kept of each list, and how many of its nearest pivots' files a query opens.
PREFIX, READ = 128, 32
#: Vectors reranked for the square root of the number of distinct vectors.
RERANK_ROOT = 8.0
BLOCK_ROWS, PACKED_QUERIES = 1 << 15, 256
QUERY_EVERY, NEAREST = 50, 5


def pivot_count(total: int, dim: int) -> int:
    """A power of two near PIVOT_ROOT times the root of ``total``, within the bounds."""
    wanted = max(1.0, PIVOT_ROOT * total**0.5)
    most = min(MOST_PIVOTS, PIVOT_BYTES // (4 * max(1, dim)))
    return int(min(max(LEAST_PIVOTS, 1 << round(np.log2(wanted))), max(1, most)))


def rerank_count(total: int) -> int:
    return int(np.ceil(RERANK_ROOT * total**0.5))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; a power of two is taken out first, so that no square overflows."""
    scaled = scaled_rows(vectors)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def scaled_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two each (which is exact), with largest components near one."""
    exponent = np.frexp(np.abs(vectors).max(1))[1] if len(vectors) else np.empty(0, np.int32)
    return np.ldexp(vectors, -exponent[:, None])


def choose_pivots(sample: np.ndarray, wanted: int) -> np.ndarray:
    """Unit vectors of the sample in its order, without those too much like one that is chosen already."""
    unit = unit_rows(sample).astype(np.float32)
    chosen = np.empty((min(wanted, len(unit)), unit.shape[1]), np.float32)
    n = 0
    for row in unit:
        if n < len(chosen) and not (n and (chosen[:n] @ row).max() > PIVOT_LIKENESS):
            chosen[n] = row
            n += 1
    return chosen[:n]


def pivot_lists(unit: np.ndarray, pivots: np.ndarray, places: int) -> np.ndarray:
    """The nearest pivots of each row, nearest first."""
    out = np.empty((len(unit), min(places, len(pivots))), np.int32)
    for s in range(0, len(unit), 1024):
        near = -(unit[s : s + 1024].astype(np.float32) @ pivots.T)
        if out.shape[1] < near.shape[1]:
            first = np.argpartition(near, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
            order = np.argsort(np.take_along_axis(near, first, 1), axis=1, kind="stable")
            out[s : s + 1024] = np.take_along_axis(first, order, 1)
        else:
            out[s : s + 1024] = np.argsort(near, axis=1, kind="stable")
    return out


class Block:
    """The inverted files of one block, and its vectors for reranking."""

    def __init__(self, vectors: np.ndarray, ids: list[list[int]], pivots: np.ndarray, total: int):
        self.vectors, self.ids, self.pivots = scaled_rows(vectors), ids, pivots
        self.norms = np.linalg.norm(self.vectors, axis=1)
        self.first = np.array([x[0] for x in ids], np.int64)
        lists = pivot_lists(self.vectors / self.norms[:, None], pivots, PREFIX)
        self.last = lists.shape[1]
        order = np.argsort(lists, axis=None, kind="stable")
        self.rows, self.places = (order // self.last).astype(np.int32), (order % self.last).astype(np.int16)
        self.begins = np.searchsorted(lists.reshape(-1)[order], np.arange(len(pivots) + 1))
        self.rerank = min(len(vectors), max(NEAREST + 1, -(-rerank_count(total) * len(vectors) // max(1, total))))

    def closeness(self, nearest: np.ndarray) -> np.ndarray:
        """How much the footrule distance of each row to a query is below the greatest, over the files of the query's nearest pivots.

        Places a and b of a shared pivot add (last - a) + (last - b) - |a - b|, twice what the greater leaves to the last.
        """
        out = np.zeros(len(self.vectors), np.int32)
        for here, p in enumerate(nearest[:READ].tolist()):
            own = slice(self.begins[p], self.begins[p + 1])
            out[self.rows[own]] += self.last - np.maximum(self.places[own], here).astype(np.int32)
        return out

    def search(self, query_id: int, vector: np.ndarray, nearest: np.ndarray, k: int) -> list[tuple[int, float]]:
        """The k nearest found in this block, without the query's own row."""
        close = self.closeness(nearest)
        cand = np.arange(len(close)) if self.rerank == len(close) else np.argpartition(-close, self.rerank - 1)[: self.rerank]
        score = np.einsum("ij,j->i", self.vectors[cand], vector) / (self.norms[cand] * np.linalg.norm(vector))
        top = np.lexsort((self.first[cand], -score))[: k + 1]
        found = [(i, float(score[r])) for r in top for i in self.ids[cand[r]] if i != query_id]
        return sorted(found, key=lambda x: (-x[1], x[0]))[:k]


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v) with v in double precision; null, empty, zero and non-finite vectors and null ids are left out."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    return rows.where(finite & F.exists("v", lambda x: x != 0))


def nearest(embeddings: DataFrame, every: int = QUERY_EVERY, k: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, its k nearest others found.

    Ties go to the smaller id; equal (id, vector) rows count once; vectors whose length is not the most common one
    (ties: the longer) take no part, as a cosine with the others is undefined. Very large and very small components
    are scaled by a power of two, which changes no cosine. Empty tables give no rows.
    """
    spark = embeddings.sparkSession
    rows = usable(embeddings)
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dim = dims[0].d if dims else 1
    rows = rows.where(F.size("v") == dim).distinct()
    smallest = Window.partitionBy("v").orderBy("vec_id")
    held = rows.withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= k + 1)  # limited before the shuffle, too
    distinct = cut(held.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    total = distinct.count()
    wanted = pivot_count(total, dim)
    sample = distinct.orderBy(F.xxhash64("v"), "v").limit(PIVOT_SAMPLE * wanted).select("v").collect()
    shared = spark.sparkContext.broadcast(choose_pivots(np.array([r.v for r in sample], float).reshape(-1, dim), wanted))
    blocks = max(1, -(-total // BLOCK_ROWS))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.array(batch.column("v").flatten(), float).reshape(-1, dim)
            ids = np.array(batch.column("vec_id"), np.int64)
            starts = range(0, len(ids), PACKED_QUERIES)
            if len(ids):
                packed = [[x[s : s + PACKED_QUERIES].tobytes() for s in starts] for x in (ids, v)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in packed], names=["asked", "asked_v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block, vectors, ids = None, None, [], []
        for batch in batches:
            out = []
            which, asked = batch.column("block").to_numpy(), batch.column("asked")
            is_query = asked.is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (is_query[1:] != is_query[:-1]), True])
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if which[s] != at:
                    at, block, vectors, ids = which[s], None, [], []
                if not is_query[s]:
                    vectors.append(np.array(batch.column("v").slice(s, e - s).flatten(), float).reshape(-1, dim))
                    ids += batch.column("ids").slice(s, e - s).to_pylist()
                    continue
                if not vectors:
                    continue
                block = block or Block(np.concatenate(vectors), ids, shared.value, total)
                for names, raw in zip(asked.slice(s, e - s).to_pylist(), batch.column("asked_v").slice(s, e - s).to_pylist(), strict=True):
                    v = scaled_rows(np.frombuffer(raw, float).reshape(-1, dim))
                    lists = pivot_lists(unit_rows(v), shared.value, READ)
                    for q, x, own in zip(np.frombuffer(names, np.int64).tolist(), v, lists, strict=True):
                        out += [(q, j, c) for j, c in block.search(q, x, own, k)]
            if out:
                q, j, x = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(j, pa.int64()), pa.array(x, pa.float64())], names=["query_id", "vec_id", "score"])

    none = lambda kind: F.lit(None).cast(kind)
    posted = distinct.select(F.pmod(F.xxhash64("v"), F.lit(blocks)).alias("block"), none("binary").alias("asked"), none("binary").alias("asked_v"), "ids", "v")
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).mapInArrow(pack, "asked binary, asked_v binary")
    to_all = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    asked = queries.select(to_all.alias("block"), "asked", "asked_v", none("array<bigint>").alias("ids"), none("array<double>").alias("v"))
    both = posted.union(asked).repartition(blocks, "block").sortWithinPartitions("block", "asked")  # null first: a block's vectors before its queries
    found = both.mapInArrow(run, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
