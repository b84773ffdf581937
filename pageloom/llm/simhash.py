"""SimHash near-duplicates: pivot distance tables over fingerprints.

A pair within ``radius`` bits has, for every reference fingerprint p, coordinates d(x,p) and d(y,p) that differ by
``radius`` at most. Two 64-bit fingerprints of unrelated texts lie near 32 bits from any reference, so coordinates
alone can't be a join key without comparing most pairs; candidates are therefore met in buckets of equal bit blocks
(with ``radius`` differing bits spread over b blocks, some b-radius blocks are equal: nothing is lost), and inside a
bucket the table of reference distances discards pairs before the survivors are verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pageloom.llm.common import byte_rows
from pageloom.llm.graph import connected_components
from pageloom.session import cut, stored

SHINGLE, SEED, RADIUS = 4, 42, 4
REFERENCES = np.random.default_rng(20).integers(0, 2**64, 24, dtype=np.uint64)
#: Bucket rows compared at once; larger buckets are dealt again by finer keys.
BUCKET_LIMIT = 2048
#: Parts in which a component's fingerprints look up its smallest id.
ROOT_PARTS = 64
PIECE = 1 << 16


def fingerprint(text: bytes, k: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the k-word shingles of one text (A-Z lowered); no words give zero."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - k + 1)
    joined, ones = b" ".join(words), np.zeros(64, np.int64)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    ends = starts[min(k, len(words)) :][:n] - 1
    h = xxhash.xxh64_intdigest
    for at in range(0, n, PIECE):
        pairs = zip(starts[at : min(n, at + PIECE)].tolist(), ends[at : at + PIECE].tolist(), strict=True)
        hashes = np.array([h(joined[i:j], seed) for i, j in pairs], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for each row; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x) for x in byte_rows(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def with_fingerprints(docs: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """Every row of documents with all its columns and its fingerprint in the column ``name``."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x) for x in byte_rows(batch.column(at))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps, pa.int64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def block_masks(blocks: int, radius: int) -> list[int]:
    """Masks of all choices of blocks-radius blocks; two values within radius bits agree under one of them at least."""
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    one = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [signed(sum(c)) for c in combinations(one, blocks - radius)]


def with_keys(fps: DataFrame, masks: list[int], *salt: str) -> DataFrame:
    keys = [F.xxhash64(F.col("fp").bitwiseAND(F.lit(m)), F.lit(i), *salt) for i, m in enumerate(masks)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def _near(table: np.ndarray, fps: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs lie within radius: coordinates first, then the bits of the survivors."""
    ok = np.abs(table[i] - table[j]).max(1) <= radius
    ok[ok] = np.bitwise_count(fps[i[ok]] ^ fps[j[ok]]) <= radius
    return ok


def _forest(table: np.ndarray, fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that connect what is linked within one bucket, without listing all pairs."""
    left, edges = np.arange(len(fps)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = _near(table, fps, np.full(len(left), x), left, radius)
            found = left[hit]
            edges += [(int(x), int(y)) for y in found]
            queue += found.tolist()
            left = left[~hit]
    return edges


def bucket_links(keyed: DataFrame, radius: int, last: bool) -> DataFrame:
    """Links (a, b, null) inside buckets; rows of too large buckets come back as (fp, null, key) unless this is the last deal."""
    schema = "a long, b long, key long"
    references = REFERENCES

    def flush(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        bounds = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        sizes = np.diff(bounds)
        many = np.repeat(sizes > 1, sizes)
        keys, fps = keys[many], fps[many].view(np.uint64)
        sizes = sizes[sizes > 1]
        if not len(sizes):
            return
        starts = np.r_[0, np.cumsum(sizes)]
        table = np.bitwise_count(fps[:, None] ^ references[None, :]).astype(np.int8)
        a, b = [], []
        small = np.repeat(sizes <= 32, sizes)
        for s in range(1, 32):
            i = np.flatnonzero((keys[s:] == keys[:-s]) & small[s:])
            if not len(i):
                break
            ok = _near(table, fps, i, i + s, radius)
            a.append(fps[i[ok]])
            b.append(fps[i[ok] + s])
        for r in np.flatnonzero(sizes > 32):
            own = slice(starts[r], starts[r + 1])
            pairs = np.array(_forest(table[own], fps[own], radius), np.int64).reshape(-1, 2)
            a.append(fps[own][pairs[:, 0]])
            b.append(fps[own][pairs[:, 1]])
        a, b = (np.concatenate([np.empty(0, np.uint64), *x]).view(np.int64) for x in (a, b))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], names=["a", "b", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, over = np.empty(0, np.int64), np.empty(0, np.int64), None
        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy()])
            fps = np.concatenate([fps, batch.column("fp").to_numpy()])
            while len(keys):
                if over is not None:  # a bucket that was found too large goes on
                    n = int(np.searchsorted(keys != over, True)) if (keys != over).any() else len(keys)
                    if n:
                        yield pa.RecordBatch.from_arrays([pa.array(fps[:n]), pa.nulls(n, pa.int64()), pa.array(keys[:n])], names=["a", "b", "key"])
                    keys, fps, over = keys[n:], fps[n:], over if n == len(keys) else None
                    continue
                first = np.flatnonzero(keys != keys[-1])
                end = int(first[-1]) + 1 if len(first) else 0
                if end:
                    yield from flush(keys[:end], fps[:end]) if last else split(keys[:end], fps[:end])
                    keys, fps = keys[end:], fps[end:]
                if not last and len(keys) > BUCKET_LIMIT:
                    over = keys[0]
                    continue
                break
        if len(keys):
            yield from flush(keys, fps)

    def split(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        bounds = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        big = np.repeat(np.diff(bounds) > BUCKET_LIMIT, np.diff(bounds))
        if big.any():
            yield pa.RecordBatch.from_arrays([pa.array(fps[big]), pa.nulls(int(big.sum()), pa.int64()), pa.array(keys[big])], names=["a", "b", "key"])
        yield from flush(keys[~big], fps[~big])

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


def near_components(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root, component_id) for every distinct fingerprint of (doc_id, fp); component_id is the smallest doc_id reachable.

    ``root`` is a fingerprint that names the component, also where all its ids are null.

    Copies collapse into one fingerprint before anything is compared, and a bucket over BUCKET_LIMIT rows is dealt
    again by finer keys, so a group that holds a third of all rows meets no quadratic step. All links count; none is capped.
    """
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    n = max(1, distinct.count())
    blocks = next((b for b in (radius + 2, radius + 3) if 64 * (b - radius) / b > 4 + np.log2(n)), radius + 4)  # wider keys for more rows
    found = cut(bucket_links(with_keys(distinct, block_masks(blocks, radius)), radius, last=False))
    links = found.where("key is null").select("a", "b")
    if not (big := found.where("key is not null")).isEmpty():
        finer = with_keys(big.select(F.col("a").alias("fp"), "key"), block_masks(2 * radius, radius), "key")
        links = links.union(bucket_links(finer, radius, last=True).select("a", "b"))
    roots = connected_components(links, "a", "b")
    labelled = cut(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "doc_id", "root"))
    alone = labelled.where("root is null").select("fp", F.col("fp").alias("root"), F.col("doc_id").alias("component_id"))
    salt = F.pmod(F.xxhash64("fp"), F.lit(ROOT_PARTS)).cast("int")  # a component may hold a third of all fingerprints
    linked = labelled.where("root is not null").withColumn("part", salt)
    least = linked.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.collect_set("part").alias("parts"))
    least = least.select("root", "component_id", F.explode("parts").alias("part"))
    return alone.union(linked.join(least, ["root", "part"]).select("fp", "root", "component_id"))


def simhash_near_dedup(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of documents.

    Null or empty text has fingerprint zero and is linked like any other; repeated rows stay rows of their own;
    a null doc_id keeps its row and never names a component unless all of its component's ids are null.
    """
    fps = cut(fingerprints(docs))
    out = fps.join(near_components(fps, radius), "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of documents for each near-duplicate component: that of the smallest doc_id, null last, then by a hash of the text.

    Rows are told apart by their places in the table that is written first, so unrelated rows without an id, or with one
    id, all stay, and of repeated rows one does. Null and empty texts are one component. Columns may have any type and
    name; the first row of each component is found on narrow rows, by fingerprint before by component.
    """
    name = "_fp"
    while name in docs.columns:
        name += "_"
    table = stored(with_fingerprints(docs, name), "fingerprinted")
    place = table.metadataColumn("_metadata")
    rows = table.select(F.struct("*").alias("row"), place["file_name"].alias("file"), place["row_index"].alias("at"))
    row = F.col("row")
    order = F.struct(row["doc_id"].isNull().alias("no_id"), row["doc_id"].cast("long").alias("doc_id"), F.xxhash64(row["text"]).alias("h"), "file", "at")
    firsts = cut(rows.groupBy(row[name].alias("fp")).agg(F.min(order).alias("first")))
    found = near_components(firsts.select("fp", "first.doc_id"), radius)
    kept = firsts.join(found, "fp").groupBy("root").agg(F.min("first").alias("first")).select("first.file", "first.at")
    return rows.join(kept, ["file", "at"], "left_semi").select(*[row[c].alias(c) for c in docs.columns])
