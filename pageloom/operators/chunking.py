"""Overlapping chunks of a document's blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import block_tokens, outline_tokens

SIZE, OVERLAP, BUDGET = 100, 30, 100_000
OUTLINE_SHARE, OUTLINE_OVERLAP = 0.8, 2000


def chunk_windows(counts: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk_index, start_id, end_id) of (doc_id, n) where the token budget doesn't bind: arithmetic, no shuffle."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - size) / step)).cast("int")
    rows = counts.where("n > 0").select("doc_id", "n", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    start = (F.col("chunk_index") * step).cast("int")
    return rows.select("doc_id", "chunk_index", start.alias("start_id"), F.least(start + size, F.col("n").cast("int")).alias("stop")).select("doc_id", "chunk_index", "start_id", (F.col("stop") - 1).alias("end_id"))


def chunks_of_block(block_id: Column, n: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Array of the chunk indexes that hold a block: membership without a join."""
    step = size - overlap
    first = F.greatest(F.lit(0), F.ceil((block_id - size + 1) / step)).cast("int")
    last = F.least(F.floor(block_id / step), F.greatest(F.lit(0), F.ceil((n - size) / step))).cast("int")
    return F.sequence(first, last)


def fold_chunks(tokens: list[int], size: int = SIZE, overlap: int = OVERLAP, budget: int = BUDGET) -> list[tuple[int, int]]:
    """(start, end) of greedy chunks under a token budget; every chunk begins after the one before it."""
    out, start, n = [], 0, len(tokens)
    while start < n:
        end, used = start, 0
        while end < n and end - start < size and used < budget and (end == start or used + tokens[end] <= budget):
            used += tokens[end]
            end += 1
        out.append((start, end))
        if end == n:
            break
        start = max(end - overlap, start + 1)
    return out


def fold_outline_chunks(tokens: list[int], limit: int, overlap: int = OUTLINE_OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of chunks of outline lines under 80 % of a limit, each with the last ``overlap`` tokens of the one before."""
    safe, out, start, used = int(limit * OUTLINE_SHARE), [], 0, 0
    for i, t in enumerate(tokens):
        if used + t > safe and i > start:
            out.append((start, i))
            start, used = i, 0
            while start > 0 and used < overlap:
                start -= 1
                used += tokens[start]
        used += t
    return [*out, (start, len(tokens))] if tokens else out


def _folded(lists: DataFrame, fold) -> DataFrame:
    """(doc_id, chunk_index, start_id, end_id) of (doc_id, tokens array): a fold over Arrow batches of whole documents."""
    kind = lists.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, index, first, last = [], [], [], []
            for i, tokens in enumerate(batch.column(1).to_pylist()):
                spans = fold(tokens)
                which += [i] * len(spans)
                index += range(len(spans))
                first += [s for s, _ in spans]
                last += [e - 1 for _, e in spans]
            ints = [pa.array(x, pa.int32()) for x in (index, first, last)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int32())), *ints], names=["doc_id", "chunk_index", "start_id", "end_id"])

    return lists.mapInArrow(run, f"doc_id {kind}, chunk_index int, start_id int, end_id int")


def _token_lists(blocks: DataFrame, tokens: Column) -> DataFrame:
    """(doc_id, tokens): the estimates of each document's blocks in order; only ids and estimates are put together."""
    sized = blocks.select("doc_id", "id", tokens.alias("t"))
    rows = sized.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("id", "t"))).alias("x"))
    return rows.select("doc_id", F.col("x.t").alias("tokens"))


def token_chunks(blocks: DataFrame, size: int = SIZE, overlap: int = OVERLAP, budget: int = BUDGET) -> DataFrame:
    """Chunks for extraction under a token budget, folded document by document in one pass over the blocks."""
    return _folded(_token_lists(blocks, block_tokens(F.col("type"), F.col("text"))), lambda t: fold_chunks(t, size, overlap, budget))


def outline_chunks(blocks: DataFrame, limit: int) -> DataFrame:
    return _folded(_token_lists(blocks, outline_tokens(F.col("type"), F.col("text"))), lambda t: fold_outline_chunks(t, limit))


def chunk_members(blocks: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """blocks with chunk_index, once for each chunk that holds the block (budget not binding)."""
    counts = blocks.groupBy("doc_id").agg(F.count("*").alias("n"))
    return blocks.join(counts, "doc_id").withColumn("chunk_index", F.explode(chunks_of_block(F.col("id"), F.col("n"), size, overlap))).drop("n")


def members_of(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, id, start_id, end_id): each chunk once for each of its ids, so that blocks are met by an equi-join."""
    return chunks.select("doc_id", "chunk_index", "start_id", "end_id", F.explode(F.sequence("start_id", "end_id")).alias("id"))
