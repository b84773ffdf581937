"""Byte-level BPE by a global shuffle of distinct words.

Documents are read in chunks. A chunk's pre-tokens are numbered in order of first sight, so a document becomes a
sequence of numbers (its words' positions) and the chunk a list of distinct words. The words are dealt out by hash,
packed in one blob for each chunk and target; a target encodes each distinct word once, whatever the number of chunks
that have it, and answers every blob with the ids in the order asked. Answers and sequences meet again by chunk, where
the ids are put back by position. No word, however frequent, makes more than one entry for each chunk, and a chunk makes
no more blobs than it has distinct words. As the input is cut into chunks twice, one that isn't a plain read of files
is written first.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.common import pack_ints, unpack_ints
from pageloom.session import estimated_bytes, settled

#: Bytes of text after which a chunk ends; a longer document is a chunk of its own.
CHUNK_BYTES = 64 << 20
#: A vocabulary file over this size is refused, as it is broadcast (public ones have under 10 MB).
VOCABULARY_BYTES = 64 << 20
#: Targets are the root of the input in units of so many bytes (as distinct words grow with the root, about), and this many at least.
TARGET_BYTES, LEAST_TARGETS = 16 << 10, 256
#: Bytes of ids and decoded texts after which rows are handed on.
ROW_BYTES = 16 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks; a file over VOCABULARY_BYTES is an error, never a part of it."""
    with open(path, "rb") as f:
        raw = f.read(VOCABULARY_BYTES + 1)
    if len(raw) > VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {VOCABULARY_BYTES} bytes, too many to broadcast")
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}


def word_target(words: list[bytes], targets: int) -> np.ndarray:
    import xxhash

    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w) % targets for w in words), np.int64, len(words))


def chunks(batches: Iterator[pa.RecordBatch], pattern: str) -> Iterator[tuple[int, list[bytes], list[tuple[int | None, np.ndarray]]]]:
    """(chunk, its distinct words, [(doc_id, word numbers)]).

    The chunk's name is a hash of its texts: a chunk read again has its name again, and chunks of equal texts, which
    have equal words and answers, may share one.
    """
    import regex
    import xxhash

    find = regex.compile(pattern).findall
    number, rows, size, name = {}, [], 0, xxhash.xxh128()

    def close():
        return xxhash.xxh64_intdigest(f"{len(number)} {size} {name.hexdigest()}") >> 1, [w.encode() for w in number], rows

    for batch in batches:
        for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            raw = raw or b""
            if rows and size + len(raw) > CHUNK_BYTES:
                yield close()
                number, rows, size, name = {}, [], 0, xxhash.xxh128()
            found = find(raw.decode(errors="replace"))
            rows.append((doc_id, np.array([number.setdefault(w, len(number)) for w in found], np.int64)))
            size += len(raw)
            name.update(b"%d:" % len(raw))
            name.update(raw)
    if rows:
        yield close()


def encode_words(docs: DataFrame, ranks_path: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    """(answers, sequences): answers (chunk, target, ids), sequences (chunk, doc_id, words)."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(ranks_path))
    src = settled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), "bpe-texts")
    targets = max(LEAST_TARGETS, math.isqrt(estimated_bytes(src) // TARGET_BYTES))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for chunk, words, _ in chunks(batches, pattern):
            target = word_target(words, targets)
            order = np.argsort(target, kind="stable")
            present, starts = np.unique(target[order], return_index=True)
            out: list[tuple[int, bytes, bytes]] = []
            for t, own in zip(present.tolist(), np.split(order, starts[1:]), strict=True):
                mine = [words[i] for i in own.tolist()]
                out.append((t, pack_ints(np.fromiter(map(len, mine), np.int64, len(mine))), pack(b"".join(mine))))
            if out:
                t, lengths, body = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(t)), pa.array(t, pa.int32()), pa.array(lengths, pa.binary()), pa.array(body, pa.binary())], names=["chunk", "target", "lengths", "body"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        import zstandard

        one = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={}).encode_ordinary
        last, known = None, {}
        for batch in batches:
            out = []
            for chunk, target, lengths, body in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if target != last:
                    last, known = target, {}
                text, at, counts, ids = zstandard.ZstdDecompressor().decompress(body, max_output_size=1 << 31), 0, [], []
                for n in unpack_ints(lengths).tolist():
                    word = text[at : at + n]
                    at += n
                    if (got := known.get(word)) is None:
                        got = known[word] = one(word.decode())
                    counts.append(len(got))
                    ids += got
                out.append((chunk, target, pack_ints(np.array(counts)), pack_ints(np.array(ids))))
            if out:
                c, t, n, i = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(t, pa.int32()), pa.array(n, pa.binary()), pa.array(i, pa.binary())], names=["chunk", "target", "counts", "ids"])

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, words, rows in chunks(batches, pattern):
            head = pack_ints(word_target(words, targets))  # where each word's answer is to be found
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([-1], pa.int32()), pa.array([None], pa.int64()), pa.array([head], pa.binary())], names=["chunk", "target", "doc_id", "words"])
            for i in range(0, len(rows), 2000):
                ids, seqs = zip(*rows[i : i + 2000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(ids)), pa.array([targets] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array([pack_ints(s) for s in seqs], pa.binary())], names=["chunk", "target", "doc_id", "words"])

    asked = src.mapInArrow(ask, "chunk long, target int, lengths binary, body binary")
    answers = asked.repartition("target").sortWithinPartitions("target").mapInArrow(answer, "chunk long, target int, counts binary, ids binary")
    return answers, src.mapInArrow(sequences, "chunk long, target int, doc_id long, words binary")


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded) for each row of documents: the ids of the whole text, and the bytes that they stand for.

    Each distinct word of a chunk is decoded once, by the token-byte table, which is broadcast (its size is bounded by
    VOCABULARY_BYTES). Null text counts as empty; empty text has no ids; rows repeat as they do in the input; a null
    doc_id stays null; other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    answers, sequences = encode_words(docs, ranks_path, pattern)
    token_bytes = spark.sparkContext.broadcast({i: b for b, i in load_ranks(ranks_path).items()})
    schema = "doc_id long, ids array<int>, decoded binary"

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes.value
        chunk = head = words_of = None
        parts: dict[int, tuple[bytes, bytes]] = {}

        def resolve() -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
            """(ids of all words, where each word's begin, how many it has, bytes of each word)."""
            target = unpack_ints(head)
            order = np.argsort(target, kind="stable")
            at = np.searchsorted(target[order], np.arange(int(target.max(initial=-1)) + 2))
            counts, found = np.zeros(len(target), np.int64), []
            for t in sorted(parts):
                own, ns, ids = order[at[t] : at[t + 1]], unpack_ints(parts[t][0]), unpack_ints(parts[t][1])
                if len(own) != len(ns):
                    raise RuntimeError("a chunk's words changed between two reads of its input")
                counts[own] = ns
                found.append(ids)
            if not counts.all():
                raise RuntimeError("a chunk's words have no answer: its input changed between two reads")
            flat = np.concatenate([np.empty(0, np.int64), *found]).astype(np.int32)
            begins = np.empty(len(target), np.int64)
            ends = np.cumsum(counts[order])
            begins[order] = ends - counts[order]
            tokens = [table[i] for i in flat.tolist()]
            return flat, begins, counts, [b"".join(tokens[s : s + n]) for s, n in zip(begins.tolist(), counts.tolist(), strict=True)]

        def rows_of(out: list[tuple[int | None, np.ndarray, bytes]]) -> pa.RecordBatch:
            names, ids, decoded = zip(*out, strict=True)
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.ListArray.from_arrays(ends, np.concatenate(ids)), pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"])

        out, size = [], 0
        for batch in batches:
            for c, target, doc_id, words, n, i in zip(*(batch.column(x).to_pylist() for x in ("chunk", "target", "doc_id", "words", "counts", "ids")), strict=True):
                if c != chunk:
                    chunk, head, parts, words_of = c, None, {}, None
                if target < 0:
                    head = words
                elif words is None:
                    parts[target] = (n, i)
                else:
                    if words_of is None:
                        if head is None:
                            raise RuntimeError("a chunk's words are missing: its input changed between two reads")
                        words_of, parts = resolve(), {}
                    flat, begins, counts, raw = words_of
                    seq = unpack_ints(words)
                    each = counts[seq]
                    ids = flat[np.repeat(begins[seq] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
                    out.append((doc_id, ids, b"".join([raw[w] for w in seq.tolist()])))
                    size += ids.nbytes + len(out[-1][2])
                    if size > ROW_BYTES:
                        yield rows_of(out)
                        out, size = [], 0
        if out:
            yield rows_of(out)

    none = F.lit(None).cast("binary")
    both = answers.select("chunk", "target", F.lit(None).cast("long").alias("doc_id"), none.alias("words"), "counts", "ids")
    both = both.union(sequences.select("chunk", "target", "doc_id", "words", none, none))
    return both.repartition("chunk").sortWithinPartitions("chunk", "target").mapInArrow(assemble, schema)


def digests(rows: DataFrame, *more: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, more]) of (doc_id, ids, decoded)."""
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), *more)


def decode_ids(rows: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, decoded) of (doc_id, ids): a join of exploded ids with the token-byte table, put back by position."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(i, bytearray(b)) for b, i in load_ranks(ranks_path).items()], "id int, bytes binary")
    flat = rows.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", F.posexplode_outer("ids").alias("pos", "id"))
    joined = flat.join(F.broadcast(table), "id", "left").groupBy("row", "doc_id")
    parts = joined.agg(F.sort_array(F.collect_list(F.struct("pos", F.hex("bytes").alias("h")))).alias("p"))
    return parts.select("doc_id", F.unhex(F.array_join(F.col("p.h"), "")).alias("decoded"))
