"""Phrase collocation mining with exact counts of all n-grams up to five words.

Texts are cut into pieces, and equal pieces of a language become one row with a multiplicity, so that copies and common
lines are counted once and weighted. Every place of a piece gives one window, the words from there on (five at most).
Windows are dealt by hash of their first two words, so that one hash bucket holds all windows that begin with a pair; a
bucket is counted in a duckdb file of its own, which spills what its memory limit can't hold, level by level: only
windows whose first k words are frequent are counted at k + 1. Pairs (and longer beginnings) that hold more rows than
half a bucket are found in a bounded sample first; their windows are dealt by one more word each time, and by a salt in
the end, and what is counted of the hot beginnings themselves is summed over buckets. Single words are summed in each
chunk before they are dealt. So no word, pair or line fills a bucket, and nothing is left out.

Windows travel as blobs, one for each (chunk, bucket) that has any: the distinct words and their numbers. What the parts
of a cut phrase count is asked for by lookup requests, which are shuffled to the part's count and back to the phrase.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import fold_ascii, pack_ints, unpack_ints
from pageloom.session import stored

LONGEST = 5
#: Words after which a chunk of pieces is dealt out; a longer piece is a chunk of its own.
CHUNK_WORDS = 1 << 19
#: Bytes of text for each hash bucket, and the least number of buckets.
BUCKET_BYTES, LEAST_BUCKETS = 8 << 20, 64
#: Distinct texts (by hash, on average) in which hot beginnings are looked for, for each bucket; that only says where windows are counted.
SAMPLE_TEXTS = 64
#: Languages up to which their totals are broadcast; more are met by a shuffle.
MOST_LANGS = 100_000
#: Parts in which a language's phrases are ranked before the whole; each hands on its first ones only.
RANK_PARTS = 64
#: Memory limit of one bucket's duckdb; above it, duckdb spills to the task's own folder, which goes with the task.
DUCKDB_MEMORY = "300MB"


def pieces_of(docs: DataFrame) -> DataFrame:
    """(lang, piece) of every piece with a word: small letters, words joined by one space."""
    text = fold_ascii(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(text, r"[.,;:!?\x0A-\x0D]")).alias("p"))
    return rows.select("lang", F.trim(F.regexp_replace("p", r"[\x20\x09]+", " ")).alias("piece")).where("piece <> ''")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def prefix_hashes(windows: np.ndarray, hashes: np.ndarray, lang: np.ndarray) -> list[np.ndarray]:
    """Hashes of the first 1, 2, ... words of each window under its language; where words end, they stay."""
    out, h = [], _mix(lang)
    for k in range(windows.shape[1]):
        w = windows[:, k]
        h = np.where(w >= 0, _mix(h * np.uint64(31) + hashes[w]), h)
        out.append(h)
    return out


def read_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """(languages, words, windows of word numbers with -1 past the end, language of each, multiplicity of each)."""

    def close():
        n = np.array(lengths, np.int64)
        ends = np.repeat(np.cumsum(n), n)
        flat = np.concatenate([np.array(sequence, np.int32), np.full(LONGEST, -1, np.int32)])
        at = np.arange(len(sequence))
        windows = np.stack([np.where(at + k < ends, flat[at + k], -1) for k in range(LONGEST)], axis=1)
        return list(langs), list(number), windows, np.repeat(np.array(of, np.int64), n), np.repeat(np.array(times, np.int64), n)

    langs, number, sequence, lengths, of, times = {}, {}, [], [], [], []
    for batch in batches:
        for lang, piece, m in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            words = piece.split(" ")
            if sequence and len(sequence) + len(words) > CHUNK_WORDS:
                yield close()
                langs, number, sequence, lengths, of, times = {}, {}, [], [], [], []
            sequence += [number.setdefault(w, len(number)) for w in words]
            lengths.append(len(words))
            of.append(langs.setdefault(lang, len(langs)))
            times.append(m)
    if sequence:
        yield close()


def word_hashes(words: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w.encode()) for w in words], np.uint64)


def hot_beginnings(docs: DataFrame, buckets: int, rows: int) -> np.ndarray:
    """Sorted hashes of the beginnings (2 to 5 words) with more than half a bucket's share of a sample's windows.

    The sample is texts by hash, SAMPLE_TEXTS for each bucket, so the list has at most two entries for each length and bucket.
    """
    share = min(1.0, SAMPLE_TEXTS * buckets / max(1, rows))
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)))
    pieces = pieces_of(sample).groupBy("lang", "piece").agg(F.lit(1).cast("long").alias("m"))

    def beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, words, windows, lang, _ in read_chunks(batches):
            keys = prefix_hashes(windows, word_hashes(words), word_hashes(langs)[lang])
            for k in range(1, LONGEST):
                full = windows[:, k] >= 0
                found, n = np.unique(keys[k][full], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n), pa.array(np.full(len(n), k, np.int32))], names=["key", "n", "k"])

    rows = pieces.mapInArrow(beginnings, "key long, n long, k int").groupBy("key", "k").agg(F.sum("n").alias("n"))
    rows = stored(rows, "collocation-sample")
    total = rows.where("k = 1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = rows.where(F.col("n") * 2 * buckets > total).select("key").distinct().collect()  # at most 8 for each bucket
    return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))


def gram_counts(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(counts, totals): counts (lang, k, phrase, f) of all phrases with f >= least, totals (lang, n)."""
    spark = docs.sparkSession
    size, rows = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    buckets = max(LEAST_BUCKETS, size // BUCKET_BYTES)
    hot = spark.sparkContext.broadcast(hot_beginnings(docs, buckets, rows))
    pieces = pieces_of(docs).groupBy("lang", "piece").agg(F.count("*").alias("m"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack, known = zstandard.ZstdCompressor(level=3).compress, hot.value
        for langs, words, windows, lang, times in read_chunks(batches):
            hashes, lang_hashes = word_hashes(words), word_hashes(langs)
            # Single words: one row for each language and word of the chunk.
            single, place = np.unique(lang * len(words) + windows[:, 0], return_inverse=True)
            alone = np.full((len(single), LONGEST), -1, np.int32)
            alone[:, 0] = single % len(words)
            sums = np.zeros(len(single), np.int64)
            np.add.at(sums, place, times)
            more = windows[:, 1] >= 0
            rows = np.concatenate([alone, windows[more]])
            lang, times = np.concatenate([single // len(words), lang[more]]), np.concatenate([sums, times[more]])
            keys = prefix_hashes(rows, hashes, lang_hashes[lang])
            depth, key = np.where(np.arange(len(rows)) < len(single), 1, 2), np.where(np.arange(len(rows)) < len(single), keys[0], keys[1])
            for k in range(1, LONGEST) if len(known) else ():  # while the beginning is hot, one more word; after the last, a salt
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                go = (depth == k + 1) & (known[at] == key)
                depth = np.where(go, k + 2, depth)
                longer = keys[k + 1] if k + 1 < LONGEST else _mix(key + np.arange(len(key), dtype=np.uint64))
                key = np.where(go, longer, key)
            bucket = (_mix(key) % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
            order = np.argsort(bucket, kind="stable")
            present, starts = np.unique(bucket[order], return_index=True)
            number, out = np.empty(len(words) + 1, np.int64), []  # -1 is the last place
            for b, own in zip(present.tolist(), np.split(order, starts[1:]), strict=True):
                flat = rows[own].T.reshape(-1)
                number[flat] = np.arange(len(flat))
                used = flat[(number[flat] == np.arange(len(flat))) & (flat >= 0)]  # each word once
                number[used] = np.arange(1, len(used) + 1)
                number[-1] = 0
                names = " ".join([words[i] for i in used.tolist()])
                out.append((b, langs, pack(names.encode()), pack_ints(number[flat]), pack_ints(lang[own]), pack_ints(times[own], 8), pack_ints(depth[own], 1)))
            for i in range(0, len(out), 64):
                b, g, *blobs = zip(*out[i : i + 64], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(g, pa.list_(pa.string())), *[pa.array(x, pa.binary()) for x in blobs]], names=["bucket", "langs", "words", "rows", "lang", "times", "depth"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, buckets = None, Buckets(least)
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if row[0] != last:
                    yield from buckets.close()
                last = row[0]
                buckets.add(*row[1:])
        yield from buckets.close()
        buckets.end()

    blobs = pieces.mapInArrow(deal, "bucket long, langs array<string>, words binary, rows binary, lang binary, times binary, depth binary")
    found = blobs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, "lang string, k int, phrase string, f long")
    found = stored(found, "collocation-counts")
    counts = found.where("k > 0").groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return stored(counts, "collocation-grams"), found.where("k = 0").groupBy("lang").agg(F.sum("f").alias("n"))


class Buckets:
    """The hash buckets of a task, one after the other: windows by numbers of the bucket's words, counted in the task's duckdb.

    What its memory limit can't hold is spilled to a folder of the task (as Spark spills a sort), which is gone with the task.
    """

    def __init__(self, least: int):
        import duckdb

        self.least, self.folder = least, tempfile.TemporaryDirectory()
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": self.folder.name, "preserve_insertion_order": False})
        self.fresh()

    def fresh(self) -> None:
        self.words, self.langs, self.waiting, self.rows = {}, {}, [], 0
        self.db.execute(f"CREATE OR REPLACE TABLE t (lang INT, {', '.join(f'w{k} INT' for k in range(1, LONGEST + 1))}, m BIGINT, d TINYINT)")

    def end(self) -> None:
        self.db.close()
        self.folder.cleanup()

    def add(self, langs: list[str], words: bytes, rows: bytes, lang: bytes, times: bytes, depth: bytes) -> None:
        import zstandard

        names = zstandard.ZstdDecompressor().decompress(words, max_output_size=1 << 31).decode().split(" ")
        to_bucket = np.array([-1, *[self.words.setdefault(w, len(self.words)) for w in names]], np.int32)
        ids = to_bucket[unpack_ints(rows)].reshape(LONGEST, -1)
        number = np.array([self.langs.setdefault(x, len(self.langs)) for x in langs], np.int32)[unpack_ints(lang)]
        self.waiting.append([number, *ids, unpack_ints(times, 8), unpack_ints(depth, 1).astype(np.int8)])
        self.rows += ids.shape[1]
        if self.rows > 1 << 19:
            self.flush()

    def flush(self) -> None:
        if self.waiting:
            columns = [np.concatenate(c) for c in zip(*self.waiting, strict=True)]
            batch = pa.Table.from_arrays([pa.array(c) for c in columns], names=["lang", *[f"w{k}" for k in range(1, LONGEST + 1)], "m", "d"])  # noqa: F841
            self.db.execute("INSERT INTO t SELECT * FROM batch")
            self.waiting, self.rows = [], 0

    def close(self) -> Iterator[pa.RecordBatch]:
        """Counts of the bucket: 0 words is the language's total, and hot beginnings are counted in part."""
        self.flush()
        if not self.words:
            return
        words, langs = list(self.words), list(self.langs)
        for batch in self.db.sql("SELECT lang, CAST(sum(m) AS BIGINT) AS f FROM t WHERE d = 1 GROUP BY lang").to_arrow_reader(50_000):
            yield self.named(batch, 0, words, langs)
        where = "d = 1"
        for k in range(1, LONGEST + 1):
            keys = ", ".join(["lang", *[f"w{i}" for i in range(1, k + 1)]])
            # A beginning that windows here are dealt beyond is counted in other buckets too, so it is kept however rare it is here.
            self.db.execute(f"CREATE OR REPLACE TABLE g AS SELECT {keys}, CAST(sum(m) AS BIGINT) AS f FROM t WHERE {where} GROUP BY {keys} HAVING sum(m) >= {self.least} OR max(d) > {k}")
            found = 0
            for batch in self.db.sql("SELECT * FROM g").to_arrow_reader(50_000):
                found += len(batch)
                yield self.named(batch, k, words, langs)
            if k > 1 and not found:
                break  # no longer phrase is frequent
            if k > 1:  # windows whose beginning isn't frequent are of no more use
                self.db.execute(f"CREATE OR REPLACE TABLE t AS SELECT * FROM t WHERE w{min(k + 1, LONGEST)} >= 0 AND ({keys}) IN (SELECT ({keys}) FROM g)")
            where = f"d >= 2 AND w{min(k + 1, LONGEST)} >= 0"
        self.fresh()

    @staticmethod
    def named(batch: pa.RecordBatch, k: int, words: list[str], langs: list[str]) -> pa.RecordBatch:
        columns = [batch.column(i).to_pylist() for i in range(1, k + 1)]
        phrases = [" ".join([words[i] for i in row]) for row in zip(*columns, strict=True)] if k else [""] * len(batch)
        return pa.RecordBatch.from_arrays(
            [pa.array([langs[i] for i in batch.column(0).to_pylist()], pa.string()), pa.array(np.full(len(batch), k, np.int32)), pa.array(phrases, pa.string()), batch.column(k + 1)],
            names=["lang", "k", "phrase", "f"],
        )


def collocations(docs: DataFrame, least: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to 5 words.

    A phrase counts where it has ``least`` occurrences at least and no longer phrase that holds it has as many. Its score
    is that of its lowest-scoring cut (ties: the shortest first part), in exact whole numbers of up to 38 digits. Null
    and empty texts have no pieces; a null language is ``und``; repeated rows count as often as they are there; other
    columns, doc_id among them, are ignored.
    """
    counts, totals = gram_counts(docs, least)
    candidates = counts.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    # A longer phrase holds its two parts that lack one end; if a still longer one is as frequent, so is one between.
    ends = F.array(F.array_join(F.expr("slice(w, 1, k - 1)"), " "), F.array_join(F.expr("slice(w, 2, k - 1)"), " "))
    inside = candidates.where("k > 2").select("lang", F.explode(ends).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("within"))
    kept = candidates.join(inside, ["lang", "phrase"], "left").where("within is null or within < a").drop("within")

    cuts = kept.select("lang", "phrase", "a", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"), "w", "k")
    first, rest = F.array_join(F.expr("slice(w, 1, cut)"), " "), F.array_join(F.expr("slice(w, cut + 1, k - cut)"), " ")
    asks = F.explode(F.array(F.struct(F.lit("l").alias("side"), first.alias("part")), F.struct(F.lit("r").alias("side"), rest.alias("part"))))
    requests = cuts.select("lang", "phrase", "a", "cut", asks.alias("ask")).select("lang", "phrase", "a", "cut", "ask.side", "ask.part")
    parts = counts.select("lang", F.col("phrase").alias("part"), "f")
    answers = stored(requests.join(parts, ["lang", "part"]), "collocation-answers")  # a join that stands alone: a part that many phrases ask for can be split

    side = lambda s: F.max(F.when(F.col("side") == s, F.col("f")))
    scored = answers.groupBy("lang", "phrase", "a", "cut").agg(side("l").alias("l"), side("r").alias("r")).join(F.broadcast(totals) if totals.count() <= MOST_LANGS else totals, "lang")
    big = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    score = F.call_function("div", F.lit(1000).cast("decimal(5,0)") * big("a", 14) * big("n", 18), big("l", 18) * big("r", 18))
    best = scored.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = best.select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score").withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    for by in (["lang", "_part"], ["lang"]):  # what isn't among the first of its part isn't among the first of all
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
