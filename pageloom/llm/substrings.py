"""Substring dedup with suffix automata of reference documents.

1. Every document gives sparse fingerprints of its word sequence, chosen so that any window of WINDOW words holds one
   (winnowing: the least hash of GRAM words in the window). The first document of each repeated fingerprint is its
   reference.
2. Runs of windows whose fingerprint is repeated are cut out as segments and dealt out by reference document. For each
   reference a suffix automaton is built over its segments; the segments of all other documents are streamed through
   it, and the matching statistics (longest match ending at each word) give the windows that the reference has, all of
   which are earlier. The reference's own repeats come from the suffix links while it is built. References with many
   segments are sent to several tasks, with the segments shared out among them.
3. A window whose fingerprint is older than the window itself may still have its first occurrence in between. Such
   windows aren't in their reference at all, so they are compared among themselves, by their exact first document.

What is kept is exact: a word goes if, and only if, a window over it also starts earlier.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.session import discard, scratch_path, stored

WINDOW, GRAM = 20, 8
#: Marked fingerprints of one reference that one task takes; more are shared out.
SEGMENT_ROWS = 500
#: The session's limit on buckets, which is raised where there are more.
MAX_BUCKETS = "spark.sql.sources.bucketing.maxBuckets"
#: Stands for a null id: after all others.
LAST_ID = (1 << 63) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def rolled(tokens: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n tokens from each place (by doubling); shorter by n-1."""
    out, length = tokens, 1
    while length < n:
        step = min(length, n - length)
        out = _mix(out[: len(out) - step] * np.uint64(0x9E3779B97F4A7C15) + out[step:] + np.uint64(length))
        length += step
    return out


def _sliding(x: np.ndarray, n: int, ufunc) -> np.ndarray:
    out, length = x, 1
    while length < n:
        step = min(length, n - length)
        out = ufunc(out[: len(out) - step], out[step:])
        length += step
    return out


class Hasher(dict):
    """Word hashes: each word is hashed once and numbered, for as long as the table is small."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit, self.hashes = limit, np.empty(1 << 12, np.uint64)

    def __missing__(self, word: bytes) -> int:
        import xxhash

        n = self[word] = len(self)
        if n == len(self.hashes):
            self.hashes = np.r_[self.hashes, self.hashes]
        self.hashes[n] = xxhash.xxh64_intdigest(word)
        return n

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.hashes[numbers]


def window_prints(tokens: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint of each window, gram hashes, which of them are some window's fingerprint)."""
    grams = rolled(tokens, GRAM)
    least = _sliding(grams, window - GRAM + 1, np.minimum)
    pad = np.zeros(window - GRAM, np.uint64)
    return least, grams, _sliding(np.r_[pad, least, pad], window - GRAM + 1, np.maximum) == grams


class SuffixAutomaton:
    """Online automaton of numbered words. ``link length`` after each word is its longest suffix that was there before."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def extend(self, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        cur, p = len(nxt), self.last
        nxt.append({})
        link.append(0)
        length.append(length[p] + 1)
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self.last = cur
        return length[link[cur]]

    def matching(self, words: list[int]) -> list[int]:
        """Length of the longest suffix of each prefix of the words that occurs in the automaton's text."""
        nxt, link, length, state, size, out = self.next, self.link, self.length, 0, 0, []
        for c in words:
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            to = nxt[state].get(c)
            if to is None:
                size = 0
            else:
                state, size = to, size + 1
            out.append(size)
        return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of runs of true."""
    edges = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return edges[::2], edges[1::2] - edges[::2]


class Parts:
    """Rows of one id are parts of one document, in order of their text; their words lie 2^32 apart."""

    def __init__(self):
        self.last, self.part = None, 0

    def offset(self, d: int) -> int:
        self.part = self.part + 1 if d == self.last else 0
        self.last = d
        return self.part << 32


class SubstringDedup:
    """The steps over one table of documents, written to the shared folder once, in buckets of the id.

    Texts are dealt out by id once, one file for each bucket, and both joins by id read them where they are. There are
    as many buckets as the input has splits twice over, so a bucket doesn't grow with the input. ``close`` drops the table.
    """

    def __init__(self, docs: DataFrame, window: int = WINDOW):
        spark = docs.sparkSession
        self.window, self.spent = window, []
        self.path = scratch_path(spark, "substring-docs")
        self.name = self.path.rsplit("/", 1)[-1].replace("-", "_")
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * docs.rdd.getNumPartitions())
        if buckets > int(spark.conf.get(MAX_BUCKETS)):
            spark.conf.set(MAX_BUCKETS, buckets)
        others = [docs[c] for c in docs.columns if c != "text"]  # the text is stored once
        rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("d"), F.coalesce(F.col("text"), F.lit("")).alias("t"), F.struct(*others).alias("row"), F.col("text").isNull().alias("blank"))
        rows.repartition(buckets, "d").write.option("path", self.path).bucketBy(buckets, "d").saveAsTable(self.name)
        self.docs = spark.table(self.name)

    def close(self, result: DataFrame, label: str) -> DataFrame:
        """The result written and read again, without the table of documents."""
        spark = self.docs.sparkSession
        out = stored(result, label)
        spark.sql(f"DROP TABLE {self.name}")
        discard(spark, self.path)
        discard(spark, self.found)
        return out

    def prints(self) -> DataFrame:
        """(fp, d, n): fingerprints of each document."""
        window = self.window

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashed = Hasher()
            for batch in batches:
                fps, ds, ns = [], [], []
                for d, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    words = raw.split()
                    if len(words) < window:
                        continue
                    _, grams, chosen = window_prints(hashed(words), window)
                    found, n = np.unique(grams[chosen], return_counts=True)
                    fps.append(found.view(np.int64))
                    ds.append(np.full(len(found), d, np.int64))
                    ns.append(n)
                if fps:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(fps)), pa.array(np.concatenate(ds)), pa.array(np.concatenate(ns).astype(np.int32))], names=["fp", "d", "n"])

        return self.docs.select("d", "t").mapInArrow(run, "fp long, d long, n int")

    def marks(self) -> DataFrame:
        """(d, fps, refs, shares): repeated fingerprints of each document with their first document."""
        prints = stored(self.prints(), "prints", self.spent)
        repeated = prints.groupBy("fp").agg(F.sum("n").alias("n"), F.min("d").alias("ref")).where("n > 1").select("fp", "ref")
        found = stored(prints.select("fp", "d").join(repeated, "fp").select("d", "fp", "ref"), "marks", self.spent)
        shares = found.groupBy("ref").count().where(F.col("count") > SEGMENT_ROWS).select("ref", (F.col("count") / SEGMENT_ROWS).cast("int").alias("more"))
        shares = stored(shares, "shares", self.spent)  # so that the join below stands alone and a hot reference can be split
        found = found.join(shares, "ref", "left").select("d", "fp", "ref", (F.coalesce("more", F.lit(0)) + 1).alias("share"))
        return found.groupBy("d").agg(F.collect_list(F.struct("fp", "ref", "share")).alias("marks"))

    def segments(self, marks: DataFrame) -> DataFrame:
        """(ref, share, role, d, start, words): runs of windows of one reference; role 0: the reference's own."""
        window = self.window

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashed, parts = Hasher(), Parts()
            for batch in batches:
                out = []
                for d, raw, marks in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    base, words = parts.offset(d), raw.split()
                    if len(words) < window or not marks:
                        continue
                    fps = np.array([m["fp"] for m in marks], np.int64)
                    order = np.argsort(fps)
                    fps, refs, shares = fps[order], np.array([m["ref"] for m in marks], np.int64)[order], np.array([m["share"] for m in marks], np.int64)[order]
                    least = window_prints(hashed(words), window)[0].view(np.int64)
                    at = np.minimum(np.searchsorted(fps, least), len(fps) - 1)
                    ref, marked = refs[at], fps[at] == least
                    cuts = np.flatnonzero(np.diff(np.r_[False, marked].astype(np.int8)) | np.r_[True, ref[1:] != ref[:-1]])
                    for s, e in zip(cuts, np.r_[cuts[1:], len(least)], strict=True):
                        if not marked[s]:
                            continue
                        r, k = int(ref[s]), int(shares[at[s]])
                        own = b" ".join(words[s : e + window - 1])
                        targets = range(k) if r == d else [hash((d * 2654435761) & 0xFFFFFFFF) % k]
                        out += [(r, x, int(r != d), d, base + int(s), own) for x in targets]
                if out:
                    cols = list(zip(*out, strict=True))
                    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["ref", "share", "role", "d", "start", "words"])

        joined = self.docs.select("d", "t").join(marks.hint("shuffle_hash"), "d", "left").sortWithinPartitions("d", "t").select("d", "t", "marks")
        return joined.mapInArrow(run, "ref long, share int, role int, d long, start long, words binary")

    def matched(self, segments: DataFrame) -> DataFrame:
        """(d, start, n, h1, h2): runs of windows that occur earlier (n > 0), and windows that their reference lacks (n = 0)."""
        window = self.window

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import xxhash

            key, sam, number, seen, last = None, SuffixAutomaton(), {}, set(), None
            for batch in batches:
                out = []
                for ref, share, role, d, start, raw in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                    if (ref, share) != key:
                        key, sam, number, last = (ref, share), SuffixAutomaton(), {}, None
                    words = raw.split()
                    if role == 0:
                        sam.extend(-1 - len(sam.next))  # parts of the text that aren't next to each other don't match across
                        sizes = [sam.extend(number.setdefault(w, len(number))) for w in words]
                    else:
                        sizes = sam.matching([number.get(w, -1) for w in words])
                    hit = np.array(sizes[window - 1 :]) >= window
                    if role == 0 and share:
                        continue
                    if role and not hit.all():
                        if last != d:
                            last, seen = d, set()
                        for i in np.flatnonzero(~hit).tolist():
                            h = xxhash.xxh128_digest(b" ".join(words[i : i + window]))
                            if h in seen:
                                hit[i] = True
                            else:
                                seen.add(h)
                                out.append((d, start + i, 0, int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)))
                    out += [(d, start + int(s), int(n), 0, 0) for s, n in zip(*_runs(hit), strict=True)]
                if out:
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["d", "start", "n", "h1", "h2"])

        dealt = segments.repartition("ref", "share").sortWithinPartitions("ref", "share", "role", "d", "start")
        return dealt.mapInArrow(run, "d long, start long, n long, h1 long, h2 long")

    def removed(self) -> DataFrame:
        """(d, starts, counts): runs of windows to remove, for each document that has some."""
        made: list[str] = []
        found = stored(self.matched(self.segments(self.marks())), "matched", made)
        self.found = made[0]
        while self.spent:
            discard(self.docs.sparkSession, self.spent.pop())  # only what has been read for good
        rest = found.where("n = 0").select("d", "start", "h1", "h2")
        first = rest.groupBy("h1", "h2").agg(F.min("d").alias("first"), F.count("*").alias("m")).where("m > 1").drop("m")
        later = rest.join(first, ["h1", "h2"]).where("d > first").select("d", "start", F.lit(1).cast("long").alias("n"))
        runs = found.where("n > 0").select("d", "start", "n").union(later)
        return runs.groupBy("d").agg(F.collect_list(F.struct("start", "n")).alias("runs"))

    def apply(self, schema, make) -> DataFrame:
        """make(d, row, text, words, keep) gives an output row for each document; keep: which words stay (None: all)."""
        window = self.window

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            arrow, parts = to_arrow_schema(schema), Parts()
            for batch in batches:
                out = []
                for d, raw, row, blank, runs in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), *(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                    base, words, keep = parts.offset(d), raw.split(), None
                    own = [(r["start"] - base, r["n"]) for r in runs or () if base <= r["start"] < base + (1 << 32)]
                    if own:
                        delta = np.zeros(len(words) + 1, np.int64)
                        for s, n in own:
                            delta[s] += 1
                            delta[s + n + window - 1] -= 1
                        keep = np.cumsum(delta[:-1]) == 0
                    out.append(make(d, row, None if blank else raw, words, keep))
                if out:
                    cols = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        joined = self.docs.join(self.removed().hint("shuffle_hash"), "d", "left").sortWithinPartitions("d", "t").select("d", "t", "row", "blank", "runs")
        return joined.mapInArrow(run, schema)


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of documents.

    Null and empty texts have no words. Rows of one doc_id are parts of one document, in order of their text, so of
    repeated rows the first keeps its words; null ids count as one id after all others. Other columns are ignored.
    """
    from pyspark.sql import types as T

    fields = [("doc_id", T.LongType()), ("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType())]

    def make(d, row, text, words, keep):
        kept = words if keep is None else [w for w, k in zip(words, keep.tolist(), strict=True) if k]
        return None if d == LAST_ID else d, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

    steps = SubstringDedup(docs.select("doc_id", "text"), window)
    return steps.close(steps.apply(T.StructType([T.StructField(n, t) for n, t in fields]), make), "substring-result")


def drop_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of documents with repeated words taken out; texts that lose none stay as they are.

    A text that loses words is its kept words joined by one space, and n_chars, where there is one, counts it anew.
    """
    names = docs.columns

    def make(d, row, text, words, keep):
        row = {**row, "text": None if text is None else text.decode(errors="replace")}
        if keep is not None and not keep.all():
            row["text"] = b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k]).decode(errors="replace")
            if "n_chars" in row:
                row["n_chars"] = len(row["text"])
        return tuple(row[c] for c in names)

    steps = SubstringDedup(docs, window)
    return steps.close(steps.apply(docs.schema, make), "substring-result")
