"""N-gram language model in Elias-Fano tries, dealt out by context.

Documents are read in chunks. A chunk sends each target its distinct words and word pairs with their counts in the
training documents, and the target merges what all chunks sent. When all have counted, each target builds a trie
(contexts with monotone pointers into their sorted successors, all in Elias-Fano code under sampled counts, with the
quantised probabilities of pairs and backoff weights of contexts) in a file of its task that is mapped into memory, and
answers every chunk's pairs by successor search within the context's range. Answers and the chunk's word sequences
meet again by chunk, where each document is scored. Pairs go to a target by context; those of a frequent context by
context and a part of its successors, the more parts the more frequent it is. Each distinct pair is sent once for a
chunk, so a frequent pair is no burden.

The model is a bigram with absolute discounting: three discounts (of counts 1, 2 and more) from the counts of counts of
all targets together, and a frequent context's weight from all its parts, so that neither the file layout nor the
number of targets matters. The discounted probability of a pair and the backoff weight of its context come from the
trie; the weight goes to a discounted unigram, whose counts are exact (the base needs them), and this is interpolated
with a uniform share for unseen words. Words are named by 64-bit hashes, and successors within a context by 40 bits.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import crc_mod, fold_ascii, pack_ints, unpack_ints
from pageloom.session import cut, let_go, settled

CHUNK_BYTES = 10 << 20
#: Hash names of the end of a text and of what comes before its first word (no word is empty or has a space).
END_NAME, BEGIN_NAME = b"", b" "
LOW40 = (1 << 40) - 1
#: Words with this share of those of a bounded sample have their successors spread over more targets, the more the greater
#: the share; that only says where pairs are counted.
HOT_SHARE, HOT_SAMPLE, MOST_SPREAD = 0.001, 2000, 1 << 16
#: Decades from which counts, and probabilities, are quantised.
COUNTS_FROM, PROBABILITIES_FROM = -3, -16
#: Name of the row with a target's own pairs, before those of its chunks.
OWN = -1


class Bits:
    """A packed bit vector with sampled counts: places of the k-th one or zero without unpacking."""

    BLOCK = 8  # words of 64 bits for each sample

    def __init__(self, packed: np.ndarray):
        """packed: bytes, little end first, in whole blocks (see ``padded``); may lie in a memory map."""
        self.words = packed.view("<u8")
        ones = np.bitwise_count(self.words).reshape(-1, self.BLOCK).sum(1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])
        self.zeros_before = np.arange(len(self.before)) * (64 * self.BLOCK) - self.before

    @classmethod
    def padded(cls, bits: np.ndarray) -> np.ndarray:
        """Packed bytes of 0/1 values, with zeros up to a whole block."""
        packed = np.packbits(bits, bitorder="little")
        step = 8 * cls.BLOCK
        return np.concatenate([packed, np.zeros(-len(packed) % step or (0 if len(packed) else step), np.uint8)])

    def select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Places of the k-th (from 0) ones or zeros."""
        before = self.before if one else self.zeros_before
        block = np.searchsorted(before, k, side="right") - 1
        rest = (k - before[block]).astype(np.int64)
        own = self.words[(block * self.BLOCK)[:, None] + np.arange(self.BLOCK)]
        own = own if one else ~own
        upto = np.cumsum(np.bitwise_count(own), axis=1, dtype=np.int64)
        word = np.minimum((upto <= rest[:, None]).sum(1), self.BLOCK - 1)
        row = np.arange(len(k))
        w = own[row, word]
        rest -= np.where(word > 0, upto[row, word - 1], 0)
        at = np.zeros(len(k), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            n = np.bitwise_count((w >> at.astype(np.uint64)) & np.uint64((1 << step) - 1)).astype(np.int64)
            on = rest >= n
            rest, at = rest - n * on, at + step * on
        return (block * self.BLOCK + word) * 64 + at


class EliasFano:
    """A non-decreasing sequence in two parts: packed low bits, and high parts in unary under sampled counts."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.l, self.low, self.high = n, low_bits, low, Bits(high)
        self.tops = int(self.high.zeros_before[-1])

    @staticmethod
    def parts(values: np.ndarray, universe: int) -> tuple[int, np.ndarray, np.ndarray]:
        n = len(values)
        low_bits = min(56, max(0, int(universe // max(n, 1)).bit_length() - 1))
        packed = [np.empty(0, np.uint8)]
        for s in range(0, n if low_bits else 0, 1 << 16):  # a multiple of 8 values fills whole bytes
            low = values[s : s + (1 << 16)] & ((1 << low_bits) - 1)
            packed.append(np.packbits(((low[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8).reshape(-1), bitorder="little"))
        up = values >> low_bits
        unary = np.zeros(n + (int(up[-1]) if n else 0) + 2, np.uint8)
        unary[up + np.arange(n)] = 1
        return low_bits, np.concatenate([*packed, np.zeros(8, np.uint8)]), Bits.padded(unary)

    def get(self, i: np.ndarray) -> np.ndarray:
        out = (self.high.select(i, True) - i) << self.l
        if self.l:
            at = i * self.l
            words = self.low[(at >> 3)[:, None] + np.arange(8)].view("<u8").reshape(-1)
            out = out | ((words >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.l) - 1)).astype(np.int64)
        return out

    def find(self, begin: np.ndarray, end: np.ndarray, x: np.ndarray) -> np.ndarray:
        """First index in [begin, end) whose value is x or more; the unary part narrows the range first."""
        h = np.minimum(x >> self.l, self.tops - 1)
        lo = np.where(h > 0, self.high.select(np.maximum(h - 1, 0), False) - np.maximum(h - 1, 0), 0)
        hi = np.minimum(self.high.select(h, False) - h, self.n)
        lo, hi = np.clip(lo, begin, end), np.clip(hi, begin, end)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.get(mid) < x[open_]
            lo[open_[less]], hi[open_[~less]] = mid[less] + 1, mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        return lo

    def size(self) -> int:
        """Bytes held: both parts and the sampled counts."""
        return self.low.nbytes + self.high.words.nbytes + self.high.before.nbytes + self.high.zeros_before.nbytes


class Trie:
    """Contexts and their successors of one target: two levels in one file that is mapped into memory.

    Level one has the contexts' names with the codes of their backoff weights; monotone pointers lead to level two, whose
    successors are sorted within each context, with the codes of the pairs' values. All sequences are in Elias-Fano code,
    and nothing is unpacked. The file lies without a name in the task's own temporary folder and goes with the map.
    """

    SLICE = 1 << 18

    def __init__(self, contexts: np.ndarray, ctx: np.ndarray, successors: np.ndarray, values: np.ndarray, weights: np.ndarray | None = None, low: int = COUNTS_FROM):
        """contexts: sorted 63-bit names; ctx: the context's number for each pair, sorted with successors; values of pairs and weights
        of contexts (none given: none) are quantised from 10 ** low."""
        begins = np.searchsorted(ctx, np.arange(len(contexts) + 1))
        made = [EliasFano.parts(contexts, (1 << 63) - 1), EliasFano.parts(begins, len(ctx) + 1), EliasFano.parts((ctx << 40) | successors, max(1, len(contexts)) << 40)]
        parts = [x for _, bits, high in made for x in (high, bits)]
        parts += [quantise(x, low).view(np.uint8) for x in (values, np.empty(0) if weights is None else weights)]
        with tempfile.TemporaryFile() as file:
            for p in parts:
                file.write(p)
                file.write(bytes(-len(p) % 64))  # whole words for each part
            file.flush()
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        views, at = [], 0
        for p in parts:
            views.append(np.frombuffer(self.map, np.uint8, len(p), at))
            at += len(p) + -len(p) % 64
        lengths = [len(contexts), len(begins), len(ctx)]
        self.contexts, self.pointers, self.level = (EliasFano(n, bits, views[2 * i + 1], views[2 * i]) for i, (n, (bits, _, _)) in enumerate(zip(lengths, made, strict=True)))
        self.codes, self.weights = views[-2].view(np.uint16), views[-1].view(np.uint16)

    def number(self, names: np.ndarray) -> np.ndarray:
        """The numbers of contexts that are all there, by level one."""
        zero = np.zeros(len(names), np.int64)
        return self.contexts.find(zero, zero + self.contexts.n, names)

    def lookup(self, ctx: np.ndarray, successors: np.ndarray) -> np.ndarray:
        """Code of each (context's number, successor), searched for within the context's range; 0 where the pair isn't there."""
        out = np.zeros(len(ctx), np.int64)
        for s in range(0, len(ctx) if self.level.n else 0, self.SLICE):
            c, x = ctx[s : s + self.SLICE], (ctx[s : s + self.SLICE] << 40) | successors[s : s + self.SLICE]
            begin, end = self.pointers.get(c), self.pointers.get(c + 1)
            at = self.level.find(begin, end, x)
            ok = np.flatnonzero(at < end)
            ok = ok[self.level.get(at[ok]) == x[ok]]
            out[s + ok] = self.codes[at[ok]]
        return out

    def size(self) -> int:
        return self.contexts.size() + self.pointers.size() + self.level.size() + self.codes.nbytes + self.weights.nbytes


def quantise(mass: np.ndarray, low: int = COUNTS_FROM) -> np.ndarray:
    """Codes of positive values on a grid of 1/4000 decade from 10 ** low; 0 is kept for none."""
    return np.where(mass > 0, 1 + np.round((np.log10(np.maximum(mass, 10.0**low)) - low) * 4000), 0).clip(0, 65535).astype(np.uint16)


def dequantise(code: np.ndarray, low: int = COUNTS_FROM) -> np.ndarray:
    return np.where(code > 0, 10.0 ** ((code - 1) / 4000 + low), 0.0)


def discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """Discounts of counts 1, 2 and 3 or more (index 0: none) from counts of counts."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, np.clip(d[0], 0.1, 0.97), np.clip(d[1], 0.2, 1.9), np.clip(d[2], 0.3, 2.8)])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def masses(contexts: int, ctx: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(count of each context, how many of its successors are seen once, twice, more often) of pairs' counts."""
    seen = counts > 0
    kinds = np.bincount(ctx[seen] * 3 + np.minimum(counts[seen], 3) - 1, minlength=3 * contexts).reshape(-1, 3)
    return np.bincount(ctx, counts, contexts).astype(np.int64), kinds


def steps(numbers: np.ndarray) -> np.ndarray:
    """Non-decreasing numbers as what each is more than the one before."""
    return np.diff(numbers, prepend=0)


class Chunk:
    """Word hashes, the sequence of word numbers of all documents, and the order in which targets are asked."""

    def __init__(self, hashes: np.ndarray, sequence: np.ndarray, lengths: np.ndarray, targets: int, hot: tuple[np.ndarray, np.ndarray]):
        self.hashes, self.sequence, self.lengths = hashes, sequence, lengths
        starts = np.cumsum(lengths) - lengths
        before = np.r_[0, sequence[:-1]]
        before[starts] = 1  # numbers 0 and 1 are the end and the begin
        pairs, self.pair_of = np.unique((before << 32) | sequence, return_inverse=True)
        self.left, self.right = pairs >> 32, pairs & 0xFFFFFFFF
        self.h2 = (hashes[self.right] & np.uint64(LOW40)).astype(np.int64)
        spread = np.ones(len(hashes), np.int64)  # parts of each word's successors, a power of two
        if len(hot[0]):
            place = np.minimum(np.searchsorted(hot[0], hashes), len(hot[0]) - 1)
            spread = np.where(hot[0][place] == hashes, hot[1][place], 1)
        wide = np.flatnonzero(spread[self.left] > 1)
        parts, part_of = np.unique((self.left[wide] << 16) | (self.h2[wide] & (spread[self.left[wide]] - 1)), return_inverse=True)
        context = self.left.copy()  # words, and after them the parts of spread ones
        context[wide] = len(hashes) + part_of
        h1 = np.r_[hashes, hashes[parts >> 16]]
        part = np.r_[np.zeros(len(hashes), np.uint64), (parts & 0xFFFF).astype(np.uint64)]
        t = (_mix(h1 + _mix(part + np.uint64(7))) % np.uint64(targets)).astype(np.int64)
        order = np.lexsort((h1, t))
        rank = np.empty(len(order), np.int64)  # parts that meet in one target have one rank
        rank[order] = np.cumsum(np.r_[False, (np.diff(t[order]) != 0) | (h1[order][1:] != h1[order][:-1])])
        rank, t = rank[context], t[context]
        self.pair_order = np.argsort((rank << 40) | self.h2) if len(order) < 1 << 23 else np.lexsort((self.h2, rank))
        self.pair_cuts = np.searchsorted(t[self.pair_order], np.arange(targets + 1))
        w = (_mix(hashes) % np.uint64(targets)).astype(np.int64)
        self.word_order = np.lexsort((hashes, w))
        self.word_cuts = np.searchsorted(w[self.word_order], np.arange(targets + 1))

    def present(self) -> list[int]:
        """The targets that the chunk has words or pairs for: never more than it has of these."""
        return np.flatnonzero((np.diff(self.pair_cuts) > 0) | (np.diff(self.word_cuts) > 0)).tolist()

    def of(self, target: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(its words, its pairs, where a new context begins among the pairs)."""
        pairs = self.pair_order[self.pair_cuts[target] : self.pair_cuts[target + 1]]
        left = self.left[pairs]
        return self.word_order[self.word_cuts[target] : self.word_cuts[target + 1]], pairs, np.flatnonzero(np.r_[True, left[1:] != left[:-1]][: len(left)])


def read_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, list[tuple[int | None, bool, np.ndarray]]]]:
    """(name, word hashes, [(doc_id, held_out, word numbers with the end)]); the name is a hash of the texts and ids."""
    import xxhash

    h = xxhash.xxh64_intdigest

    def fresh():
        return {}, [h(END_NAME), h(BEGIN_NAME)], [], 0, xxhash.xxh128()

    number, hashes, rows, size, name = fresh()
    for batch in batches:
        for doc_id, held, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            raw = raw or b""
            if rows and size + len(raw) > CHUNK_BYTES:
                yield h(name.digest()) >> 1, np.array(hashes, np.uint64), rows
                number, hashes, rows, size, name = fresh()
            words = raw.lower().split()
            seq = np.empty(len(words) + 1, np.int64)
            seq[:-1] = [number.setdefault(w, len(number) + 2) for w in words]
            seq[-1] = 0
            if len(number) + 2 > len(hashes):
                known = len(hashes) - 2
                hashes += [h(w) for w in list(number)[known:]] if known * 2 < len(number) else [h(w) for w in _tail(number, len(number) - known)]
            rows.append((doc_id, held, seq))
            size += len(raw)
            name.update(b"%s:%d:" % (str(doc_id).encode(), len(raw)))
            name.update(raw)
    if rows:
        yield h(name.digest()) >> 1, np.array(hashes, np.uint64), rows


def _tail(number: dict[bytes, int], n: int) -> list[bytes]:
    """The last n keys in order of insertion."""
    it = reversed(number)
    return [next(it) for _ in range(n)][::-1]


def hot_words(src: DataFrame, targets: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, spread) of the words with HOT_SHARE of all words in a bounded sample by hash (so 1/HOT_SHARE of them at most).

    A word is spread over as many parts as its share is of the targets, so that each part is about one target's work.
    """
    import xxhash

    ids = src.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(HOT_SAMPLE)
    words = src.join(F.broadcast(ids), "doc_id").select(F.explode(F.split(fold_ascii(F.col("text")), r"[\x20\x09-\x0D]+")).alias("w"))
    counts = words.groupBy("w").count()
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    rows = counts.where((F.col("count") >= HOT_SHARE * total) & (F.col("w") != "")).collect()
    parts = lambda n: 1 << (min(MOST_SPREAD, max(2, int(4 * n / total * targets))) - 1).bit_length()
    found = sorted((xxhash.xxh64_intdigest(r.w.encode()), parts(r["count"])) for r in rows)
    return np.array([h for h, _ in found], np.uint64), np.array([n for _, n in found], np.int64)


def score_documents(docs: DataFrame, held_every: int = 7, held_rest: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of documents.

    The model learns from rows whose crc32 of the id modulo ``held_every`` isn't ``held_rest`` (null ids: remainder 0).
    Null and empty texts are the end token alone. Repeated rows count as often as they are there, and equal rows have
    equal scores. With nothing to learn from, probabilities are uniform over one unseen word.
    """
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod(F.col("doc_id"), held_every) == held_rest).alias("held"), F.col("text"))
    src = settled(src, "lm-texts")
    targets = max(256, 1 << (4 * src.rdd.getNumPartitions() - 1).bit_length())

    hot = hot_words(src, targets)

    def whole(hashes, rows):
        seqs = [r[2] for r in rows]
        return Chunk(hashes, np.concatenate(seqs), np.array([len(s) for s in seqs]), targets, hot)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, hashes, rows in read_chunks(batches):
            chunk = whole(hashes, rows)
            learn = np.repeat([not r[1] for r in rows], chunk.lengths)
            pair_counts = np.bincount(chunk.pair_of, learn, len(chunk.left)).astype(np.int64)
            word_counts = np.bincount(chunk.sequence, learn, len(hashes)).astype(np.int64)
            word_counts[1] = sum(not r[1] for r in rows)
            out = []
            for t in chunk.present():
                words, pairs, starts = chunk.of(t)
                h1 = hashes[chunk.left[pairs[starts]]]
                out.append((t, hashes[words].tobytes(), pack_ints(word_counts[words]), h1.tobytes(), pack_ints(np.diff(np.r_[starts, len(pairs)])), pack_ints(chunk.h2[pairs], 8), pack_ints(pair_counts[pairs])))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(out)), pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["chunk", "target", "wh", "wc", "ch", "cn", "sh", "sc"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(target, asked):
            wh = [np.frombuffer(a[1], np.uint64) for a in asked]
            words, where = np.unique(np.concatenate(wh), return_inverse=True)
            counts = np.bincount(where, np.concatenate([unpack_ints(a[2]) for a in asked]), len(words)).astype(np.int64)
            real = counts[(words != np.uint64(begin)) & (counts > 0)]
            meta = [None, int(real.sum()), len(real), *[int((real == k).sum()) for k in (1, 2, 3, 4)]]
            ch = [np.frombuffer(a[3], np.uint64) for a in asked]
            cn = [unpack_ints(a[4]) for a in asked]
            contexts, ctx = np.unique(np.concatenate(ch), return_inverse=True)
            each = np.repeat(ctx, np.concatenate(cn))
            pairs, of = np.unique((each << 40) | np.concatenate([unpack_ints(a[5], 8) for a in asked]), return_inverse=True)
            pair_counts = np.bincount(of, np.concatenate([unpack_ints(a[6]) for a in asked]), len(pairs)).astype(np.int64)
            meta += [int((pair_counts == k).sum()) for k in (1, 2, 3, 4)]
            total, kinds = masses(len(contexts), pairs >> 40, pair_counts)
            parts = np.flatnonzero(np.isin(contexts, hot[0]) & (total > 0))
            tally = [meta, *[[int(n), int(total[i]), *kinds[i].tolist(), *[0] * 6] for i, n in zip(parts, contexts[parts].view(np.int64), strict=True)]]
            sizes = np.bincount(pairs >> 40, minlength=len(contexts))
            yield (OWN, target, contexts.tobytes(), pack_ints(sizes), pack_ints(pairs & LOW40, 8), pack_ints(pair_counts), tally)
            w = c = p = 0
            for i, a in enumerate(asked):
                own_w, own_c = where[w : w + len(wh[i])], ctx[c : c + len(ch[i])]
                n = int(cn[i].sum())
                yield (a[0], target, pack_ints(counts[own_w]), pack_ints(steps(own_c)), pack_ints(steps(of[p : p + n])), None, None)
                w, c, p = w + len(wh[i]), c + len(ch[i]), p + n

        def batch_of(out):
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[2:6]], pa.array(cols[6], pa.list_(pa.list_(pa.int64())))], names=["chunk", "target", "a", "b", "c", "d", "tally"])

        last, asked = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("target", "chunk", "wh", "wc", "ch", "cn", "sh", "sc")), strict=True):
                if row[0] != last and asked:
                    yield batch_of(list(close(last, asked)))
                    asked = []
                last = row[0]
                asked.append(row[1:])
        if asked:
            yield batch_of(list(close(last, asked)))

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["chunk", "target", "doc_id", "held", "body"]
        for name, hashes, rows in read_chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([-1], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.bool_()), pa.array([hashes.tobytes()], pa.binary())], names=names)
            for i in range(0, len(rows), 2000):
                ids, held, seqs = zip(*rows[i : i + 2000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids)), pa.array([targets] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array(held), pa.array([pack_ints(s) for s in seqs], pa.binary())], names=names)

    import xxhash

    begin = xxhash.xxh64_intdigest(BEGIN_NAME)
    asked = src.mapInArrow(ask, "chunk long, target int, wh binary, wc binary, ch binary, cn binary, sh binary, sc binary")
    counted = asked.repartition("target").sortWithinPartitions("target", "chunk").mapInArrow(count, "chunk long, target int, a binary, b binary, c binary, d binary, tally array<array<long>>")
    counted = cut(counted)
    let_go(spark)
    sums = counted.where(F.col("chunk") == OWN).select(F.explode("tally").alias("t")).groupBy(F.col("t")[0].alias("name")).agg(*[F.sum(F.col("t")[i]) for i in range(1, 11)]).collect()
    sums = {r[0]: r[1:] for r in sums}  # the counts of counts, and what the parts of each spread context have: as many as hot_words finds at most
    totals = sums.pop(None, (0,) * 10)
    tokens, types = int(totals[0]), int(totals[1])
    d = discounts(*map(float, totals[2:6]))
    pair_d = discounts(*map(float, totals[6:]))
    unseen = float(d[1] * totals[2] + d[2] * totals[3] + d[3] * (types - totals[2] - totals[3])) / max(1, tokens) if tokens else 1.0
    names = np.array(list(sums), np.int64).view(np.uint64)
    order = np.argsort(names)
    names, whole_sums = names[order], np.array([r[:4] for r in sums.values()], np.int64).reshape(-1, 4)[order]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def looked_up(contexts, sizes, successors, counts):
            """(codes of all pairs that the chunks ask for, codes of the contexts' weights), as the target's trie has them."""
            ctx = np.repeat(np.arange(len(contexts)), sizes)
            total, kinds = masses(len(contexts), ctx, counts)
            if len(names):
                place = np.minimum(np.searchsorted(names, contexts), len(names) - 1)
                spread = names[place] == contexts
                total[spread], kinds[spread] = whole_sums[place[spread], 0], whole_sums[place[spread], 1:]
            left = pair_d[1] * kinds[:, 0] + pair_d[2] * kinds[:, 1] + pair_d[3] * kinds[:, 2]
            weights = np.where(total > 0, np.minimum(1.0, left / np.maximum(total, 1)), 1.0)
            seen = counts > 0
            probs = (counts[seen] - pair_d[np.minimum(counts[seen], 3)]) / total[ctx[seen]]
            short = (contexts >> np.uint64(1)).astype(np.int64)
            trie = Trie(short, ctx[seen], successors[seen], probs, weights, PROBABILITIES_FROM)
            return trie.lookup(trie.number(short)[ctx], successors), trie.weights  # each distinct pair is searched for once

        codes = weights = None
        for batch in batches:
            out = []
            for chunk, target, a, b, c, e in zip(*(batch.column(x).to_pylist() for x in ("chunk", "target", "a", "b", "c", "d")), strict=True):
                if chunk == OWN:
                    codes, weights = looked_up(np.frombuffer(a, np.uint64), unpack_ints(b), unpack_ints(c, 8), unpack_ints(e))
                else:
                    out.append((chunk, target, a, pack_ints(weights[np.cumsum(unpack_ints(b))], 2), pack_ints(codes[np.cumsum(unpack_ints(c))], 2)))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *[pa.array(x, pa.binary()) for x in cols[2:]]], names=["chunk", "target", "counts", "weights", "codes"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(hashes, parts, rows):
            chunk = whole(hashes, rows)
            counts, codes, weights = np.full(len(hashes), -1, np.int64), np.zeros(len(chunk.left), np.int64), np.zeros(len(hashes), np.int64)
            for t in chunk.present():
                words, pairs, starts = chunk.of(t)
                if t not in parts:
                    raise RuntimeError("a chunk has no answer: its input changed between two reads")
                c, m, k = parts[t]
                counts[words], codes[pairs] = unpack_ints(c), unpack_ints(k, 2)
                weights[chunk.left[pairs[starts]]] = unpack_ints(m, 2)  # all parts of a spread context have one weight
            n = np.maximum(counts, 0)
            uni = np.maximum(n - d[np.minimum(n, 3)], 0) / max(1, tokens) + unseen / (types + 1)
            prob = dequantise(codes, PROBABILITIES_FROM) + dequantise(weights, PROBABILITIES_FROM)[chunk.left] * uni[chunk.right]
            log = np.log10(prob)[chunk.pair_of]
            base = np.log10((n + 1) / (tokens + types + 1))[chunk.sequence]
            known = (n > 0)[chunk.sequence]
            starts = np.cumsum(chunk.lengths) - chunk.lengths
            sums = [np.add.reduceat(x, starts) for x in (log, base, known.astype(np.int64))]
            cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), pa.array(chunk.lengths.astype(np.int64)), pa.array(sums[2].astype(np.int64)), pa.array(np.full(len(rows), tokens)), pa.array(sums[1]), pa.array(sums[0])]
            return pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        last, hashes, parts, rows = None, None, {}, []
        for batch in batches:
            for name, target, doc_id, held, body, c, m, k in zip(*(batch.column(x).to_pylist() for x in ("chunk", "target", "doc_id", "held", "body", "counts", "weights", "codes")), strict=True):
                if name != last and rows:
                    yield close(hashes, parts, rows)
                if name != last:
                    last, hashes, parts, rows = name, None, {}, []
                if target < 0:
                    hashes = np.frombuffer(body, np.uint64)
                elif body is None:
                    parts[target] = (c, m, k)
                else:
                    rows.append((doc_id, held, unpack_ints(body)))
        if rows:
            yield close(hashes, parts, rows)

    none = lambda kind: F.lit(None).cast(kind)
    answers = counted.drop("tally").mapInArrow(answer, "chunk long, target int, counts binary, weights binary, codes binary")
    both = answers.select("chunk", "target", none("long").alias("doc_id"), none("boolean").alias("held"), none("binary").alias("body"), "counts", "weights", "codes")
    both = both.union(src.mapInArrow(sequences, "chunk long, target int, doc_id long, held boolean, body binary").select("*", none("binary"), none("binary"), none("binary")))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return both.repartition("chunk").sortWithinPartitions("chunk", "target").mapInArrow(finish, schema)
