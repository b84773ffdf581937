"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

A lexicon is learned first: words (lower case, edge punctuation off) that are far more frequent among toxic than among
clean labelled documents. Features are lexicon densities, second-person proximity, and rates of capitals, punctuation
and obfuscation; the trees see nothing else. Lexicon, trees and calibration are fitted on separate parts of a bounded
sample of labelled rows, so no part is flattered by rows that it has seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import crc_mod
from pageloom.session import cut

#: Labelled rows that a model is fitted on at most, taken by hash of the id (a bounded sample; scoring covers all rows).
FIT_ROWS = 30_000
#: Words of the lexicon at most, the most frequent among toxic documents first.
LEXICON_WORDS = 20_000
THRESHOLD = 0.7
TREES, DEPTH, RATE, BINS = 80, 3, 0.15, 48
# Second-person words.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner deinen ihr euch euer sie tu te toi ton ta tes vous votre vos ti usted ustedes tus su sus vosotros".split())
# Characters written for letters.
DISGUISES = bytes.maketrans(b"013457@$", b"oieastas")
SPLIT = bytes.maketrans(b".,;:!?\"()[]{}|/\\<>=+~^`", b" " * 23)
OBFUSCATED = re.compile(rb"[a-z\x80-\xff]+[0-9@$*#_.\-][a-z0-9@$*#\x80-\xff]*[a-z\x80-\xff][a-z0-9@$*#\x80-\xff]*|[0-9@$][a-z\x80-\xff]+[a-z0-9@$]*")
FEATURES = ["hits", "hit_rate", "weight_rate", "max_weight", "distinct_hits", "near_you", "near_rate", "you_rate", "capitals", "capital_runs", "punctuation", "exclaims", "obfuscated", "obfuscated_hits", "log_words"]
_CAPITAL_RUN = re.compile(rb"\b[A-Z]{3,}\b")


def features(text: bytes, lexicon: dict[bytes, float]) -> list[float]:
    """The dense features of one whole text; an empty text has zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    low = text.decode(errors="replace").lower().encode()
    words = low.translate(SPLIT).split()
    n, size = max(1, len(words)), len(text)
    at = [i for i, w in enumerate(words) if w in lexicon]
    hits = [words[i] for i in at]
    obfuscated, disguised = 0, []
    if text.translate(None, b"0123456789@$*#_-") != text:
        for w in OBFUSCATED.findall(low):
            obfuscated += 1
            plain = w.translate(DISGUISES, b"*#_.-")
            if plain != w and plain in lexicon:
                disguised.append(plain)
    weights = [lexicon[w] for w in hits] + [lexicon[w] for w in disguised]
    near = you = 0
    if weights:
        second = {i for i, w in enumerate(words) if w.decode(errors="replace") in SECOND_PERSON} if at else set()
        you = len(second)
        near = sum(any(j in second for j in range(i - 5, i + 6)) for i in at) if second else 0
    raw = np.frombuffer(text, np.uint8)
    counts = np.bincount(raw, minlength=256)
    capitals, letters = counts[65:91].sum(), counts[65:91].sum() + counts[97:123].sum()
    marks = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()
    k = len(weights)
    return [
        k, k / n, sum(weights) / n, max(weights, default=0.0), len({*hits, *disguised}), near, near / n, you / n, capitals / max(1, letters),
        len(_CAPITAL_RUN.findall(text)) / n, marks / size, counts[33] / n, obfuscated / n, len(disguised), float(np.log1p(len(words))),
    ]


def learn_lexicon(rows: DataFrame) -> dict[bytes, float]:
    """Words with their log odds among toxic against clean documents of (text, toxic)."""
    words = F.array_distinct(F.split(F.translate(F.lower("text"), ".,;:!?\"()[]{}|/\\<>=+~^`", " " * 23), r"[\x20\x09-\x0D]+"))
    flat = rows.select("toxic", F.explode(words).alias("w")).where("w <> ''")
    n = dict(rows.groupBy("toxic").count().collect())
    pos, neg = n.get(1, 0), n.get(0, 0)
    if not pos or not neg:
        return {}
    seen = flat.groupBy("w").agg(F.sum(F.col("toxic").cast("long")).alias("p"), F.sum(1 - F.col("toxic").cast("long")).alias("n")).where("p >= 2")
    odds = F.log((F.col("p") + 0.5) / (pos + 1)) - F.log((F.col("n") + 0.5) / (neg + 1))
    top = seen.withColumn("o", odds).where("o > 2.0").orderBy(F.desc(F.col("o") * F.sqrt("p")), "w").limit(LEXICON_WORDS)
    return {r.w.encode(): float(r.o) for r in top.collect()}


@dataclass
class Boosted:
    """Trees of threshold splits over binned features, and the calibration of their sum."""

    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    xs: np.ndarray
    ys: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, cut_at, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut_at[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        m = self.margin(x)
        raw = 1 / (1 + np.exp(-np.clip(m, -30, 30)))
        return np.clip(0.995 * np.interp(raw, self.xs, self.ys) + 0.005 * raw, 0, 1) if len(self.xs) else raw


def isotonic(raw: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of a non-decreasing map from raw score to probability."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []
    for x, y in zip(raw[order].tolist(), label[order].tolist(), strict=True):
        pools.append([y, 1.0, x, x])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, w, _, hi = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + w, pools[-1][2], hi]
    xs, ys = [], []
    for s, w, lo, hi in pools:
        p = (s + 0.1) / (w + 0.2)
        xs += [lo, hi]
        ys += [p, p]
    return np.array(xs), np.maximum.accumulate(np.array(ys)) if ys else np.array(ys)


def boost(x: np.ndarray, y: np.ndarray) -> Boosted:
    """Logistic boosting with second-order leaf values on histograms."""
    p0 = (y.sum() + 0.5) / (len(y) + 1)
    model = Boosted(float(np.log(p0 / (1 - p0))), [], np.empty(0), np.empty(0))
    edges = [np.unique(np.quantile(np.unique(x[:, f]), np.linspace(0, 1, BINS))) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    margin = np.full(len(y), model.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, cut_at, leaf = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf), np.zeros(2**DEPTH)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                own = node == k
                if own.sum() < 10:
                    continue
                gs, hs, best = g[own].sum(), h[own].sum(), 1e-6
                for f, e in enumerate(edges):
                    b = binned[own, f]
                    gl, hl = (np.cumsum(np.bincount(b, v[own], len(e) + 1))[:-1] for v in (g, h))
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    if len(gain) and gain[i := int(gain.argmax())] > best:
                        best, feature[k], cut_at[k] = gain[i], f, e[i]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut_at[node])
        own = node - (2**DEPTH - 1)
        leaf = RATE * np.bincount(own, g, 2**DEPTH) / (np.bincount(own, h, 2**DEPTH) + 1)
        model.trees.append((feature, cut_at, leaf))
        margin += leaf[own]
    return model


@dataclass
class ToxicityModel:
    lexicon: dict[bytes, float]
    trees: Boosted | None
    rate: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.rate)
        return self.trees.score(np.array([features(t, self.lexicon) for t in texts], float).reshape(-1, len(FEATURES)))


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """A model from the labelled rows that may be learned from; without both classes it scores the share of toxic rows.

    Of rows that share an id one is learned from (by a hash of the text), so FIT_ROWS bounds rows, too.
    """
    allowed = crc_mod(F.col("doc_id"), 3) != 1
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(allowed).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)  # the bounded sample
    rows = docs.where("doc_id is not null").where(allowed).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    one = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))  # one row for an id, limited before the shuffle, too
    rows = rows.withColumn("_n", one).where("_n = 1").drop("_n").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(20)))
    rows = cut(rows)
    lexicon = learn_lexicon(rows.where("part < 13"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t or b"", lexicon) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["part", "toxic", "x"])

    seen = rows.where("part >= 13").select(F.col("part").cast("int"), F.col("toxic").cast("int"), "text").mapInArrow(run, "part int, toxic int, x array<double>")
    seen = seen.toPandas()
    y = seen["toxic"].to_numpy(float)
    rate = float(y.mean()) if len(y) else 0.0
    if not len(y) or y.min() == y.max():
        return ToxicityModel(lexicon, None, rate)
    x, trees_part = np.array(seen["x"].tolist(), float), seen["part"].to_numpy() < 17
    if y[trees_part].sum() in (0, trees_part.sum()):
        return ToxicityModel(lexicon, None, rate)
    model = boost(x[trees_part], y[trees_part])
    if (~trees_part).sum() >= 50:
        raw = 1 / (1 + np.exp(-model.margin(x[~trees_part])))
        model.xs, model.ys = isotonic(raw, y[~trees_part])
    return ToxicityModel(lexicon, model, rate)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of documents; labels (doc_id, toxic) teach the model.

    Null text counts as empty and gets a score too; a null id counts as not held out and is never learned from; of
    repeated labels the toxic one counts; unknown or null labels are left out.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.value.score([t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()])
            cols = [batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that the model doesn't reject, unchanged.

    Rows with null or empty texts or null ids are scored like any other and kept unless rejected; repeated rows share
    their fate; other columns, whatever their names, come through as they are. An empty table stays empty; without
    labels nothing is rejected.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.value.score([t or b"" for t in batch.column(place).cast(pa.binary()).to_pylist()])
            yield batch.filter(pa.array(score < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
