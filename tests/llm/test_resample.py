"""Importance resampling against a plain restatement."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from pageloom.llm import resample as R

from .conftest import sentence, texts


def features(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute(rows, target, buckets=10000, share=25, least=20, seed=7):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in xs for f in features(x)[1]) for xs in ([x for _, x in rows], target))
    S, T = sum(s.values()), sum(t.values())
    out = []
    for i, x in rows:
        words, fs = features(x)
        gains = [math.floor(1000 * math.log((t[bucket(f)] + 1) * (S + buckets) / ((s[bucket(f)] + 1) * (T + buckets)))) for f in fs]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(words), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))
    n = share * len(able) // 100
    return sorted(repr((i, f, w, c, k)) for k, (i, _, f, w, c) in [(k + 1 if k < n else None, r) for k, r in enumerate(able)] + [(None, r) for r in out if r[1] < least])


@pytest.fixture(params=["edge_docs", "some_docs", "no_docs"])
def docs(request):
    return request.getfixturevalue(request.param)


@pytest.fixture(scope="module")
def target(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet")


def test_equals_brute_force(docs, target):
    want = brute(texts(docs), [r.text for r in target.collect()])
    assert want == sorted(repr(tuple(r)) for r in R.resample(docs, target).collect())


def test_other_parameters_and_targets(spark, edge_docs):
    """No target, null targets, few buckets, everything drawn."""
    for goal in ([], [(1, None), (2, ""), (None, "the of and"), (3, sentence(1, 60))]):
        target = spark.createDataFrame([(*g, "x") for g in goal], "item_id long, text string, doc_id string")
        got = R.resample(edge_docs, target, share=100, least_words=3, seed=11, buckets=37)
        assert got.dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]
        assert brute(texts(edge_docs), [g[1] for g in goal], 37, 100, 3, 11) == sorted(repr(tuple(r)) for r in got.collect())


def test_one_id_in_a_third_of_all_rows(spark, target):
    """Equal rows fill several ranges; ranks stay gapless and the draw exact."""
    rows = [(7 if i % 3 == 0 else i, sentence(1 if i % 3 == 0 else i, 30)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = R.resample(docs, target).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 226))
    assert brute(rows, [r.text for r in target.collect()]) == sorted(repr(tuple(r)) for r in got)


def test_tuples_are_hashed_as_their_bytes():
    import numpy as np

    words = [b"a", "été".encode(), b"c3"]
    doc, bucket = R.tuple_buckets(words, np.array([0, 1, 1, 2, 0]), np.array([3, 0, 2]), 997)
    want = [(0, x) for x in (b"a", words[1], words[1])] + [(2, b"c3"), (2, b"a"), (0, b"a " + words[1]), (0, words[1] + b" " + words[1]), (2, b"c3 a")]
    assert list(zip(doc.tolist(), bucket.tolist())) == [(d, zlib.crc32(x) % 997) for d, x in want]
