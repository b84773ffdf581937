"""Collocations against a plain restatement, with and without hot beginnings."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from pageloom.llm import collocations as C


def brute(rows, least, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        longer = [(q, b) for (m, q), b in f.items() if m == lang and len(q) > len(p) and b >= max(a, least)]
        if any(q[i : i + len(p)] == p for q, _ in longer for i in range(len(q) - len(p) + 1)):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted(repr((lang, i + 1, p.decode(), -a, l, r, n[lang], -s)) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top]))


def corpus(rnd, n):
    words = ["the", "of", "Of", "a", "naïve", "東京", "x1", "o'clock", " b", "new", "york", "city", "hall"]
    line = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 9)))
    rows = []
    for i in range(n):
        parts = [line() if rnd.random() < 0.7 else "in New\tYork  City  hall tonight" for _ in range(rnd.randint(1, 6))]
        rows.append((rnd.choice(["en", "de", None, "und", ""]), rnd.choice([". ", ",", "\r\n", "\x0b", "!?"]).join(parts), i))
    return rows


EDGE = [("en", None, 0), (None, None, 1), ("en", "", 2), ("en", " \t ..\n", 3), ("xx", "a " * 3000, 4), ("en", "one", 5), ("en", "alone here", 6), ("en", "alone here", 6)]


def check(spark, rows, least, top=2000):
    docs = spark.createDataFrame([(*r, "k", 1, "w") for r in rows], "lang string, text string, doc_id long, phrase string, k int, words string").repartition(3)
    got = C.collocations(docs, least, top)
    assert got.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), *[(c, "bigint") for c in ("a", "l", "r", "n", "score")]]
    assert brute([r[:2] for r in rows], least, top) == sorted(repr(tuple(r)) for r in got.collect())
    return docs


def test_equals_brute_force(spark):
    rows = corpus(random.Random(3), 250)
    check(spark, rows + EDGE, 4)
    check(spark, rows, 6, top=7)


def test_empty(spark):
    assert C.collocations(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
    assert C.collocations(spark.createDataFrame(EDGE, "lang string, text string, doc_id long").limit(3)).count() == 0


def test_hot_beginnings(spark, monkeypatch):
    """Pairs, longer beginnings and whole windows that fill buckets: dealt by more words or a salt, counted the same."""
    rnd = random.Random(9)
    rows = [("en", f"hot pair {rnd.choice('abc')} {i % 7} {i}. hot pair every time the same {i}, hot pair {i}", i) for i in range(300)]
    monkeypatch.setattr(C, "LEAST_BUCKETS", 600)
    docs = check(spark, rows + corpus(rnd, 60) + EDGE, 5)
    hot = C.hot_beginnings(docs, 600, 1)
    pair = C.prefix_hashes(C.np.array([[0, 1]]), C.word_hashes(["hot", "pair"]), C.word_hashes(["en"])[[0]])[1]
    assert set(pair.tolist()) <= set(hot.tolist()) and len(hot) <= 4 * 2 * 600


def test_blobs_of_a_chunk_are_bounded(spark, sf, monkeypatch):
    """However many buckets there are, a chunk has no more blobs than windows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    want = sorted(map(repr, C.collocations(docs, 8).collect()))
    monkeypatch.setattr(C, "LEAST_BUCKETS", 1000)
    assert want and want == sorted(map(repr, C.collocations(docs, 8).collect()))


def test_spilling_bucket(monkeypatch):
    """A bucket over its memory limit counts the same from disk; the next one starts afresh."""
    import zstandard

    monkeypatch.setattr(C, "DUCKDB_MEMORY", "60MB")
    rnd = C.np.random.default_rng(1)
    buckets = C.Buckets(2)
    for n in (1_500_000, 1000):
        words = [f"w{i}" for i in range(n // 100)]
        rows = rnd.integers(1, len(words) + 1, (n, C.LONGEST))
        for part in C.np.array_split(rows, 8):
            buckets.add(["en"], zstandard.compress(" ".join(words).encode()), C.pack_ints(part.T.reshape(-1)), C.pack_ints(C.np.zeros(len(part), C.np.int64)), C.pack_ints(C.np.ones(len(part), C.np.int64), 8), C.pack_ints(C.np.full(len(part), 2), 1))
        got = {(b.column(1)[i].as_py(), b.column(2)[i].as_py()): b.column(3)[i].as_py() for b in buckets.close() for i in range(len(b))}
        pairs = Counter(map(tuple, rows[:, :2].tolist()))
        assert {p: n for (k, p), n in got.items() if k == 2} == {f"w{a - 1} w{b - 1}": n for (a, b), n in pairs.items() if n > 1}
    buckets.end()


def test_exact_products(spark):
    """Scores where products pass 64 bits."""
    row = spark.createDataFrame([(9_000_000_000_123, 80_000_000_000_000_001, 9_100_000_000_456, 9_000_000_000_789)], "a long, n long, l long, r long")
    d = lambda c, p: F.col(c).cast(f"decimal({p},0)")
    got = row.select(F.call_function("div", F.lit(1000).cast("decimal(5,0)") * d("a", 14) * d("n", 18), d("l", 18) * d("r", 18))).first()[0]
    assert got == 1000 * 9_000_000_000_123 * 80_000_000_000_000_001 // (9_100_000_000_456 * 9_000_000_000_789)
