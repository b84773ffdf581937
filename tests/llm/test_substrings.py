import hashlib
import random

import pytest

from pageloom.llm import substrings

from .conftest import texts


def brute(rows, window=20):
    """(doc_id, n_words, n_removed, digest) by a table of all windows, documents in order of id and text."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode()))
    first, out = {}, []
    for i, t in order:
        w = (t or "").encode().split()
        gone = set()
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if k in first:
                gone.update(range(s, s + window))
            first.setdefault(k, i)
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return sorted(map(repr, out))


@pytest.fixture(scope="session")
def woven(spark):
    """Texts woven from few passages, cut and edited, so that windows have first occurrences all over the place."""
    rnd = random.Random(11)
    base = [[rnd.choice("abcdefgh") + str(rnd.randint(0, 30)) for _ in range(120)] for _ in range(5)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rnd.randint(1, 4)):
            p, s = rnd.choice(base), rnd.randint(0, 90)
            piece = p[s : s + rnd.randint(5, 60)]
            if rnd.random() < 0.5:
                piece = [*piece]
                piece[rnd.randrange(len(piece))] = f"edit{rnd.randint(0, 3)}"
            words += piece
        rows.append((rnd.randint(0, 100), " ".join(words)))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("name", ["edge_docs", "some_docs", "no_docs", "woven"])
def test_substring_dedup_brute_force(request, name):
    docs = request.getfixturevalue(name)
    got = substrings.substring_dedup(docs)
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(texts(docs))


def test_shared_references(woven, monkeypatch):
    monkeypatch.setattr(substrings, "SEGMENT_ROWS", 10)
    assert sorted(repr(tuple(r)) for r in substrings.substring_dedup(woven).collect()) == brute(texts(woven))


def test_drop_repeats(edge_docs, woven):
    out = substrings.drop_repeats(edge_docs)
    assert out.columns == edge_docs.columns and out.count() == edge_docs.count()
    clean = {repr(x) for x in texts(woven)}
    for r in substrings.drop_repeats(woven.selectExpr("doc_id", "text", "length(text) n_chars")).collect():
        assert r.n_chars == len(r.text)
        if repr((r.doc_id, r.text)) not in clean:
            assert "  " not in r.text


def test_automaton():
    rnd = random.Random(1)
    for _ in range(60):
        text = [rnd.randint(0, 2) for _ in range(rnd.randint(1, 40))]
        sam = substrings.SuffixAutomaton()
        for j, c in enumerate(text):
            prefix = text[:j]
            want = max(n for n in range(j + 1) if n == 0 or any(text[j + 1 - n : j + 1] == (prefix + [c])[e - n : e] for e in range(n, j + 1)))
            assert sam.extend(c) == want
        query = [rnd.randint(0, 3) for _ in range(30)]
        has = {tuple(text[i:k]) for i in range(len(text)) for k in range(i, len(text) + 1)}
        assert sam.matching(query) == [max(n for n in range(j + 2) if tuple(query[j + 1 - n : j + 1]) in has) for j in range(30)]
