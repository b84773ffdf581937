"""Token counts against the library that the model is made for."""

import random

import public_tokenizers as P
import pytest
import sentencepiece

from pageloom.llm import queries
from pageloom.llm.piececount import Pieces, token_counts, words_of

from .conftest import texts

MODEL = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(params=["edge_docs", "some_docs", "no_docs"])
def docs(request):
    return request.getfixturevalue(request.param)


def test_counts_equal_library(docs, library):
    want = sorted(repr((i, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096)) for i, t in texts(docs))
    assert want == sorted(repr(tuple(r)) for r in token_counts(docs, MODEL).collect())


def test_query_equals_library(spark, sf, some_docs, library):
    got = queries.QUERIES["op12_token_counts"](spark, sf)
    assert got.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    assert {r.doc_id: r.n_tokens for r in got.collect()} == {i: len(library.encode(t)) for i, t in texts(some_docs)}


def test_odd_texts(library):
    """Runs of spaces, marks as text, control strings, unknown characters, and long words that the heap must merge in order."""
    with open(MODEL, "rb") as f:
        pieces = Pieces(f.read())
    rnd = random.Random(4)
    odd = ["".join(rnd.choice("abcdeth  ▁é東①\n\t<s>x1\x00　ﬁ👍") for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    odd += ["a" * 5000, "ab" * 3000, " " * 500, " " * 14 + "x", "東京" * 2000, "<s>a</s> <unk> <0x0A>", "", " "]
    for text in odd:
        assert sum(map(pieces.count, words_of(text))) == len(library.encode(text)), text[:40]


def test_memory_bound_changes_nothing(edge_docs):
    assert sorted(map(repr, token_counts(edge_docs, MODEL).collect())) == sorted(map(repr, token_counts(edge_docs, MODEL, memory=3).collect()))


def test_other_models_are_refused(spark, no_docs, tmp_path, monkeypatch):
    (tmp_path / "m").write_bytes(b"x" * 100)
    with pytest.raises(RuntimeError):
        token_counts(no_docs, str(tmp_path / "m"))
    monkeypatch.setattr("pageloom.llm.piececount.MODEL_BYTES", 50)
    with pytest.raises(ValueError):
        token_counts(no_docs, str(tmp_path / "m"))
