"""Inputs that come out of shuffles, many targets, and lineages that must not grow."""

import hashlib

import public_tokenizers as P
import pytest
import tiktoken

from pageloom.llm import bpe, graph, ngramlm, sharding
from pageloom.session import settled

from .conftest import texts

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(params=["repartition", "distinct"])
def shuffled(request, some_docs):
    return some_docs.repartition("doc_id") if request.param == "repartition" else some_docs.dropDuplicates(["doc_id"])


def test_settled_input(some_docs, shuffled):
    plain = some_docs.select("doc_id", "text").where("doc_id is not null")
    assert settled(plain, "x") is plain
    assert settled(shuffled, "x") is not shuffled and settled(shuffled, "x").count() == shuffled.count()


def test_bpe_of_shuffled_input(shuffled):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    want = sorted((i, hashlib.sha256(",".join(map(str, enc.encode_ordinary(t or ""))).encode()).hexdigest()) for i, t in texts(shuffled))
    assert want == sorted((r.doc_id, r.ids_sha256) for r in bpe.digests(bpe.encode_decode(shuffled, RANKS, P.PATTERN)).collect())


def test_scores_of_shuffled_input(some_docs, shuffled):
    show = lambda rows: sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in rows.collect())
    assert show(ngramlm.score_documents(shuffled)) == show(ngramlm.score_documents(some_docs))


def test_blobs_of_a_chunk_are_at_most_its_words(edge_docs, monkeypatch):
    """A hundred times the targets make as many blobs as there are distinct words, and the same ids."""
    small = edge_docs.where("doc_id < 30")
    want = sorted(map(repr, bpe.digests(bpe.encode_decode(small, RANKS, P.PATTERN)).collect()))
    monkeypatch.setattr(bpe, "LEAST_TARGETS", 100_000)
    answers, _ = bpe.encode_words(small, RANKS, P.PATTERN)
    assert answers.count() < 3000
    assert want == sorted(map(repr, bpe.digests(bpe.encode_decode(small, RANKS, P.PATTERN)).collect()))


def test_components_of_a_long_path(spark):
    """Rounds are logarithmic, and no round makes the next one's plan larger."""
    n = 50_000
    edges = spark.range(n - 1).selectExpr("(id * 7919) % 50000 as a", "((id + 1) * 7919) % 50000 as b")
    got = graph.connected_components(edges, "a", "b")
    assert got.where("root = 0").count() == n and got.selectExpr("max(root)").first()[0] == 0


def test_shard_rounds_are_few(spark, monkeypatch):
    """Nothing but pairs: propagation ends while a thousandth of the documents still wants to move, after few rounds."""
    rounds = []
    kept = sharding._flows
    monkeypatch.setattr(sharding, "_flows", lambda *a: rounds.append(1) or kept(*a))
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('pair ', floor(id / 2)) as text")
    shard = {r.doc_id: r.shard for r in sharding.shard_documents(docs).collect()}
    assert sum(shard[i] == shard[i + 1] for i in range(0, 4000, 2)) >= 0.95 * 2000
    assert len(rounds) <= 60
