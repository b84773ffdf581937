"""Each stage of the pipeline on what its predecessor kept, against brute force."""

import hashlib

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from pageloom.llm import bpe, toxicity
from pageloom.llm.queries import QUERIES

from .test_native_and_text import RANKS, brute_components, brute_decon, brute_fp

SF = "/root/testdata/sf0.01"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def without_repeats(docs, window=20):
    first, out = set(), []
    for r in sorted(docs, key=lambda r: (r[0], r[1])):
        w, gone = r[1].encode().split(), set()
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if k in first:
                gone.update(range(s, s + window))
            first.add(k)
        text = b" ".join(x for j, x in enumerate(w) if j not in gone).decode() if gone else r[1]
        out.append((r[0], text, *r[2:4], len(text)))
    return sorted(out, key=repr)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns, kept = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        out = stage(spark, docs, SF)
        if i < 4:
            assert out.columns == columns
            out.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
        else:
            docs = out
        kept[name] = (rows(before), rows(docs))
    before, after = kept["toxicity"]
    bad = {r.doc_id for r in toxicity.toxicity_scores(spark.read.parquet(f"{SF}/documents.parquet"), labels).where("predicted = 1").collect()}
    assert after == [r for r in before if r[0] not in bad] and bad
    before, after = kept["simhash_near_dedup"]
    component = brute_components([r[0] for r in before], [brute_fp(r[1]) for r in before])
    assert after == [r for r, c in zip(before, component, strict=True) if r[0] == c] and len(after) < len(before)
    before, after = kept["substring_dedup"]
    assert after == without_repeats(before) and len(after) == len(before)
    before, after = kept["decontaminate"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert after == sorted((r for r, x in zip(before, brute_decon([r[:2] for r in before], items), strict=True) if not x[5]), key=repr)
    before, after = kept["byte_bpe"]
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(r[0], len(ids := enc.encode_ordinary(r[1])), sha(",".join(map(str, ids)).encode()), sha(r[1].encode()), ids) for r in before]
    assert after == sorted(want, key=repr)
    assert rows(QUERIES["pipeline"](spark, SF)) == after


def as_rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_stages_on_edge_rows(spark, edge_docs, no_docs):
    """Null and repeated ids, null, empty and very long texts, repeated rows and clashing columns, stage by stage."""
    stages, source = dict(corpus_pipeline.STAGES), as_rows(edge_docs)
    for name in list(stages)[:4]:
        out = stages[name](spark, edge_docs, SF)
        assert out.columns == edge_docs.columns and out.schema["fp"] == edge_docs.schema["fp"], name
        assert {(r.key, r.fp, r.words, r.score, r.chunk) for r in out.collect()} == {("key", 1, "words", 2.0, "w")}, name
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = toxicity.toxicity_scores(edge_docs, labels).collect()
    kept = as_rows(stages["toxicity"](spark, edge_docs, SF))
    assert sorted(repr(i) for i, _ in kept) == sorted(repr(r.doc_id) for r in scored if not r.predicted) and {x for x in kept if not x[1]} == {x for x in source if not x[1]}

    fps = [brute_fp(t) for _, t in source]
    root = brute_components(list(range(len(source))), fps)
    want = []
    for c in sorted(set(root)):
        own = [x for x, r in zip(source, root, strict=True) if r == c]
        want.append(min(i if i is not None else 1 << 62 for i, _ in own))
    kept = as_rows(stages["simhash_near_dedup"](spark, edge_docs, SF))
    assert sorted(i if i is not None else 1 << 62 for i, _ in kept) == sorted(want) and set(kept) <= set(source)

    first, want = set(), []
    parts = sorted(source, key=lambda x: (x[0] is None, x[0] or 0, (x[1] or "").encode()))
    for i, t in parts:
        w, gone = (t or "").encode().split(), set()
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in first:
                gone.update(range(s, s + 20))
            first.add(k)
        want.append((i, b" ".join(x for j, x in enumerate(w) if j not in gone).decode() if gone else t))
    assert as_rows(stages["substring_dedup"](spark, edge_docs, SF)) == sorted(want, key=repr)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [x for x, r in zip(source, brute_decon(source, items), strict=True) if not r[5]]
    assert as_rows(stages["decontaminate"](spark, edge_docs, SF)) == clean

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    got = sorted(((r.doc_id, list(r.ids)) for r in stages["byte_bpe"](spark, edge_docs, SF).collect()), key=repr)
    assert got == sorted(((i, enc.encode_ordinary(t or "")) for i, t in source), key=repr)
    for name, stage in stages.items():
        assert stage(spark, no_docs, SF).count() == 0, name
