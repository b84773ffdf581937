import base64
import hashlib
import re

import public_tokenizers as P
import pytest
import tiktoken
import xxhash

from pageloom.llm import bpe, decontam, queries, simhash, urlrules

from .conftest import sentence, texts

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
sha = lambda b: hashlib.sha256(b).hexdigest()


@pytest.fixture(params=["edge_docs", "some_docs", "no_docs"])
def docs(request):
    return request.getfixturevalue(request.param)


def test_bpe_equals_library(docs):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    want = []
    for i, t in texts(docs):
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in bpe.digests(bpe.encode_decode(docs, RANKS, P.PATTERN)).collect())


def test_bpe_decode_join(edge_docs):
    small = edge_docs.where("doc_id < 23 or doc_id is null")
    got = bpe.decode_ids(bpe.encode_decode(small, RANKS, P.PATTERN), RANKS).collect()
    assert sorted((repr(r.doc_id), bytes(r.decoded).decode()) for r in got) == sorted((repr(i), t or "") for i, t in texts(small))


def brute_fp(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, radius=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(fps))]


def test_simhash_brute_force(docs):
    rows = texts(docs)
    fps = [brute_fp(t) for _, t in rows]
    comp = brute_components([i for i, _ in rows], fps)
    want = sorted(repr((i, f"{f:016x}", c)) for (i, _), f, c in zip(rows, fps, comp, strict=True))
    assert want == sorted(repr(tuple(r)) for r in simhash.simhash_near_dedup(docs).collect())
    kept = sorted(repr(r.doc_id) for r in simhash.keep_one(docs).collect())
    assert kept == sorted(map(repr, {c for c in comp}))


def test_vocabulary_is_whole_or_refused(tmp_path, monkeypatch):
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(b"token%d" % i) + b" %d\n" % i for i in range(50)))
    assert len(bpe.load_ranks(str(path))) == 50
    monkeypatch.setattr(bpe, "VOCABULARY_BYTES", 60)
    with pytest.raises(ValueError):
        bpe.load_ranks(str(path))


def test_keep_one_by_component(spark):
    """Unrelated rows without an id, or with one id, stay; copies of a kept document don't."""
    a, b, c, d, e = (sentence(i, 80) for i in range(60, 65))
    rows = [(None, a), (None, a), (None, b), (None, c), (5, c), (3, c), (7, d), (7, e), (8, e), (None, None), (None, ""), (9, sentence(70, 80))]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, fp int").repartition(3)
    got = sorted((repr(r.doc_id), r.text or "") for r in simhash.keep_one(docs).collect())
    assert simhash.keep_one(docs).columns == docs.columns
    assert got == sorted([("None", a), ("None", b), ("3", c), ("7", d), ("7", e), ("None", ""), ("9", sentence(70, 80))])


def test_keep_one_any_columns(spark):
    """Maps, structs and clashing names come through; an empty table stays empty."""
    rows = [(1, "same text here for all of us", {"k": 1}, 5, "x"), (2, "same text here for all of us", None, 6, "y"), (None, "other words stand in this row now", {"a": 2}, 7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tags map<string,int>, _fp int, file string")
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns and sorted((repr(r.doc_id), r.tags, r._fp, r.file) for r in got.collect()) == [("1", {"k": 1}, 5, "x"), ("None", {"a": 2}, 7, None)]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_decon_repetitive_text(spark):
    """A long text that repeats a window, and one whose windows overlap themselves."""
    bench = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "r r r r r r r r r r r")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c d e f g h i j " * 3000), (2, "r " * 5000), (3, "r " * 9)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontam.decontaminate(docs, bench).collect()}
    assert got == {1: (30000, 30000, 1), 2: (5000, 5000, 1), 3: (9, 0, 0)}


def test_simhash_large_bucket(spark, monkeypatch):
    """A family of many fingerprints near each other, in chains, over the bucket limit."""
    import random

    rnd, base, fps = random.Random(5), 0x0123456789ABCDEF, []
    for _ in range(300):
        x = base
        for b in rnd.sample(range(20), rnd.randint(0, 12)):
            x ^= 1 << b
        fps.append(x)
    fps += [rnd.getrandbits(64) for _ in range(50)]
    ids = list(range(len(fps)))
    monkeypatch.setattr(simhash, "BUCKET_LIMIT", 40)
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in zip(ids, fps, strict=True)], "doc_id long, fp long")
    comp = {r.fp % (1 << 64): r.component_id for r in simhash.near_components(df).collect()}
    assert [comp[f] for f in fps] == brute_components(ids, fps)


def fold(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute_decon(rows, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = {}
    for i, t in items:
        w = word.findall(fold(t))
        for s in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[s : s + window]), set()).add(i)
    lengths = sorted({len(k) for k in wins})
    for d, t in rows:
        w, hit, found = word.findall(fold(t)), set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in wins:
                    hit.update(range(s, s + n))
                    found |= wins[k]
        listed = sorted(str(i) for i in found if i is not None)
        yield d, len(w), len(hit), len(listed), sha(",".join(listed).encode()), bool(hit)


def test_decontaminate_brute_force(docs, spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    own = next((t for i, t in texts(docs) if i == 2), "a b c")
    items += [(900, " ".join(own.split()[10:40])), (901, " ".join(own.split()[10:40])), (902, "Two WORDS!"), (902, "Two WORDS!"), (903, None), (904, "--"), (None, "one"), (905, "rep rep rep")]
    bench = spark.createDataFrame([(*x, "t") for x in items], "item_id long, text string, term string")
    want = sorted(repr(x) for x in brute_decon(texts(docs), items))
    assert want == sorted(repr(tuple(r)) for r in decontam.decontaminate(docs, bench).collect())
    clean = sorted(repr((d, t)) for (d, t), x in zip(texts(docs), brute_decon(texts(docs), items), strict=True) if not x[5])
    assert clean == sorted(repr((r.doc_id, r.text)) for r in decontam.drop_contaminated(docs, bench).collect())
    empty = decontam.decontaminate(docs, bench.limit(0))
    assert empty.where("contaminated").count() == 0 and empty.count() == docs.count()


def test_proximity(spark):
    """Near matches against brute force: a changed rare word, an extra word, a window of one word, order, repeats, nulls."""
    phrase = "alpha beta gamma delta rare1 epsilon zeta rare2 eta theta"
    words = phrase.split()
    texts_ = [
        f"x y {phrase} z", f"{phrase.replace('rare1', 'other')} x", "a b " + " ".join(words[:5] + ["extra"] + words[5:]), " ".join(words[:5] + ["e1", "e2"] + words[5:]), " ".join(reversed(words)),
        "only lonely here", phrase.replace("rare1", "q").replace("rare2", "q"), f"{phrase.replace('rare2 ', '')} tail " * 3, None, "", "gamma alpha beta",
    ]
    bench = spark.createDataFrame([(1, phrase), (2, "lonely"), (3, None), (4, "")], "item_id long, text string")
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate([*texts_, texts_[0]])], "doc_id long, text string, w string")

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = row[:]
            for j, y in enumerate(b):
                row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
        return row[-1]

    key = {hashlib.md5(t.encode()).hexdigest() if t is not None else "": t for t in texts_}
    for slack, missing in ((0, 0), (1, 1), (2, 0)):
        found = decontam.proximity_matches(docs, decontam.phrases(bench, 10), slack=slack, missing=missing).collect()
        got = {(key[r.key], r.start) for r in found}
        hit = {t for t, _ in got}
        want = set()
        for t in texts_:
            w = re.findall("[a-z0-9]+", t or "")
            for p in (words, ["lonely"]):
                need = max(1, len(p) - missing)
                if any(lcs(p, w[s : s + len(p) + slack]) >= need for s in range(len(w))):
                    want.add(t)
        assert hit == want, (slack, missing)


def brute_url(url, rules, default="allow"):
    if not url or "://" not in url:
        return "", "", None, default
    rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    host, path = fold(host), slash + path
    fits = []
    for verdict, rule in rules:
        rh, s, rp = rule.partition("/")
        rh = fold(rh)
        if (host == rh or host.endswith("." + rh)) and path.startswith(s + rp):
            fits.append((len(rule), rule, verdict))
    return (host, path, *(max(fits)[1:] if fits else (None, default)))


URLS = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.COM/en/7x?q", "https://a.b.example.com/en/", "http://com/en/", "http://xcom/en/1", "http://example.net/de/8#x", "http://example.net?/de/", "http://org/es/a://b", "a://.com/en/", "http://b.org\n/es/"]


@pytest.mark.parametrize("ranges", [1, 7, 60])
def test_url_rules(spark, sf, ranges):
    """Against brute force, however many ranges there are; a third of the urls are one."""
    rules = [*urlrules.RULES, ("block", "a.b.example.com/"), ("allow", "b.example.com/en"), ("block", "m"), ("allow", "Hot.org/x/"), ("block", "hot.org/x/y"), ("allow", "hot.org/x/y"), ("block", "org/"), ("block", None), (None, "z")]
    rules += [("block", f"h{i % 40}.com/p{i}") for i in range(300)]
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()
    rows = [(r.page_id, r.url) for r in pages] + [(1000 + i, u) for i, u in enumerate(URLS)] + [(1000, None), (None, "http://x.com/en/")]
    rows += [(2000 + i, "http://www.hot.org/x/y?q") for i in range(150)] + [(3000 + i, f"http://{'w.' * (i % 3)}h{i % 40}.com/p{i}0/") for i in range(200)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, key string")
    table = spark.createDataFrame(rules, "verdict string, rule string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = urlrules.judge_urls(df, table).collect()
        assert sorted(repr(tuple(r)) for r in got) == sorted(repr((i, *brute_url(u, [r for r in rules if None not in r]))) for i, u in rows)
        assert urlrules.judge_urls(df.limit(0), table).count() == 0
        assert {r.verdict for r in urlrules.judge_urls(df, table.limit(0)).collect()} == {"allow"}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_rules_of_the_contract(spark):
    """Rule by rule, with the verdict that the contract names; the SQL has the same rules."""
    rules = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
    assert urlrules.RULES == rules and all(f"('{v}', '{r}'," in queries.ORACLES["op6_url_rules"] for v, r in rules)
    df = spark.createDataFrame([(i, f"http://www.{r}1") for i, (_, r) in enumerate(rules)], "page_id long, url string")
    got = urlrules.judge_urls(df, spark.createDataFrame(urlrules.RULES, "verdict string, rule string")).collect()
    assert {r.page_id: (r.verdict, r.rule) for r in got} == dict(enumerate(rules))


def test_queries_run(spark, sf):
    for name in ("op4_decontaminate", "op6_url_rules"):
        assert queries.QUERIES[name](spark, sf).count() > 0


def test_rule_ranges_hold_all_that_fits():
    """A rule is in every range where a url may be that it fits, and in few of those that its host fills."""
    import random

    rnd = random.Random(11)
    keys = ["com.", "com.example.", "com.example.a.", "com.example.b.", "org."]
    urls = [(rnd.choice(keys), "/" + "".join(rnd.choice("ab/") for _ in range(rnd.randint(0, 5)))) for _ in range(400)]
    for n in (0, 1, 7, 60):
        points = sorted(rnd.choice(urls) for _ in range(n))
        for key, path in {(rnd.choice(keys), rnd.choice(urls)[1]) for _ in range(60)}:
            held = set(urlrules.rule_ranges(points, key, path))
            for k, p in urls:
                if (k == key or k.startswith(key)) and p.startswith(path):
                    assert set(range(urlrules.bisect.bisect_left(points, (k, p)), urlrules.bisect.bisect_right(points, (k, p)) + 1)) <= held
    points = sorted(("com.big.", f"/{i:05}") for i in range(1000))
    assert sum(len(urlrules.rule_ranges(points, "com.big.", f"/{i:05}")) for i in range(1000)) <= 3000
