"""Contents entries against a plain restatement, and how many blocks an entry meets."""

import random
import re

from pageloom.operators import anchors, similarity

BODY = "doc_id string, id int, page_idx int, text string"
ENTRY = "doc_id string, id int, title string, page_number int, level int, source_page int"


def normal(t):
    return re.sub(r"[^A-Za-z0-9_\s一-鿿]", "", re.sub(r"\s+", " ", t.strip().lower())).strip()


def likeness(a, b):
    if not a or not b:
        return 0.0
    x, y = set(a.split()), set(b.split())
    return len(x & y) / len(x | y)


def plain_match(title, blocks):
    """(block, confidence) of the best block, as one walk over the blocks in order for each of three ways."""
    a, best = normal(title), None
    at_least = lambda other: best[1] if best else other
    for i, text in blocks:
        b = normal(text)
        if b and (a in b or b in a) and likeness(a, b) > at_least(0):
            best = (i, likeness(a, b))
    number = re.match(r"\d+(?:\.\d+)*", title)
    if number and at_least(0) < 0.8:
        for i, text in blocks:
            if text.strip().startswith((number[0] + " ", number[0] + ".")) and likeness(a, normal(text)) > at_least(0.5):
                best = (i, max(likeness(a, normal(text)), 0.7))
    if at_least(0) < 0.6:
        for i, text in blocks:
            if 3 <= len(text.strip()) <= 200 and likeness(a, normal(text)) > max(0.6, at_least(0)):
                best = (i, likeness(a, normal(text)))
    return best


def matched(spark, docs, titles):
    body = spark.createDataFrame([(d, i, i // 4, t) for d, ts in docs.items() for i, t in enumerate(ts)], BODY)
    entries = spark.createDataFrame([(d, 1000 + i, t, None, 1, 0) for d, ts in titles.items() for i, t in enumerate(ts)], ENTRY)
    none = spark.createDataFrame([], "doc_id string, page_offset int")
    got = {(r.doc_id, r.entry - 1000): (r.block_id, round(r.confidence, 9)) for r in anchors.match_contents(entries, body, none).collect()}
    want = {(d, i): plain_match(t, list(enumerate(docs[d]))) for d, ts in titles.items() for i, t in enumerate(ts) if normal(t)}
    return got, {k: (x[0], round(x[1], 9)) for k, x in want.items() if x is not None}


def test_equals_plain_walk(spark):
    rnd = random.Random(12)
    vocabulary = ["the", "of", "a", "cat", "cats", "bathe", "start", "art", "number", "numbers", "fractions", "decimal", "7.1", "7", "7.1.2", "3", "x-ray", "角", "te"]
    text = lambda n: "".join(rnd.choice(vocabulary) + rnd.choice([" ", " ", " ", "  ", " - ", ". "]) for _ in range(rnd.randint(1, n))).strip()
    docs = {f"d{k}": [text(14) if rnd.random() < 0.6 else text(3) for _ in range(60)] + ["", "the", "the", "of the", "of the"] for k in range(8)}
    titles = {d: [text(5) for _ in range(40)] + ["the", "of the", "art", "the cat", "!", "7.1 of the"] for d in docs}
    got, want = matched(spark, docs, titles)
    assert len(want) > 250 and got == want


def test_first_by_number_stays(spark):
    """By number the first block that is more alike than a half counts, at 0.7; a later one only if it is more alike than that."""
    title = "7.1 one two three four five"
    docs = {"a": ["7.1 one two three x y", "7.1 one two three four x y"], "b": ["7.1 one two three x", "7.1 one two three four five x"], "c": ["7.1 x y z v w q"]}
    s = {d: [round(likeness(normal(title), normal(t)), 2) for t in ts] for d, ts in docs.items()}
    assert s == {"a": [0.5, 0.62], "b": [0.57, 0.86], "c": [0.08]}
    got, want = matched(spark, docs | {"e": ["7.1 one two three x", "7.1 one two three four x y"]}, {d: [title] for d in "abce"})
    assert got == want and got == {("a", 0): (1, 0.7), ("b", 0): (1, round(6 / 7, 9)), ("e", 0): (0, 0.7)}


def test_common_words_meet_few_blocks(spark):
    """Titles of stop words in a document whose every block has them."""
    rnd = random.Random(4)
    blocks = [" ".join(["of the"] + [f"w{rnd.randrange(4000)}" for _ in range(8)] + ["and the"]) for _ in range(3000)] + ["the history of the town", "the"]
    body = spark.createDataFrame([("a", i, t, t) for i, t in enumerate(blocks)], "doc_id string, block_id int, t string, b string")
    titles = ["the history of the", "the", "and the people", "of the w17 and", "the of and"]
    entries = spark.createDataFrame([("a", i, t, "") for i, t in enumerate(titles)], "doc_id string, entry int, a string, num string")
    pairs = anchors.loose_pairs(entries, body)
    met = {r.entry: r["count"] for r in pairs.groupBy("entry").count().collect()}
    assert max(met.values()) <= 20, met
    held = {(r.entry, r.block_id) for r in pairs.collect()}
    assert {(0, 3000), (1, 3001)} <= held


def test_similar_pairs_equal_all_pairs(spark):
    rnd = random.Random(6)
    sets = lambda n: [("d", i, sorted({rnd.choice("abcdefghij") * rnd.randint(1, 3) for _ in range(rnd.randint(1, 9))})) for i in range(n)]
    a, b = sets(60), sets(70)
    for tenths in (3, 6, 8):
        got = similarity.similar_pairs(spark.createDataFrame(a, "doc_id string, a_id int, wa array<string>"), spark.createDataFrame(b, "doc_id string, b_id int, wb array<string>"), tenths)
        want = {("d", i, j) for _, i, x in a for _, j, y in b if 10 * len(set(x) & set(y)) > tenths * len(set(x) | set(y))}
        assert {tuple(r) for r in got.collect()} == want


def test_page_offsets_move_blocks_once(spark):
    """Long texts are met whole: their words are not spread out, so nothing that is shuffled is larger than the texts."""
    long = " ".join(f"word{i}" for i in range(60))
    entries = spark.createDataFrame([("a", 0, "Alpha beta gamma", 3), ("a", 1, long, 4), ("a", 2, "xy", 1), ("b", 0, long, 7)], "doc_id string, id int, title string, page_number int")
    body = spark.createDataFrame([("a", 5, 9, "alpha  BETA, gamma"), ("a", 6, 8, long + " more"), ("a", 7, 6, "alpha beta gamma"), ("a", 8, 2, None), ("b", 1, 7, long[:100]), ("c", 1, 7, long)], "doc_id string, id int, page_idx int, text string")
    found = anchors.page_offsets(entries, body)
    assert [tuple(r) for r in found.collect()] == [("a", 6)]
    assert "explode(slice(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_near_best_over_ends_of_runs(spark):
    """Each block in reach is met once, also beyond the end of a run of pages; an entry is a row or two, not one for each pair."""
    entries = spark.createDataFrame([("a", 1, 63, "one two", ""), ("a", 2, 64, "3 gamma", "3"), ("a", 3, 10, "far away", ""), (None, 4, 63, "one two", "")], "doc_id string, entry int, expected int, a string, num string")
    body = spark.createDataFrame([("a", 100 + p, p, "3 gamma one two", "3 gamma one two") for p in range(50, 80)] + [("a", 300, 65, "3 gamma", "3 gamma"), ("a", 301, None, "one two", "one two"), (None, 5, 63, "one two", "one two")], "doc_id string, block_id int, page int, t string, b string")
    rows = anchors.near_best(entries, body, 5).collect()
    assert len(rows) <= 4 and {r.doc_id for r in rows} == {"a"}
    best = lambda e: max(r.x1 for r in rows if r.entry == e and r.x1 is not None)
    assert tuple(best(1)) == (0.5, -158, 58) and tuple(best(2)) == (1.0, -300, 65) and not [r for r in rows if r.entry == 3]
    assert sorted(tuple(x) for r in rows if r.entry == 2 for x in r.firsts) == [(0.5, -164, 64), (0.5, -159, 59), (1.0, -300, 65)]


def test_only_documents_with_contents_are_split(spark, monkeypatch):
    """Of a document without contents pages nothing but its headings goes on; its blocks are neither written again nor shuffled."""
    book = ["Contents"] + [f"{k} Title {k} of it .... {k + 1}" for k in range(1, 7)]
    rows = [("with", i, "text", t, 0, None) for i, t in enumerate(book)]
    rows += [("with", 7 + i, "text", f"{i + 1} Title {i + 1} of it", i + 1, None) for i in range(6)]
    rows += [("without", i, "text", t, i // 10, None) for i, t in enumerate(["Chapter 1"] + ["plain line"] * 30 + ["Chapter 2"] + ["plain line"] * 5)]
    rows += [("without", 100, "text", "Chapter 3", None, None)]
    blocks = spark.createDataFrame(rows, "doc_id string, id int, type string, text string, page_idx int, text_level int")
    kept, write = {}, anchors.stored

    def noted(df, label, made=None):
        kept[label] = write(df, label, made)
        return kept[label]

    monkeypatch.setattr(anchors, "stored", noted)
    tree = anchors.rule_tree(blocks).collect()
    assert {r.doc_id for r in kept["tree-split"].select("doc_id").collect()} == {"with"} and kept["tree-split"].count() == 13
    assert [(r.text, r.page) for r in sorted(tree, key=lambda r: r.ord) if r.doc_id == "without"] == [("Chapter 1", 0), ("Chapter 2", 3), ("Chapter 3", 0)]
    found = sorted((r.block_range.start, r.text) for r in tree if r.doc_id == "with")
    assert len(found) == 6 and all(i >= 7 and text.endswith(f"Title {i - 6} of it") for i, text in found)
