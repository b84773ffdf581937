"""Operators against small inline cases with known results."""

import itertools
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from pageloom.functions import predicates, strategies, text
from pageloom.operators import anchors, answers, blocks, chapters, chunking, exports, questions, tasks
from pageloom.plans import extraction
from pageloom.plans.providers import CallProvider, ReplayProvider, RuleProvider, chunk_prompts
from pageloom.sources import readers


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()[0]


LAYOUT = [
    {"type": "text", "text": "目录", "page_idx": 0}, {"type": "text", "text": "Introduction......5"}, {"type": "page_number", "text": "3"}, {"type": "header", "text": "h"},
    {"type": "list", "sub_type": "text", "list_items": [" a ", ""], "page_idx": 1}, {"type": "list", "list_items": ["a"]},
    {"type": "table", "table_body": "<table><tr><td>a</td></tr><TR><td>b</td></TR></table>"}, {"type": "table", "table_body": "<tr><td>x"},
    {"type": "table", "inside": [{"type": "text", "text": " t ", "text_level": 1}, {"text": "u"}]}, {"type": "table", "text": "plain"},
    {"type": "image", "img_path": "images/i.jpg", "image_caption": ["c", "d"]}, {"type": "aside_text", "text": "z"}, {"type": "equation", "text": " x=1 "}, None,
]


def test_flatten_layout(spark, tmp_path):
    path = tmp_path / "content_list.json"
    path.write_text(json.dumps(LAYOUT), encoding="utf-8")
    rows = blocks.flatten_blocks(readers.read_layouts(spark, str(path))).orderBy("id").collect()
    assert [(r.id, r.type, r.text) for r in rows] == [
        (0, "text", "a"), (1, "text", ""), (2, "list", None), (3, "text", "[Table Row] <tr><td>a</td></tr>"), (4, "text", "[Table Row] <TR><td>b</td></TR>"),
        (5, "text", "t"), (6, "text", "u"), (7, "text", "plain"), (8, "image", None), (9, "aside_text", "z"), (10, "equation", "x=1"),
    ]
    assert rows[5].text_level == 1 and rows[8].image_caption == "c d" and rows[0].page_idx == 1


def test_outline(spark):
    b = spark.createDataFrame([("d", 0, "text", "a ![x](y)  b $q$ $$z$$", 1, None), ("d", 1, "image", None, 1, None), ("d", 2, "text", "  ", 1, None), ("d", 3, "text", "x" * 250, 2, 1)], "doc_id string, id int, type string, text string, page_idx int, text_level int")
    assert blocks.full_text(b).first().outline == "[0|p1] a [IMG] b [EQ] [EQ]\n[1|p1] [Image]\n[3|p2|T1] " + "x" * 200 + "..."


@pytest.mark.parametrize(("label", "number", "kind"), [("1", 1, "exercise"), ("例1", 1, "example"), ("(12)", 12, "exercise"), ("①", -1, "exercise"), ("EX. 3", 3, "example"), ("示例", -1, "example")])
def test_labels(spark, label, number, kind):
    assert (one(spark, text.label_number(F.lit(label))), one(spark, text.question_kind(F.lit(label)))) == (number, kind)


def test_text_helpers(spark):
    assert one(spark, text.trim_ws(F.lit("　 a\t\n"))) == "a"
    assert one(spark, text.utf16_length(F.lit("a😀"))) == 3
    assert one(spark, text.refine_title(F.lit(" 第 3.1 章 "), True)) == "3.1"
    assert one(spark, text.retry_name(F.lit("n (Retry 2)"), F.lit(3))) == "n (Retry 3)"
    assert one(spark, text.mask_key(F.lit("sk-123456789abcd"))) == "sk-12345...abcd"
    assert one(spark, text.duration_ms(F.lit(61500))) == "1分1秒"
    assert one(spark, text.relative_path(F.lit("/a/b/c.jpg"), F.lit("/a/d"))) == "../b/c.jpg"
    assert one(spark, text.block_tokens(F.lit("text"), F.lit("实数abcd"))) == 4


@pytest.mark.parametrize(("title", "reason"), [("要点归纳", "noise"), ("一、选择题", "noise"), ("x", "length"), ("12345", "digits"), ("Solve it", "question"), ("a = b", "formula"), ("Unit 1 = 2", None), ("第一章 实数", None), ("a " * 17, "words"), ("", "empty")])
def test_cleanup(spark, title, reason):
    assert one(spark, predicates.cleanup_reason(F.lit(None).cast("string"), F.lit(title))) == reason


def test_strategies(spark):
    run = lambda s, n, t: tuple(one(spark, strategies.run_chain(s, n, F.lit(t))))
    assert run(strategies.TITLE_FILTERS, "section_marker_filter", "一、选择题") == ("drop", 1.0, "Section marker")
    assert run(strategies.TITLE_FILTERS, "section_marker_filter", "第一章")[0] == "keep"
    assert run(strategies.TITLE_FILTERS, "section_marker_filter", "a" * 101) == ("drop", None, "Title too long")
    assert run(strategies.ANSWER_HEADERS, "explicit_header_match", "参考答案") == ("found", 1.0, None)
    assert run(strategies.ANSWER_HEADERS, "explicit_header_match", "b" * 50) == ("keep", None, "Text too long for heuristic")
    loop = {"a": strategies.Strategy(lambda t: strategies.result("keep"), "b"), "b": strategies.Strategy(lambda t: strategies.result("keep"), "a")}
    assert run(loop, "a", "x")[0] == "keep" and run({}, "none", "x")[0] == "keep"


def test_chunk_fold():
    assert [s for s, _ in chunking.fold_chunks([1] * 1935)] == list(range(0, 1891, 70)) and len(chunking.fold_chunks([1] * 1935)) == 28
    rnd = random.Random(1)
    for _ in range(200):
        t = [rnd.randint(0, 60) for _ in range(rnd.randint(0, 60))]
        spans = chunking.fold_chunks(t, 10, 3, 100)
        assert [i for s, e in spans for i in range(s, e)] == [] if not t else sorted({i for s, e in spans for i in range(s, e)}) == list(range(len(t)))
        assert all(a[0] < b[0] for a, b in itertools.pairwise(spans))
    assert chunking.fold_outline_chunks([500] * 10, 5000, 1000) == [(0, 8), (6, 10)]


def test_chunks_closed_form(spark):
    b = spark.createDataFrame([(d, i, "text", "w") for d, n in ((1, 5), (2, 100), (3, 101), (4, 1935)) for i in range(n)], "doc_id long, id int, type string, text string")
    got = sorted(map(tuple, chunking.token_chunks(b).collect()))
    want = sorted((d, k, s, e - 1) for d, n in ((1, 5), (2, 100), (3, 101), (4, 1935)) for k, (s, e) in enumerate(chunking.fold_chunks([0] * n)))
    assert got == want
    folded = sorted(map(tuple, chunking.token_chunks(b, 20, 5, 10).collect()))
    assert folded == sorted((d, k, s, e - 1) for d, n in ((1, 5), (2, 100), (3, 101), (4, 1935)) for k, (s, e) in enumerate(chunking.fold_chunks([0] * n, 20, 5, 10)))
    members = chunking.chunk_members(b, 20, 5).groupBy("doc_id", "chunk_index").agg(F.min("id"), F.max("id")).collect()
    assert sorted(map(tuple, members)) == sorted(map(tuple, chunking.chunk_windows(b.groupBy("doc_id").agg(F.count("*").alias("n")), 20, 5).collect()))


BLOCKS = [("d", 0, "text", "第1章", None, None), ("d", 1, "text", "1. Q one", None, None), ("d", 2, "image", None, "images/a.jpg", None), ("d", 3, "table", "tt", None, None), ("d", 4, "equation", "e" * 5000, None, None), ("d", 5, "text", "2. Q two", None, None)]
SCHEMA = "doc_id string, id int, type string, text string, img_path string, image_caption string"


def pair(label, q, s="", kind="exercise"):
    return f"<qa_pair><label>{label}</label><type>{kind}</type><question>{q}</question><solution>{s}</solution></qa_pair>"


@pytest.mark.parametrize(
    ("output", "mode", "ids"),
    [
        (f"<chapter><title>0</title>{pair('1', '1,2')}{pair('2', '5')}</chapter>", "strict", ["1,2", "5"]), ("<empty></empty>", None, []), ("  ", None, []),
        (f"<chapter><title>0</title>{pair('1', '1')}</chapter><empty>", None, []), (f"<chapter><title>x</title>{pair('1', 'see 1 and 2')}</chapter>", "lenient", ["1,2"]),
        (pair("1", "10 11"), "lenient", ["10 11"]), ("<chapter><title>0</title></chapter>", None, []), (f"<chapter><title>0</title>{pair('1', chr(10) + '1')}</chapter>", "strict", [""]), ("nothing", None, []),
    ],
)
def test_parse(spark, output, mode, ids):
    rows = answers.parse_answers(spark.createDataFrame([("d", 0, output)], "doc_id string, chunk_index int, output string")).orderBy("pos").collect()
    assert [r.question_ids for r in rows] == ids and {r.mode for r in rows} <= {mode}


def test_backfill(spark):
    b = spark.createDataFrame(BLOCKS, SCHEMA)
    rows = spark.createDataFrame([("d", 0, "1,2,3,4", 0, 9), ("d", 1, "5,5, 9x,x,77", 0, 9), ("d", 2, ",,", 0, 9), ("d", 3, "0,5", 1, 9), ("d", 4, "10 11", 0, 99)], "doc_id string, k int, ids string, lo int, hi int")
    got = {r.k: (r.text, r.images) for r in answers.backfill(rows, "ids", b, ["k"], prefix="/p/").collect()}
    assert got[0] == ("1. Q one\n![image](images/a.jpg)\n[Table] tt\n" + "e" * 4096 + answers.CUT_MARK, ["/p/images/a.jpg"])
    assert got[1] == ("2. Q two\n2. Q two", []) and got[2] == ("", []) and got[3][0] == "2. Q two" and got[4][0] == ""


@pytest.mark.parametrize(
    ("raw", "n"),
    [('{"directory": [{"id": 1, "level": 1, "title": "a"}]}', 1), ('{"directory": [{"id": 1, "level": , "title": "a"},]}', 1), ('{"directory": [{"id": [1, 2], "level": 2, "title": "a"}, {"id": 3, "lev', 1), ('{"directory": [{"id": 1, "level": 1, "title": "a"}', 1),
     ('{"directory": [{"id": , "level": 1}, {"id": 2, "level": 1, "title": "b"}]}', None), ("no json", None), ('{"chapters": [{"id": "x", "level": 1}, {"id": 4, "level": 9}, {"id": 5, "level": 1}]}', 1)],
)
def test_directory(spark, raw, n):
    rows = answers.directory_entries(spark.createDataFrame([("d", raw)], "doc_id string, output string")).collect()
    assert ([r.ok for r in rows] == [False]) if n is None else ([r.ok for r in rows] == [True] * n)


def entry_rows(spark, rows):
    return spark.createDataFrame([("d", i, ids, level, f"t{i}") for i, (ids, level) in enumerate(rows)], "doc_id string, ord int, ids array<int>, level int, title string")


def plain_blocks(spark, n):
    return spark.createDataFrame([("d", i, "text", f"b{i}", 0) for i in range(n)], "doc_id string, id int, type string, text string, page_idx int")


def test_flat_map_against_stack(spark):
    rnd = random.Random(3)
    for _ in range(4):
        n = rnd.randint(2, 12)
        ids = rnd.sample(range(40), n)
        rows = [([i] if rnd.random() < 0.7 else [i, min(39, i + 1)], rnd.randint(1, 4)) for i in ids]
        got = chapters.flat_map(entry_rows(spark, rows), plain_blocks(spark, 40)).orderBy("ord").collect()
        stack = []
        for k, (own, level) in enumerate(rows):
            while stack and stack[-1][1] >= level:
                stack.pop()
            end = min(rows[k + 1][0]) if k + 1 < n else 40
            end = own[0] + 1 if min(own) >= end and k + 1 < n else end
            assert (got[k].parent_id, got[k].block_range.start, got[k].block_range.end) == (stack[-1][0] if stack else None, min(own), end)
            assert got[k].text == " ".join(f"b{i}" for i in own)
            stack.append((own[0], level))


def test_paths_and_coverage(spark):
    rows = entry_rows(spark, [([2], 1), ([4], 2), ([6], 3), ([8], 1)])
    tree = chapters.flat_map(rows, plain_blocks(spark, 12))
    assert [r.path for r in chapters.chapter_paths(tree).orderBy("ord").collect()] == ["b2", "b2 > b4", "b2 > b4 > b6", "b8"]
    at = {r.id: r.path for r in chapters.chapter_of(plain_blocks(spark, 12).select("doc_id", "id"), chapters.chapter_paths(tree)).collect()}
    assert at[1] is None and at[5] == "b2 > b4" and at[11] == "b8"
    assert tuple(chapters.coverage(tree, plain_blocks(spark, 12)).first())[1:] == (10, 0, 1.0)
    assert chapters.validation(entry_rows(spark, [([99], 1)]), plain_blocks(spark, 3)).first().verdict == "unknown_id"
    assert chapters.validation(entry_rows(spark, [([i], 1) for i in range(21)]), plain_blocks(spark, 30)).first().verdict == "many_top_level"


def test_dedup():
    assert questions.greedy_keep([{95, 96}, {95}]) == [0] and questions.greedy_keep([{95}, {95, 96}]) == [1]
    assert questions.greedy_keep([{1, 2, 3}, {3, 4, 5}]) == [0, 1] and questions.greedy_keep([set(), set()]) == [0, 1]


def test_titles(spark):
    rows = spark.createDataFrame([("d", 0, "10", "20.1"), ("d", 1, "11", "基础训练"), ("d", 2, "13", "练习"), ("d", 3, "14", " 20.2  x ")], "doc_id string, seq int, label string, chapter_title string")
    assert [r.chapter_title for r in questions.steady_titles(rows).orderBy("seq").collect()] == ["20.1", "20.1", "练习", " 20.2  x "]
    assert [r.chapter_title for r in questions.filled_titles(questions.steady_titles(rows)).orderBy("seq").collect()] == ["20.1", "20.1", "20.1", "20.2 x"]


def test_extraction_end_to_end(spark):
    lines = ["Unit 1", "1. What is one?", "more of it", "例2. What is two?", "Unit 2", "3. Three is what?", "4. x"]
    b = spark.createDataFrame([(d, i, "text", t, 0) for d in ("a", "b") for i, t in enumerate(lines)], "doc_id string, id int, type string, text string, page_idx int")
    entries = spark.createDataFrame([(d, k, [i], 1, "t") for d in ("a", "b") for k, i in enumerate((0, 4))], "doc_id string, ord int, ids array<int>, level int, title string")
    rows = extraction.extract_questions(b, RuleProvider(), chapters.flat_map(entries, b)).where("doc_id = 'a'").orderBy("seq").collect()
    assert [(r.label, r.type, r.chapter_title) for r in rows] == [("1", "exercise", "Unit 1"), ("2", "example", "Unit 1"), ("3", "exercise", "Unit 2")]
    assert rows[0].question == "1. What is one?\nmore of it"
    md = exports.markdown_text(spark.createDataFrame(rows, schema=extraction.extract_questions(b, RuleProvider()).schema)).first().markdown
    assert md.startswith("# 提取的题目\n\n**总数**: 3\n\n---\n\n## Unit 1\n\n### 1 (练习题)\n\n**题目**: 1. What is one?") and md.count("## Unit") == 2


def test_providers(spark):
    b = spark.createDataFrame([("d", 0, "text", "1. q")], "doc_id string, id int, type string, text string")
    chunks = chunking.token_chunks(b)
    assert "1. q" in chunk_prompts(chunks, b).first().prompt
    got = CallProvider(lambda p: "<empty>", workers=1).answers(chunks, b).first()
    assert (got.output, got.success) == ("<empty>", True)

    def fails(prompt):
        raise ValueError("no")

    bad = CallProvider(fails, workers=1, attempts=2).answers(chunks, b).first()
    assert (bad.output, bad.success, bad.attempt) == (None, False, 1)
    stored = spark.createDataFrame([("d", 0, 0, "old", True), ("d", 0, 1, "new", True), ("d", 0, 2, None, False)], "doc_id string, chunk_index int, attempt int, output string, success boolean")
    assert ReplayProvider(stored).answers(chunks, b).first().output == "new"


def test_rules_and_sources(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"enabled": true, "noisePatterns": ["zzz"], "structuralPatterns": ["^A"]}', encoding="utf-8")
    assert readers.title_rules(spark, str(tmp_path / "t.json")).noise == ["zzz"]
    (tmp_path / "n.json").write_text('["yyy"]', encoding="utf-8")
    assert readers.title_rules(spark, str(tmp_path / "none.json"), str(tmp_path / "n.json")).noise == ["yyy"]
    assert readers.title_rules(spark).noise == predicates.NOISE_TITLES and readers.sanity_rules(spark).min_blocks == 40
    with pytest.raises(ValueError):
        readers.read_first(spark, ["http://x/y"])
    assert {r.path.rsplit("/", 1)[-1] for r in readers.list_files(spark, str(tmp_path)).collect()} == {"t.json", "n.json"}


def test_tasks(spark):
    t = spark.createDataFrame([(1, None, None, "a", 0, 3), (2, 1, 1, "a (Retry 1)", 1, 1)], "id long, parent_task_id long, root_task_id long, name string, retry_count int, total_pages int")
    r = {x.parent_task_id: (x.name, x.root_task_id, x.retry_count) for x in tasks.retried(t).collect()}
    assert r == {1: ("a (Retry 1)", 1, 1), 2: ("a (Retry 2)", 1, 2)}
    assert tasks.page_logs_of(t).count() == 2


def test_rule_tree(spark):
    rows = [(0, "Contents"), (0, "1 Numbers 2"), (0, "2 Shapes here 4"), (0, "Unit 3 Data 6"), (0, "Review 8"), (0, "Glossary 9"), (3, "1 Numbers"), (3, "text of it"), (5, "2 Shapes here"), (7, "Unit 3 Data"), (8, "3.1 Bars"), (9, "Review")]
    b = spark.createDataFrame([("d", i, "text", t, p, None) for i, (p, t) in enumerate(rows)], "doc_id string, id int, type string, text string, page_idx int, text_level int")
    assert [r.page_idx for r in anchors.contents_pages(b).collect()] == [0]
    tree = anchors.rule_tree(b).orderBy("ord").collect()
    assert [(r.text, r.level, r.block_range.start) for r in tree][:3] == [("1 Numbers", 1, 6), ("2 Shapes here", 1, 8), ("Unit 3 Data", 1, 9)]
    assert next(r for r in tree if r.text == "3.1 Bars").parent_id == 2


def test_quick_patterns(spark):
    """The classes that every character is tried on hold the same characters as their plain forms, of all there are."""
    every = spark.range(0x110000).where("id not between 55296 and 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    plain = {text.WS: r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]", text.NO_WORD: r"[^A-Za-z0-9_\s\x{4e00}-\x{9fff}]", text.NUMERAL: "[一二三四五六七八九十百零]"}
    counts = every.agg(*[F.count_if(F.col("c").rlike(a) != F.col("c").rlike(b)) for a, b in plain.items()], F.count("*")).first()
    assert tuple(counts) == (0, 0, 0, 0x110000 - 0x800)
    assert all(not re.search(r"\\s|A-Z|a-z", p) for p in plain)  # an ASCII range or class is not in the bit set
