"""Flows around a model, sinks, control and paths."""

import random
import time

import pytest
from pyspark.sql import functions as F

from pageloom.operators import answers, chapters, questions, tasks, text_diff
from pageloom.plans import extraction
from pageloom.plans.providers import CallProvider, ReplayProvider, RuleProvider, chunk_prompts, directory_prompts
from pageloom.session import stored
from pageloom.sources import readers
from pageloom.streaming import live

BLOCK = "doc_id string, id int, type string, text string, page_idx int, text_level int"
ANSWER = "doc_id string, chunk_index int, attempt int, output string, success boolean"


def pairs(*ids):
    return "<chapter><title></title>" + "".join(f"<qa_pair><label>{i}</label><type>exercise</type><question>{i}</question><solution></solution></qa_pair>" for i in ids) + "</chapter>"


def test_asked_until_sane(spark, tmp_path):
    """Empty answers where labels are seen and missing ones are asked again; the last attempt is taken as it is."""
    blocks = spark.createDataFrame([(d, i, "text", f"{i + 1}. question" if i < 2 else "rest", 0, None) for d in "abcd" for i in range(3)], BLOCK)
    rows = [("a", 0, 0, pairs(0), True), ("b", 0, 0, "<empty></empty>", True), ("b", 0, 1, pairs(0, 1), True), ("c", 0, 0, None, False), ("c", 0, 1, "<empty></empty>", True), ("c", 0, 2, pairs(1), True), ("c", 0, 3, pairs(0, 1), True)]
    rows += [("d", 0, k, "<empty></empty>", True) for k in range(4)]
    seen = []
    settings = extraction.Settings(delays=(), debug=str(tmp_path / "debug"), point=lambda: seen.append(1))
    got = extraction.extract_questions(blocks, ReplayProvider(spark.createDataFrame(rows, ANSWER)), settings=settings)
    assert sorted((r.doc_id, r.question_ids) for r in got.collect()) == [("a", "0"), ("b", "0"), ("b", "1"), ("c", "1")]
    assert len(seen) == 4
    verdicts = [{r.doc_id: r.verdict for r in spark.read.parquet(str(tmp_path / "debug" / f"verdicts-{k}")).collect()} for k in range(4)]
    assert verdicts == [{"a": "ok", "b": "zero_output", "c": "no_answer", "d": "zero_output"}, {"b": "ok", "c": "zero_output", "d": "zero_output"}, {"c": "ok", "d": "zero_output"}, {"d": "zero_output"}]
    assert spark.read.parquet(str(tmp_path / "debug" / "raw-1")).count() == 3 and spark.read.parquet(str(tmp_path / "debug" / "formatted_blocks")).count() == 12


def test_call_provider_backs_off(spark):
    began = time.time()
    got = CallProvider(lambda p: 1 / 0, workers=1, attempts=3, delays=(0.2, 0.4)).complete(spark.createDataFrame([("a", 0, "p")], "doc_id string, chunk_index int, prompt string")).collect()
    assert [(r.output, r.attempt, r.success) for r in got] == [(None, 2, False)] and "zero" in got[0].error and time.time() - began >= 0.6


def directory(*entries):
    return '{"directory": [' + ", ".join(f'{{"id": {i}, "level": {k}, "title": "{t}"}}' for i, k, t in entries) + "]}"


def test_model_chapters_in_parts(spark):
    """A long document goes part by part: local ids, a second round judged part by part, parts without entries not asked."""
    texts = {0: "Chapter 1 Alpha", 30: "Section 1.1 Beta", 45: "Section 1.2 Gamma", 80: "Chapter 2 Delta"}
    blocks = spark.createDataFrame([("long", i, "text", texts.get(i, "w " * 100), i // 10, None) for i in range(100)] + [("short", i, "text", "Unit 1 Start" if i == 0 else "body text", 0, None) for i in range(5)], BLOCK)
    parts = {(r.doc_id, r.chunk_index): (r.start_id, r.end_id, r.mode) for r in extraction.outline_parts(blocks, 7500).collect()}
    assert parts["short", 0] == (0, 4, "whole") and parts["long", 0][0] == 0 and len(parts) >= 3 and {m for (d, _), (_, _, m) in parts.items() if d == "long"} == {"chunked"}
    second = next(s for (d, k), (s, e, _) in parts.items() if d == "long" and s <= 80 <= e and not s <= 30)
    n = max(k for d, k in parts if d == "long") + 1
    first = {k: [] for k in range(n)}
    for i in texts:
        for k in range(n):
            s, e, _ = parts["long", k]
            if s <= i <= e:
                first[k].append((i, 1 if i in (0, 80) else 2, texts[i]))
    rows = [("long", k, 0, directory(*first[k]) if k else "not json", True) for k in range(n)] + [("long", 0, 1, directory(*first[0]), True), ("short", 0, 0, directory((0, 1, "Unit 1 Start")), True)]
    replies = [("long", k, 0, directory(*(first[k][:0] if k == 0 else first[k])), True) for k in range(n)]  # the first part's check loses all: its entries stay
    tree = extraction.model_chapters(blocks, ReplayProvider(spark.createDataFrame(rows, ANSWER)), ReplayProvider(spark.createDataFrame(replies, ANSWER)), context=7500)
    got = sorted((r.doc_id, r.id, r.text, r.level, r.parent_id) for r in tree.collect())
    assert got == [("long", 0, texts[0], 1, None), ("long", 30, texts[30], 2, got[0][1] if got[1][4] == got[0][1] else got[1][4]), ("long", 45, texts[45], 2, got[1][4]), ("long", 80, texts[80], 1, None), ("short", 0, "Unit 1 Start", 1, None)]
    assert second > 30
    prompts = directory_prompts(spark.createDataFrame([("short", 0, 0, 4)], "doc_id string, chunk_index int, start_id int, end_id int"), blocks).collect()
    assert prompts[0].prompt.endswith("[0|p0] Unit 1 Start\n[1|p0] body text\n[2|p0] body text\n[3|p0] body text\n[4|p0] body text")


def test_greedy_keep_equals_plain_fold():
    def plain(sets, threshold):
        kept = []
        for i, s in enumerate(sets):
            for at, j in enumerate(kept if s else []):
                both = len(s & sets[j])
                if sets[j] and both / (len(s) + len(sets[j]) - both) >= threshold:
                    if len(s) > len(sets[j]):
                        kept[at] = i
                    break
            else:
                kept.append(i)
        return kept

    rnd = random.Random(7)
    for _ in range(400):
        sets = [set(rnd.sample(range(12), rnd.randint(0, 5))) for _ in range(rnd.randint(0, 14))]
        assert questions.greedy_keep(sets, 0.5) == plain(sets, 0.5)


def test_line_diff(spark):
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = row[:]
            for j, y in enumerate(b):
                row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
        return row[-1]

    rnd = random.Random(8)
    rows = [(i, "\n".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 90))), "\n".join(rnd.choice("abcde") for _ in range(rnd.randint(0, 90)))) for i in range(40)] + [(98, None, "x"), (99, "x\n" * 3000, "y\n" + "x\n" * 3000)]
    for r in text_diff.line_diff(spark.createDataFrame(rows, "doc_id long, a string, b string")).collect():
        a, b = next(((a or "").split("\n"), (b or "").split("\n")) for i, a, b in rows if i == r.doc_id)
        same = r.same if r.doc_id == 99 else lcs(a, b)
        assert (r.same, r.added, r.removed) == (same, len(b) - same, len(a) - same) and (r.doc_id != 99 or r.added == 1)


def test_roots_of_a_ring(spark):
    t = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3)], "id long, parent_task_id long")
    assert sorted(map(tuple, tasks.roots(t).collect())) == [(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 1, 3)]
    with pytest.raises(ValueError):
        tasks.roots(t.union(spark.createDataFrame([(5, 6), (6, 7), (7, 5)], t.schema))).collect()


def test_progress_sink(spark, tmp_path):
    from datetime import datetime

    rows = [(1, "info", "processing", 0, 4, m, datetime(2024, 1, 1, 0, i)) for i, m in enumerate(("Processing chunk 0", "Chunk 0 completed", "Chunk 1 completed"))]
    spark.createDataFrame(rows, live.LOGS).coalesce(1).write.parquet(str(tmp_path / "logs"))
    stream = live.log_stream(spark, str(tmp_path / "logs"))
    q = live.start_progress(stream, str(tmp_path / "out"), str(tmp_path / "c"), "progress", 0)
    q.processAllAvailable()
    q.stop()
    got = live.progress_table(spark, str(tmp_path / "out")).read().collect()
    assert [(r.task_id, r.percent, r.message, r.total, r.completed) for r in got] == [(1, 50, "Chunk 1 completed", 4, 2)]


def test_task_control(spark, tmp_path):
    spark.range(3).selectExpr("id as task_id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("task_id long").parquet(str(tmp_path / "in"))
    start = lambda: stream.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).queryName("task-5").start()
    with live.TaskControl(spark, 5, start, poll=0.01) as control:
        control.query.processAllAvailable()
        assert control.pause() and not control.pause() and control.query is None
        spark.range(3, 5).selectExpr("id as task_id").write.mode("append").parquet(str(tmp_path / "in"))
        assert control.resume() and not control.resume()
        control.query.processAllAvailable()
        assert spark.read.parquet(str(tmp_path / "o")).count() == 5
        control.point()
        control.cancel()
        with pytest.raises(live.Cancelled):
            control.point()
    assert not [q for q in spark.streams.active if q.name == "task-5"]


def test_paths(spark, tmp_path):
    assert readers.candidate_paths("/data/uploads/t/a.md", ["/r"]) == ["/r/uploads/t/a.md", "/r/data/uploads/t/a.md", "/r/uploads/data/uploads/t/a.md", "/data/uploads/t/a.md"]
    assert readers.candidate_paths("t/a.md", ["/r/", "s3a://b"]) == ["/r/t/a.md", "s3a://b/t/a.md", "/r/uploads/t/a.md", "s3a://b/uploads/t/a.md"]
    with pytest.raises(ValueError):
        readers.read_first(spark, readers.candidate_paths("https://x/a.md", []))
    (tmp_path / "uploads" / "f" / "results").mkdir(parents=True)
    (tmp_path / "uploads" / "f" / "results" / "questions.md").write_text("found")
    where = readers.result_candidates("/no/such/file", "f", "questions.md", [str(tmp_path)])
    assert readers.result_text(spark, where).first()[0] == "found"
    assert readers.result_text(spark, ["/no/such/file"], lambda: "fetched").first()[0] == "fetched" and readers.result_text(spark, ["/no/such/file"]) is None


def test_preset_of_any_address(spark):
    """Against plain containment; short and empty addresses, and the catalog's order, count."""
    records = [{"id": f"p{i}", "base_url": b, "models": []} for i, b in enumerate(["api.one.com/v1", "one", "two.net", "x"])]
    urls = ["https://api.one.com/v1/chat", "http://one.org", "http://two.net/", "zzz", None, "", "x", "http://TWO.net"]
    got = {r.id: r.preset_id for r in readers.preset_of_url(spark.createDataFrame(list(enumerate(urls)), "id int, api_url string"), readers.presets(spark, records)).collect()}
    assert got == {i: next((r["id"] for r in records if u is not None and r["base_url"] in u), None) for i, u in enumerate(urls)}


def test_preset_of_few_and_many(spark):
    """Few presets need no shuffle; many meet by keys, with the same result."""
    urls = [f"http://api{i}.net/v{i % 3}" for i in range(90)] + ["", None, "api", "zzz"]
    df = spark.createDataFrame(list(enumerate(urls)), "id int, api_url string")
    for n in (0, 3, readers.FEW, 90):
        records = [{"id": f"p{i}", "base_url": f"api{i}.net" if i % 9 else f"/v{i % 2}", "models": []} for i in range(n)]
        found = readers.preset_of_url(df, readers.presets(spark, records))
        assert found.columns == ["api_url", "id", "preset_id"]
        assert {r.id: r.preset_id for r in found.collect()} == {i: next((r["id"] for r in records if u is not None and r["base_url"] in u), None) for i, u in enumerate(urls)}
        assert n > readers.FEW or "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_chapters_and_prompts_stay_small(spark):
    """Stored tables keep types; prompts hold only their chunk's blocks."""
    blocks = stored(spark.createDataFrame([("a", i, "text", f"t{i}", 0, None) for i in range(6)], BLOCK), "b")
    chunks = spark.createDataFrame([("a", 0, 0, 2), ("a", 1, 2, 5)], "doc_id string, chunk_index int, start_id int, end_id int")
    got = {r.chunk_index: r.prompt for r in chunk_prompts(chunks, blocks).collect()}
    assert "t0" in got[0] and "t3" not in got[0] and "t2" in got[1] and "t1" not in got[1]
    entries = spark.createDataFrame([("a", 0, [1], 1, "x"), ("a", 1, [9], 1, "y")], "doc_id string, ord int, ids array<int>, level int, title string")
    assert [tuple(r) for r in chapters.unknown_ids(entries, blocks).collect()] == [("a", 9)]
    assert answers.parse_legacy(spark.createDataFrame([("a", 0, "<chapter><title>1</title><qa_pair><label>1</label><answer>B</answer></qa_pair></chapter>"), ("a", 1, None)], "doc_id string, chunk_index int, output string")).where(F.col("error").isNull()).collect()[0].answer == "B"


class Scanner:
    """Names the same two headings whatever window it is shown, and keeps what it was asked."""

    def complete(self, prompts, attempt=None):
        said = 'Sure: {"headings": [{"block_id": 4, "title": "Early", "level": 1}, {"block_id": 70, "title": "Late", "level": 2}]}'
        return prompts.select("doc_id", "chunk_index", F.lit(said).alias("output"), F.col("prompt"))


def test_scanner_finds_missed_headings(spark):
    """Only pages far from a sure heading are shown, and only headings of their window count."""
    rows = [("a", i, "text", "plain words" if i != 40 else "Chapter 2 Middle", i // 2, None) for i in range(80)]
    blocks = spark.createDataFrame(rows, BLOCK)
    plain = [(r.block_range.start, r.text) for r in extraction.rule_chapters(blocks).collect()]
    assert plain == [(40, "Chapter 2 Middle")]
    got = sorted((r.block_range.start, r.block_range.end, r.text, r.level, r.parent_id) for r in extraction.rule_chapters(blocks, Scanner()).collect())
    assert got == [(4, 40, "Early", 1, None), (40, 80, "Chapter 2 Middle", 1, None), (70, 80, "Late", 2, 1)]


def test_stored_tables_end_with_their_scope(spark, tmp_path, monkeypatch):
    """A flow leaves its result and nothing else, also where it fails; without a scope tables stay."""
    import os
    import uuid

    from pageloom.session import scope

    (tmp_path / "shared").mkdir()
    monkeypatch.setattr("pageloom.session.scratch_path", lambda spark, label: str(tmp_path / "shared" / f"{label}-{uuid.uuid4().hex}"))
    here = lambda: set(os.listdir(tmp_path / "shared"))
    before = here()
    rows = [("a", i, "text", f"{i}. question" if i % 3 == 0 else "more words", 0, None) for i in range(30)]
    blocks = spark.createDataFrame(rows, BLOCK)
    extraction.write_questions(blocks, RuleProvider(), str(tmp_path / "out"), extraction.rule_chapters)
    assert here() == before and spark.read.parquet(str(tmp_path / "out")).count() == 10
    with pytest.raises(ZeroDivisionError), scope(spark) as paths:
        with scope(spark):
            stored(spark.range(3), "inner")
        kept = stored(spark.range(3), "outer")
        assert kept.count() == 3 and len(paths) == 1 and len(here()) == len(before) + 1
        1 / 0
    assert here() == before


def test_call_options(spark):
    from pageloom.plans.providers import EXTRACTION

    def ask(prompt, temperature, max_tokens, timeout):
        return f"{prompt} {temperature} {max_tokens} {timeout}"

    got = CallProvider(ask, options=EXTRACTION).complete(spark.createDataFrame([("a", 0, "p")], "doc_id string, chunk_index int, prompt string")).collect()
    assert got[0].output == "p 0.1 4000 60"
