"""What a query does once for a table it does once: patterns over whole texts stay out of what is read several times."""

from pyspark.sql import functions as F

from pageloom.functions.text import collapse_ws, trim_plain, trim_ws, word_count
from pageloom.operators import anchors, answers, blocks as block_ops
from pageloom.plans import extraction


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def query(spark, sf, name):
    import __spark_entry__ as e

    return e.queries()[name](spark, sf)


def test_word_count_upto(spark):
    rows = spark.createDataFrame([("a b  c",), (" a　b ",), ("",), ("a b c d e",), ("a b c ",), ("  ",)], "t string")
    assert [r[0] for r in rows.select(word_count("t", 3)).collect()] == [3, 2, 0, 4, 3, 0]
    assert [r[0] for r in rows.select(word_count("t")).collect()] == [3, 2, 0, 5, 3, 0]


def test_round_acceptance_reads_entries_once(spark, sf):
    assert "split(" not in plan(query(spark, sf, "round_acceptance"))


def test_chapter_paths_by_joins_reads_the_tree_once(spark, sf):
    assert "split(" not in plan(query(spark, sf, "chapter_paths_by_joins"))


def seen_plans(monkeypatch, module, name):
    """The plans of the frames that a function is given, or gives, in the order of its calls."""
    real, plans = getattr(module, name), []

    def watched(*args, **more):
        out = real(*args, **more)
        plans.append((plan(args[0]), plan(out)))
        return out

    monkeypatch.setattr(module, name, watched)
    return plans


def test_chapters_from_answers_reads_answers_once(spark, sf, monkeypatch):
    plans = seen_plans(monkeypatch, answers, "directory_entries")
    query(spark, sf, "chapters_from_answers")
    assert len(plans) == 2 and not any("split(" in given for given, _ in plans)


def test_model_chapters_makes_outlines_once(spark, sf, monkeypatch):
    plans = seen_plans(monkeypatch, extraction, "directory_prompts")
    query(spark, sf, "model_chapters")
    assert len(plans) == 2 and not any("regexp_replace" in made for _, made in plans)


def test_outline_lines_of_long_texts(spark):
    """A line is the same whether its text is cleaned in whole or in part."""
    long = ["ab  c\t" * 300, " " * 700 + "x y " * 200, "x" * 199 + " " * 900 + "y", "x" * 200 + " " * 900, "a" * 601, "q " * 300 + "$a$", "![i](j)" + "w  " * 400, "é　" * 500]
    rows = spark.createDataFrame(list(enumerate(long)), "id int, text string").select(F.lit(1).alias("doc_id"), "id", F.lit("text").alias("type"), "text", F.lit(0).alias("page_idx"), F.lit(None).cast("int").alias("text_level"))
    got = {r.id: r.line for r in block_ops.outline_lines(rows).collect()}
    clean = [" ".join(t.replace("$a$", "[EQ]").replace("![i](j)", "[IMG]").split()) for t in long]
    assert got == {i: f"[{i}|p0] " + (c[:200] + "..." if len(c) > 200 else c) for i, c in enumerate(clean)}


def test_trims_and_spaces(spark):
    rows = spark.createDataFrame([(t,) for t in (" a b ", "a\tb", "　a　 b", "a  b\n", "", None, "   ")], "t string")
    got = rows.select(trim_plain("t").alias("p"), trim_ws("t").alias("w"), collapse_ws("t").alias("c")).collect()
    assert [r.p for r in got] == [r.w for r in got] == ["a b", "a\tb", "a　 b", "a  b", "", None, ""]
    assert [r.c for r in got] == [" a b ", "a b", " a b", "a b ", "", None, " "]


def test_contents_entries_reads_contents_pages_only(spark, sf):
    """Patterns of entries are tried on the written blocks of contents pages, and pages are found in one read."""
    made = plan(query(spark, sf, "contents_entries"))
    assert made.count("Relation [") == 1 and "Join" not in made


def test_contents_pages_reads_blocks_once(spark):
    rows = [(d, i, "text", t, i // 4, None) for d in (1, None) for i, t in enumerate(["Contents", *[f"Unit {k} Words of it {k}" for k in range(1, 7)], "Unit 7 and 8 9\x85", "so 12", "1 Title 3", "2 Title 5", "Unit x"])]
    b = spark.createDataFrame(rows, "doc_id int, id int, type string, text string, page_idx int, text_level int")
    pages = anchors.contents_pages(b)
    assert plan(pages).count("LogicalRDD") == 1
    assert sorted(map(tuple, pages.collect())) == [(1, 0), (1, 1)]  # page 2 has two entries, a page that follows needs three
    want = "(?i)" + "|".join(f"(?:{p})" for p in anchors.ENTRY_ANY_CASE) + "|(?-i:" + "|".join(anchors.ENTRY_WITH_CASE) + ")"
    assert [r[0] for r in b.where("doc_id = 1").orderBy("id").select(F.col("text").rlike(want)).collect()] == [r[0] for r in b.where("doc_id = 1").orderBy("id").select(anchors.is_entry("text")).collect()]


def test_answers_are_spread(spark, sf, monkeypatch):
    """Short answers are parsed by as many tasks as there are cores, not in one for their few bytes."""
    plans = []
    real = answers.parse_answers
    monkeypatch.setattr(answers, "parse_answers", lambda raw: (plans.append(len(raw.inputFiles())), real(raw))[1])
    query(spark, sf, "extract_questions")
    assert plans and min(plans) >= 4


def test_id_list(spark):
    rows = spark.createDataFrame([("1, 2",), ("",), (None,), ("3,,x, +4b,-5 ",), (" ",)], "t string")
    assert [r[0] for r in rows.select(answers.id_list(F.col("t"))).collect()] == [[1, 2], [None], [None], [3, None, None, 4, -5], [None]]


def test_signals_are_taken_as_rows(spark):
    """A state is kept row by row: no frame is made for each task."""
    from pyspark.sql import Row
    from datetime import datetime

    from pageloom.streaming.signals import SignalState

    class Value:
        state = None
        exists = lambda self: self.state is not None
        get = lambda self: self.state
        update = lambda self, x: setattr(self, "state", x)
        clear = lambda self: setattr(self, "state", None)

    class Handle:
        listTimers = lambda self: iter(())  # noqa: E731, N815

    one = SignalState(1000)
    one.handle, one.value = Handle(), Value()
    at = [datetime(2024, 1, 1, 0, 0, k) for k in range(3)]
    rows = [Row(task_id=7, signal="pause", sent_at=at[2]), Row(task_id=7, signal="register", sent_at=at[1]), Row(task_id=7, signal="resume", sent_at=at[0])]
    assert list(one.handleInputRows((7,), iter(rows), None)) == [Row(task_id=7, state="paused", paused_at=at[2], cancelled_at=None)]
