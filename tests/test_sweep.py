"""Chapters of points by a sweep, against a plain search."""

import random

from pageloom.operators import chapters

CHAPTER = "doc_id string, ord int, level int, text string, block_range struct<start:int,end:int>"


def plain(at, own):
    held = [c for c in own if at is not None and c[4][0] <= at < c[4][1]]
    return min(held, key=lambda c: (-c[2], c[1]))[3] if held else None


def check(spark, rows, ids):
    points = spark.createDataFrame([(d, i, f"p{i}") for d in {r[0] for r in rows} | {"none"} for i in ids], "doc_id string, id int, note string")
    got = chapters.chapter_of(points, spark.createDataFrame(rows, CHAPTER), value="text")
    assert got.columns == ["doc_id", "id", "note", "text"]
    want = sorted(repr((d, i, f"p{i}", plain(i, [r for r in rows if r[0] == d]))) for d in {r[0] for r in rows} | {"none"} for i in ids)
    assert want == sorted(repr(tuple(r)) for r in got.collect())


def test_trees(spark):
    """Ranges of one level follow each other; deeper ones lie within."""
    rnd, rows = random.Random(2), []
    for d in "abc":
        starts = sorted(rnd.sample(range(200), 30))
        levels = [rnd.randint(1, 4) for _ in starts]
        for i, (s, level) in enumerate(zip(starts, levels)):
            end = next((t for t, k in zip(starts[i + 1 :], levels[i + 1 :]) if k <= level), 200)
            rows.append((d, i, level, f"{d}{i}", (s, end)))
    check(spark, rows, [None, *range(-2, 205)])


def test_tangled_ranges(spark):
    """Any ranges: overlapping in one level, equal, empty, the wrong way round, out of order, of levels beyond the usual."""
    rnd = random.Random(3)
    rows = [(d, i, rnd.randint(0, 6), f"{d}{i}", (s := rnd.randint(0, 60), s + rnd.randint(-3, 25))) for d in "abcde" for i in range(25)]
    check(spark, rows, [None, *range(-2, 95)])


def test_rows_through_the_shuffle(spark):
    """Two nested chapters of a million blocks each and three points: five rows are sorted, not two million."""
    rows = [("a", 0, 1, "top", (0, 1_000_000)), ("a", 1, 2, "in", (0, 1_000_000))]
    got = chapters.chapter_of(spark.createDataFrame([("a", i) for i in (0, 999_999, 1_000_000)], "doc_id string, id int"), spark.createDataFrame(rows, CHAPTER), value="text")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert {r.id: r.text for r in got.collect()} == {0: "in", 999_999: "in", 1_000_000: None}
    assert "sequence(cast(block_range" not in plan and "Generate explode(sequence(block_range" not in plan
