"""Chapter trees: entries, ranges, parents, paths, coverage and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.predicates import TitleRules, cleanup_reason
from pageloom.functions.text import TITLE_LIMIT
from pageloom.session import stored

LEVELS = 4


def first_wins(entries: DataFrame) -> DataFrame:
    """One entry for each primary id, the first in order."""
    w = Window.partitionBy("doc_id", F.col("ids")[0]).orderBy("ord")
    return entries.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def map_local_ids(entries: DataFrame, blocks: DataFrame, offered: DataFrame | None = None) -> DataFrame:
    """Entries with known ids; unknown ones are read as places among the offered blocks (doc_id, id), if these are given."""
    flat = entries.withColumn("_k", F.monotonically_increasing_id()).select("*", F.posexplode("ids").alias("at", "raw"))
    known = blocks.select("doc_id", F.col("id").alias("raw")).distinct().withColumn("hit", F.col("raw"))
    flat = flat.join(known, ["doc_id", "raw"], "left")
    if offered is not None:
        place = offered.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("id")) - 1).alias("raw"), F.col("id").alias("local"))
        flat = flat.join(place, ["doc_id", "raw"], "left").withColumn("hit", F.coalesce("hit", "local"))
    keep = [c for c in entries.columns if c != "ids"]
    got = flat.where("hit is not null").groupBy("_k", *keep).agg(F.sort_array(F.collect_list(F.struct("at", "hit"))).alias("x"))
    return got.select(*keep, F.col("x.hit").alias("ids"))


def drifted(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_ids whose entries number from zero though the valid ids are large."""
    e = entries.groupBy("doc_id").agg(F.max(F.col("ids")[0]).alias("hi"), F.min(F.col("ids")[0]).alias("lo"))
    b = blocks.groupBy("doc_id").agg(F.min("id").alias("least"))
    return e.join(b, "doc_id").where("(hi < 100 and least > 1000) or (lo = 0 and hi < 100 and least > 500)").select("doc_id")


def cleaned(entries: DataFrame, blocks: DataFrame, rules: TitleRules = TitleRules()) -> DataFrame:
    """entries with the reason for which one goes (null: it stays), judged by its block's text or else its title."""
    texts = blocks.select("doc_id", F.col("id").alias("_pid"), F.col("text").alias("_text"))
    rows = entries.withColumn("_pid", F.col("ids")[0]).join(texts, ["doc_id", "_pid"], "left")
    return rows.withColumn("reason", cleanup_reason(F.col("_text"), F.col("title"), rules)).drop("_pid", "_text")


def accept_second(first: DataFrame, second: DataFrame, share: float = 0.8) -> DataFrame:
    """The second round's entries for documents where it has that share of the first's at least, else the first's."""
    a = first.groupBy("doc_id").agg(F.count("*").alias("n1"))
    b = second.groupBy("doc_id").agg(F.count("*").alias("n2"))
    good = a.join(b, "doc_id").where(F.col("n2") >= share * F.col("n1")).select("doc_id")
    return second.join(good, "doc_id", "left_semi").unionByName(first.join(good, "doc_id", "left_anti"))


def _above(order, *fields: str) -> list[Column]:
    """The last entry before this one at each level but the lowest, as a struct that begins with its place."""
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return [F.last(F.when(F.col("level") == k, F.struct("ord", *fields)), ignorenulls=True).over(before) for k in range(1, LEVELS)]


def _ancestors() -> Column:
    """Of the entries _up1.._up3 those above this one, from the top: each comes later than all of higher levels."""
    ups = [F.when(F.col("level") > k, F.col(f"_up{k}")) for k in range(1, LEVELS)]
    kept = []
    for k, up in enumerate(ups):
        late = up.isNotNull()
        for other in ups[:k]:
            late = late & (other.isNull() | (up["ord"] > other["ord"]))
        kept.append(F.when(late, up))
    return F.filter(F.array(*kept), lambda x: x.isNotNull())


def with_tree(entries: DataFrame) -> DataFrame:
    """entries (doc_id, ord, id, level, text) with parent_id and path, in one window: no join, whatever the depth."""
    order = Window.partitionBy("doc_id").orderBy("ord")
    rows = entries
    for k, up in enumerate(_above(order, "id", "text"), 1):
        rows = rows.withColumn(f"_up{k}", up)
    rows = rows.withColumn("_chain", _ancestors())
    rows = rows.withColumn("parent_id", F.get("_chain", F.size("_chain") - 1)["id"])
    return rows.withColumn("path", F.array_join(F.concat(F.col("_chain.text"), F.array("text")), " > ")).drop("_chain", *[f"_up{k}" for k in range(1, LEVELS)])


def flat_map(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, ord, id, merged_ids, text, level, page, block_range, parent_id, path): the chapter tree in the entries' order."""
    order = Window.partitionBy("doc_id").orderBy("ord")
    total = blocks.groupBy("doc_id").agg(F.count("*").cast("int").alias("total"))
    b = blocks.select("doc_id", F.col("id").alias("_bid"), F.substring(F.coalesce("text", F.lit("")), 1, TITLE_LIMIT).alias("_text"), F.coalesce("page_idx", F.lit(0)).alias("_page"))
    texts = entries.select("doc_id", "ord", F.posexplode("ids").alias("at", "_bid")).join(b, ["doc_id", "_bid"])
    texts = texts.groupBy("doc_id", "ord").agg(F.sort_array(F.collect_list(F.struct("at", "_text", "_page"))).alias("x"))
    rows = entries.withColumn("id", F.col("ids")[0]).join(total, "doc_id", "left").join(texts, ["doc_id", "ord"], "left")
    merged = F.array_join(F.filter(F.col("x._text"), lambda t: t != ""), " ")
    page = F.aggregate("x", F.lit(0), lambda acc, x: F.when(x["at"] == 0, x["_page"]).otherwise(acc))
    start, following = F.array_min("ids"), F.lead(F.array_min("ids")).over(order)
    end = F.when(following.isNull(), F.coalesce("total", F.lit(0))).when(start >= following, start + 1).otherwise(following)
    rows = rows.select(
        "doc_id", "ord", "id", F.when(F.size("ids") > 1, F.col("ids")).alias("merged_ids"),
        F.when(F.coalesce(merged, F.lit("")) != "", merged).otherwise(F.col("title")).alias("text"), "level", F.coalesce(page, F.lit(0)).alias("page"),
        F.struct(start.alias("start"), end.alias("end")).alias("block_range"),
    )
    return with_tree(rows)


def chapter_paths(chapters: DataFrame) -> DataFrame:
    """chapters with ``path``: texts from the top down, joined by ' > '.

    Trees of this module bring it along. A tree that has only parent pointers is written once, and joins climb it level by level.
    """
    if "path" in chapters.columns:
        return chapters
    chapters = stored(chapters, "chapters")
    out = chapters.withColumn("path", F.col("text")).withColumn("_up", F.col("parent_id"))
    for _ in range(LEVELS - 1):
        first = Window.partitionBy("doc_id", "id").orderBy("ord")
        up = chapters.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("doc_id", F.col("id").alias("_up"), F.col("text").alias("_t"), F.col("parent_id").alias("_next"))
        out = out.join(up, ["doc_id", "_up"], "left")
        out = out.withColumn("path", F.when(F.col("_t").isNotNull(), F.concat("_t", F.lit(" > "), "path")).otherwise(F.col("path"))).withColumn("_up", F.col("_next")).drop("_t", "_next")
    return out.drop("_up")


def disjoint(ranges: DataFrame) -> DataFrame:
    """(doc_id, tier, s, e, v) of ranges (doc_id, tier, s, e, level, ord, v): no two of a tier overlap.

    Ranges that don't overlap stay as they are, as those of one level of a tree do. Where some of a document's tier
    overlap, its line is cut at all of their ends, and each part goes to the deepest range that covers it (ties: the
    first in order). The ranges are written once, as both kinds are read from them.
    """
    tier, order = Window.partitionBy("doc_id", "tier"), Window.partitionBy("doc_id", "tier").orderBy("s", "ord")
    met = F.coalesce(F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)) > F.col("s"), F.lit(False))
    flagged = stored(ranges.withColumn("_met", met).withColumn("_tangled", F.bool_or("_met").over(tier)).drop("_met"), "ranges")
    plain = flagged.where("not _tangled").select("doc_id", "tier", "s", "e", "v")
    if flagged.where("_tangled").isEmpty():
        return plain
    tangled = flagged.where("_tangled").select("doc_id", "tier", "s", "e", F.struct((-F.col("level")).alias("l"), "ord", "v").alias("c"))
    ends = tangled.select("doc_id", "tier", F.explode(F.array("s", "e")).alias("at")).distinct()
    line = Window.partitionBy("doc_id", "tier").orderBy("at")
    ends = ends.select("doc_id", "tier", "at", F.lead("at").over(line).alias("next"), F.row_number().over(line).alias("k"))
    spans = tangled.join(ends.select("doc_id", "tier", F.col("at").alias("s"), F.col("k").alias("ks")), ["doc_id", "tier", "s"])
    spans = spans.join(ends.select("doc_id", "tier", F.col("at").alias("e"), F.col("k").alias("ke")), ["doc_id", "tier", "e"])
    best = spans.select("doc_id", "tier", "c", F.explode(F.sequence("ks", F.col("ke") - 1)).alias("k")).groupBy("doc_id", "tier", "k").agg(F.min("c").alias("c"))
    return plain.unionByName(best.join(ends, ["doc_id", "tier", "k"]).select("doc_id", "tier", F.col("at").alias("s"), F.col("next").alias("e"), F.col("c.v").alias("v")))


def chapter_of(points: DataFrame, chapters: DataFrame, id_col: str = "id", value: str = "path") -> DataFrame:
    """points (doc_id, id) with the ``value`` of the deepest chapter whose range holds the id, the first in order on ties.

    A sweep: the starts of ranges and the points in one sorted union for each document, where the open range of each
    level is the last one that began, if it goes on. One row for each point and for each chapter is shuffled, however
    long the ranges are.
    """
    tier = F.least(F.greatest(F.coalesce("level", F.lit(0)), F.lit(0)), F.lit(LEVELS + 1))
    ranges = chapters.where("block_range.start < block_range.end").select("doc_id", tier.alias("tier"), F.col("block_range.start").alias("s"), F.col("block_range.end").alias("e"), F.coalesce("level", F.lit(0)).alias("level"), "ord", F.col(value).alias("v"))
    begun = disjoint(ranges).select("doc_id", F.col("s").cast("long").alias("_at"), F.lit(0).alias("_kind"), "tier", F.struct("e", "v").alias("c"), F.lit(None).cast(points.select(F.struct(*points.columns)).schema[0].dataType).alias("_row"))
    asked = points.select("doc_id", F.col(id_col).cast("long").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("tier"), F.lit(None).cast(begun.schema["c"].dataType).alias("c"), F.struct(*points.columns).alias("_row"))
    swept = Window.partitionBy("doc_id").orderBy(F.asc_nulls_first("_at"), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    open_ = [F.last(F.when(F.col("tier") == k, F.col("c")), ignorenulls=True).over(swept) for k in range(LEVELS + 2)]
    rows = begun.unionByName(asked)
    for k, last in enumerate(open_):
        rows = rows.withColumn(f"_open{k}", last)
    found = F.coalesce(*[F.when(F.col(f"_open{k}.e") > F.col("_at"), F.struct(F.col(f"_open{k}.v").alias("v"))) for k in reversed(range(LEVELS + 2))])
    return rows.where("_kind = 1").select(*[F.col(f"_row.{c}").alias(c) for c in points.columns], found["v"].alias(value))


def entries_in_chunk(entries: DataFrame, members: DataFrame) -> DataFrame:
    """entries whose primary id is among the chunk's blocks (doc_id, id)."""
    m = members.select("doc_id", F.col("id").alias("_pid")).distinct()
    return entries.withColumn("_pid", F.col("ids")[0]).join(m, ["doc_id", "_pid"], "left_semi").drop("_pid")


def coverage(chapters: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, covered, uncovered, coverage_rate); intervals are merged by a running end, nothing is spread out."""
    total = blocks.groupBy("doc_id").agg(F.count("*").alias("total"))
    order = Window.partitionBy("doc_id").orderBy("s", "e")
    r = chapters.select("doc_id", F.col("block_range.start").alias("s"), F.col("block_range.end").alias("e")).where("s < e")
    reach = F.coalesce(F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("s"))
    r = r.withColumn("new", F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s"), reach)))
    agg = r.groupBy("doc_id").agg(F.sum("new").alias("covered"))
    first = chapters.groupBy("doc_id").agg(F.min("block_range.start").alias("first"))
    rows = total.join(first, "doc_id", "left").join(agg, "doc_id", "left")
    covered, relevant = F.coalesce("covered", F.lit(0)), F.col("total") - F.col("first")
    uncovered = F.when(F.col("first").isNull(), F.col("total")).otherwise(F.greatest(F.lit(0), relevant - covered))
    rate = F.when(F.col("first").isNull(), 0.0).when(relevant > 0, (relevant - uncovered) / relevant).otherwise(1.0)
    return rows.select("doc_id", covered.cast("long").alias("covered"), uncovered.cast("long").alias("uncovered"), rate.cast("double").alias("coverage_rate"))


def coverage_of_all(chapters: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, coverage_rate): the share of all of a document's blocks that lie in some chapter."""
    total = blocks.groupBy("doc_id").agg(F.count("*").alias("total"))
    rows = coverage(chapters, blocks).join(total, "doc_id")
    return rows.select("doc_id", (F.col("covered") / F.col("total")).alias("coverage_rate"))


def unknown_ids(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, id): ids of entries that no block has."""
    return entries.select("doc_id", F.explode("ids").alias("id")).join(blocks.select("doc_id", "id"), ["doc_id", "id"], "left_anti")


def validation(entries: DataFrame, blocks: DataFrame, max_top_share: float = 0.5, max_entry_share: float = 0.25) -> DataFrame:
    """(doc_id, verdict): ok, unknown_id, bad_level, many_top_level or many_entries; the first that holds."""
    unknown = unknown_ids(entries, blocks).groupBy("doc_id").agg(F.count("*").alias("bad"))
    total = blocks.groupBy("doc_id").agg(F.count("*").alias("total"))
    stats = entries.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("level") == 1).alias("top"), F.count_if(F.col("level").isNull() | ~F.col("level").between(1, LEVELS)).alias("odd"))
    rows = stats.join(total, "doc_id", "left").join(unknown, "doc_id", "left")
    verdict = (
        F.when(F.coalesce("bad", F.lit(0)) > 0, "unknown_id").when(F.col("odd") > 0, "bad_level")
        .when((F.col("n") > 20) & (F.col("top") / F.col("n") > max_top_share), "many_top_level")
        .when((F.col("total") > 100) & (F.col("n") / F.col("total") > max_entry_share), "many_entries").otherwise("ok")
    )
    return rows.select("doc_id", verdict.alias("verdict"))
