"""Chapter trees by rules alone: contents pages, heading patterns, anchors and gaps between them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pageloom.functions.predicates import any_at_start, any_of, noisy_heading
from pageloom.functions.text import normal_title, split_digit_capital, trim_ws
from pageloom.operators.chapters import with_tree
from pageloom.operators.similarity import containing_pairs, much_alike, number_pairs, similar_pairs
from pageloom.session import stored

#: Pages of a document whose entries and blocks are met in one place.
SPAN = 64
FOUND = pa.struct([("s", pa.float64()), ("o", pa.int64()), ("page", pa.int64())])
#: The white space at which words are split, as Java's class has it.
SPACES = re.compile(r"[ \t\n\x0b\f\r]+")
#: What the rules read of a block.
TREE_COLUMNS = ["doc_id", "id", "type", "text", "page_idx", "text_level"]

# What marks contents pages, their entries, imprints and front matter.
CONTENTS_MARK = r"(?i)^(contents|table\s+of\s+contents|目录|content)$"
ENTRY_WITH_CASE = [r"^\d+[.\s][A-Z].{2,78}\s+\d{1,4}\s*$", r"^[A-Z].{2,78}\.{2,}\s*\d{1,4}\s*$", r"^\d+[.\s][A-Z].{2,78}\.{2,}\s*\d{1,4}\s*$"]
ENTRY_ANY_CASE = [r"^(Chapter|Unit|Part|Topic|Section|Lesson)\s+.{1,60}\s+\d{1,4}\s*$", r"^(Past paper|Review|Practice|Glossary|Index|Appendix).{0,60}\s+\d{1,4}\s*$"]
IMPRINT = ["published", "edition", "ISBN", "copyright", "Cambridge University Press", "Printed in", "catalogue", "Assessment", r"^\d+\s+\d+\s+\d+"]
IMPRINT_MORE = [r"www\.", r"\.org", "Paperback", "Digital", "eBook", "NOTICE", "licence", "Printing House", "Liberty Plaza", "Williamstown", "Penang Road", "Jasola", "Singapore"]
FRONT_MATTER = [r"^introduction(\s+[ivxlcdm]+)?$", r"^how\s+to\s+use", "^acknowledgement", "^preface$", "^foreword$", r"^about\s+(this|the)", r"^(note|key)\s+to", r"^unit\s*$"]
# Fixed values: (level, confidence, pattern) of headings; the first that fits counts.
HEADINGS = [
    (1, 0.95, r"(?i)^Chapter\s+\d"), (1, 0.95, r"(?i)^Unit\s+\d"), (1, 0.90, r"(?i)^(Part|Module)\s+\d"), (1, 0.90, r"(?i)^Topic\s+\d"),
    (1, 0.88, r"(?i)^(CHAPTER|UNIT|PART|MODULE|TOPIC)\s+\d"), (1, 0.95, r"^第[一二三四五六七八九十百千\d]+[章篇部]"),
    (2, 0.85, r"^(\d+)\.(\d+)\s+[A-Z]"), (2, 0.85, r"(?i)^Section\s+(\d+)"), (2, 0.85, r"(?i)^Lesson\s+(\d+)"), (3, 0.80, r"(?i)^Exercise\s+(\d+[.\-]\d+)"),
    (2, 0.90, r"^第[一二三四五六七八九十百千\d]+[节课]"), (3, 0.80, r"^(\d+)\.(\d+)\.(\d+)\s+[A-Z]"),
    (2, 0.85, r"(?i)^(Mid-?Chapter|End.of.Chapter)\s+(Review|Test|Quiz)"), (2, 0.75, r"(?i)^(Review|Practice|Assessment)\s+(Exercise|Test|Quiz)"), (2, 0.70, r"(?i)^(Cumulative\s+)?Review"),
]
# Fixed values: (level, pattern) of contents entries; the first that fits counts, else level 1.
ENTRY_LEVELS = [
    (1, r"(?i)^(chapter|unit|part|module|topic)\s+\d"), (3, r"^\d+\.\d+\.\d+"), (2, r"^\d+\.\d+"), (1, r"^\d+\s+[A-Z]"), (2, r"(?i)^(section|lesson)\s+"),
    (3, r"(?i)^exercise\s+"), (2, r"(?i)^(review|practice)\s+"), (1, "(?i)^(past paper|glossary|index|appendix)"),
]


def is_entry(text: Column | str) -> Column:
    return _trimmed_entry(trim_ws(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))))


def _trimmed_entry(t: Column) -> Column:
    numbered = F.substring(t, -1, 1).isin(*"0123456789\x85")  # every entry ends with its page, before a line's end at most
    return (F.length(t) >= 3) & numbered & (t.rlike(any_at_start(ENTRY_WITH_CASE)) | t.rlike("(?i)" + any_at_start(ENTRY_ANY_CASE))) & ~t.rlike("(?i)" + any_of(IMPRINT))


def entry_level(title: Column | str) -> Column:
    t, out = trim_ws(title), None
    for level, pattern in ENTRY_LEVELS:
        out = F.when(t.rlike(pattern), level) if out is None else out.when(t.rlike(pattern), level)
    return out.otherwise(1)


def contents_pages(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_idx): the contents pages of each document, found by a mark or else by density, and those that follow."""
    rows = blocks.where("page_idx <= 30").select("doc_id", "page_idx", trim_ws(F.coalesce("text", F.lit(""))).alias("t"))
    t = F.col("t")
    named = F.lower(t).contains("content") | t.contains("目录")  # what no mark can do without
    mark = named & (t.rlike(CONTENTS_MARK) | trim_ws(F.regexp_replace(t, r"^[>\-\s–—•·*#]+", "")).rlike(CONTENTS_MARK))
    numbered = F.substring(t, 1, 1).isin(*"0123456789") & t.rlike(r"^\d+(\.\d+)*\s+[A-Z]")
    flags = rows.select("doc_id", "page_idx", _trimmed_entry(t).alias("entry"), numbered.alias("numbered"), mark.alias("mark"))
    pages = flags.groupBy("doc_id", "page_idx").agg(F.count_if("entry").alias("n"), F.count_if(F.col("entry") | F.col("numbered")).alias("m"), F.bool_or("mark").alias("mark"))
    w = Window.partitionBy("doc_id").orderBy("page_idx")
    document = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = F.when(F.lead("page_idx").over(w) == F.col("page_idx") + 1, F.lead("n").over(w))
    marked = F.min(F.when(F.col("mark") & (F.col("n") + F.coalesce("after", F.lit(0)) >= 5), F.col("page_idx")))
    dense = F.min(F.when((F.col("page_idx") <= 15) & (F.col("n") >= 8), F.col("page_idx")))
    run = pages.withColumn("after", following).withColumn("start", F.coalesce(marked.over(document), dense.over(document)))
    run = run.where("doc_id is not null and page_idx between start and least(start + 10, 30) and (page_idx = start or m >= 3)")
    return run.withColumn("gap", F.col("page_idx") - F.col("start") - F.row_number().over(w) + 1).where("gap = 0").select("doc_id", "page_idx")


def contents_entries(blocks: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(doc_id, id, title, page_number, level, source_page) of the entries on contents pages (none given: of all blocks).

    The blocks of the pages are written once before their texts are looked at, or patterns would be tried on all blocks.
    """
    rows = blocks if pages is None else stored(blocks.select("doc_id", "id", "type", "text", "page_idx").join(pages, ["doc_id", "page_idx"], "left_semi"), "contents-blocks")
    rows = rows.withColumn("t", trim_ws(F.coalesce("text", F.lit(""))))
    bare = trim_ws(F.regexp_replace("t", r"^[>\-\s]+", ""))
    rows = rows.where((F.length("t") >= 2) & ~F.col("type").isin("header", "footer", "page_number") & ~bare.rlike(r"(?i)^(table\s+of\s+)?contents?$") & (bare != "目录"))
    rows = rows.where(~((F.col("type") == "list") & (F.length("t") < 3))).where(~F.col("t").rlike("(?i)" + any_of(IMPRINT + IMPRINT_MORE)))
    wide, plain = r"^(.+?)[\s.]{2,}(\d{1,4})\s*$", r"^(.+?)\s+(\d{1,4})\s*$"
    by_wide, by_plain = F.col("t").rlike(wide), F.length(F.regexp_extract("t", plain, 1)) > 3
    title = F.when(by_wide, F.regexp_extract("t", wide, 1)).when(by_plain, F.regexp_extract("t", plain, 1)).otherwise(F.col("t"))
    number = F.when(by_wide, F.regexp_extract("t", wide, 2)).when(by_plain, F.regexp_extract("t", plain, 2)).try_cast("int")
    title = split_digit_capital(trim_ws(F.regexp_replace(trim_ws(title), r"\.{2,}$", "")))
    rows = rows.withColumn("title", title).withColumn("page_number", number).where("length(title) between 2 and 120").where(~F.col("title").rlike("(?i)" + any_of(FRONT_MATTER)))
    return rows.select("doc_id", "id", "title", "page_number", entry_level("title").alias("level"), F.col("page_idx").alias("source_page"))


def page_offsets(entries: DataFrame, body: DataFrame) -> DataFrame:
    """(doc_id, page_offset): the most frequent difference of real and printed page among the first ten numbered entries.

    An entry's real page is that of the first block much like its title; on ties the offset seen first counts. The
    entries, ten at most, meet each block of their document as one array: blocks move once, without their words.
    """
    w = Window.partitionBy("doc_id").orderBy("id")
    first = entries.where("page_number is not null").withColumn("k", F.row_number().over(w)).where("k <= 10").select("doc_id", "k", "page_number", normal_title("title").alias("a")).where("length(a) >= 3")
    asks = first.groupBy("doc_id").agg(F.collect_list(F.struct("k", "page_number", _words("a").alias("wa"))).alias("asks"))
    texts = body.select("doc_id", F.col("id").alias("b_id"), "page_idx", "text").join(asks, "doc_id")
    wb = F.array(_words(normal_title(F.coalesce("text", F.lit("")))))  # of one set, so that it is made once for all entries
    alike = F.flatten(F.transform(wb, lambda x: F.filter("asks", lambda e: much_alike(e["wa"], x, 8))))
    met = texts.select("doc_id", "b_id", "page_idx", F.explode(F.transform(alike, lambda e: F.struct(e["k"].alias("k"), e["page_number"].alias("page_number")))).alias("e"))
    hit = met.groupBy("doc_id", "e.k", "e.page_number").agg(F.min(F.struct("b_id", "page_idx")).alias("h"))
    seen = hit.select("doc_id", "k", (F.col("h.page_idx") - F.col("page_number")).alias("o")).groupBy("doc_id", "o").agg(F.count("*").alias("n"), F.min("k").alias("k"))
    return seen.groupBy("doc_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "k", "o"))["o"].alias("page_offset"))


def _words(c: Column | str) -> Column:
    return F.array_distinct(F.split(c, r"\s+"))


def loose_pairs(entries: DataFrame, body: DataFrame) -> DataFrame:
    """(doc_id, entry, block_id): the blocks that may match entries without a page, in the whole document.

    entries: (doc_id, entry, a, num), body: (doc_id, block_id, t, b), a and b normalised. By containment, by number, or
    by a likeness over 0.6, each by keys of its own, so that a title of common words doesn't meet every block.
    """
    e = entries.select("doc_id", F.col("entry").alias("a_id"), "a", "num", _words("a").alias("wa"))
    b = body.select("doc_id", F.col("block_id").alias("b_id"), "t", "b", _words("b").alias("wb"))
    alike = similar_pairs(e.select("doc_id", "a_id", "wa"), b.where((F.col("b") != "") & F.length("t").between(3, 200)).select("doc_id", "b_id", "wb"), 6)
    pairs = containing_pairs(e.select("doc_id", "a_id", "a"), b.select("doc_id", "b_id", "b")).union(number_pairs(e, b)).union(alike)
    return pairs.distinct().select("doc_id", F.col("a_id").alias("entry"), F.col("b_id").alias("block_id"))


def near_best(entries: DataFrame, body: DataFrame, reach: int) -> DataFrame:
    """(doc_id, entry, x1, firsts, x3) of entries (doc_id, entry, expected, a, num) and the blocks (doc_id, block_id, page, t, b) within ``reach`` pages.

    x1: the most alike by containment, x3: the most alike of short blocks above 0.6; firsts: of blocks that begin with
    the number those more alike than all before them. Entries and blocks are shuffled once, to their document's runs of
    SPAN pages (entries near an end to both sides), where each entry keeps its best blocks: pairs are not rows.
    """
    kind = entries.schema["doc_id"].dataType.simpleString()
    number, text = F.lit(None).cast("long"), F.lit(None).cast("string")
    span = lambda c: F.floor(c / SPAN).cast("long")
    at = F.col("expected").cast("long")
    e = entries.where("doc_id is not null and expected is not null").select("doc_id", F.explode(F.sequence(span(at - reach), span(at + reach))).alias("run"), F.lit(0).alias("kind"), F.col("entry").cast("long").alias("id"), at.alias("page"), F.col("a").alias("x"), F.col("num").alias("head"), F.lit(None).cast("boolean").alias("short"))
    head = F.regexp_extract("t", r"^([\d.]* ?)", 1)  # all that a number with a space or a dot can be the beginning of
    b = body.where("doc_id is not null and page is not null").select("doc_id", span(F.col("page")).alias("run"), F.lit(1).alias("kind"), F.col("block_id").cast("long").alias("id"), F.col("page").cast("long").alias("page"), F.col("b").alias("x"), head.alias("head"), F.length("t").between(3, 200).alias("short"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(key, own, out):
            for group in own.values():
                for entry, _, _, _, best in group:
                    if best["x1"] or best["firsts"] or best["x3"]:
                        out.append({"doc_id": key[0], "entry": entry, **best})

        schema = pa.schema([("doc_id", ids), ("entry", pa.int64()), ("x1", FOUND), ("firsts", pa.list_(FOUND)), ("x3", FOUND)])
        last, own, out = None, {}, []
        for batch in batches:
            for doc_id, at, is_block, i, page, x, head, short in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "run", "kind", "id", "page", "x", "head", "short")), strict=True):
                if (doc_id, at) != last:
                    close(last, own, out)
                    last, own = (doc_id, at), {}
                if not is_block:
                    own.setdefault(page, []).append((i, x, frozenset(SPACES.split(x)), head, {"x1": None, "firsts": [], "x3": None}))
                    continue
                words = None
                for near in range(page - reach, page + reach + 1) if x and own else ():
                    for _, a, wa, num, best in own.get(near, ()):
                        inside = a in x or x in a
                        begins = num != "" and (head.startswith(num + " ") or head.startswith(num + "."))
                        if not a or not (inside or begins or short):
                            continue
                        words = frozenset(SPACES.split(x)) if words is None else words
                        both = len(wa & words)
                        if not both:
                            continue
                        s = both / (len(wa) + len(words) - both)
                        found = {"s": s, "o": -i, "page": page}
                        if inside and (best["x1"] is None or s > best["x1"]["s"]):
                            best["x1"] = found
                        if begins and (not best["firsts"] or s > best["firsts"][-1]["s"]):
                            best["firsts"].append(found)
                        if short and s > 0.6 and (best["x3"] is None or s > best["x3"]["s"]):
                            best["x3"] = found
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        close(last, own, out)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    ids = to_arrow_type(entries.schema["doc_id"].dataType)
    rows = e.unionByName(b).repartition("doc_id", "run").sortWithinPartitions("doc_id", "run", "kind", "id")
    found = "struct<s:double,o:bigint,page:bigint>"
    return rows.mapInArrow(run, f"doc_id {kind}, entry bigint, x1 {found}, firsts array<{found}>, x3 {found}")


def match_contents(entries: DataFrame, body: DataFrame, offsets: DataFrame, reach: int = 5) -> DataFrame:
    """Anchors of contents entries: the best block within ``reach`` pages by containment, number, or likeness; else by page only.

    The most alike block by containment counts. Where it is below 0.8, a block that begins with the entry's number takes
    its place: the first that is more alike, at 0.7 at least, or the most alike of those above 0.7. Where that is
    below 0.6, the most alike of all short blocks above 0.6 does. What is found is written once, without texts.
    """
    e = entries.join(offsets, "doc_id", "left").withColumn("expected", F.col("page_number") + F.coalesce("page_offset", F.lit(0))).withColumnRenamed("id", "entry")
    near = e.select("doc_id", "entry", "expected", normal_title("title").alias("a"), F.regexp_extract("title", r"^(\d+(?:\.\d+)*)", 1).alias("num"))
    asked = body.join(entries.select("doc_id").distinct(), "doc_id", "left_semi")
    b = asked.select("doc_id", F.col("id").alias("block_id"), F.col("page_idx").alias("page"), F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "block_id", "page", trim_ws("text").alias("t"), normal_title("text").alias("b"))
    best = near_best(near, b, reach)
    loose = stored(near.where("expected is null and a <> ''"), "loose-entries")
    if not loose.isEmpty():  # their documents' blocks are read several times, so they are written once
        few = stored(b.join(loose.select("doc_id").distinct(), "doc_id", "left_semi"), "loose-blocks")
        joined = loose.join(loose_pairs(loose, few), ["doc_id", "entry"]).join(few, ["doc_id", "block_id"]).withColumn("wa", _words("a")).withColumn("wb", _words("b"))
        t, both = F.col("t"), F.size(F.array_intersect("wa", "wb"))
        score = F.when((F.col("a") == "") | (F.col("b") == ""), 0.0).otherwise(both / (F.size("wa") + F.size("wb") - both))
        inside = (F.col("b") != "") & (F.contains("b", F.col("a")) | F.contains("a", F.col("b")))
        numbered = (F.col("num") != "") & (t.startswith(F.concat("num", F.lit(" "))) | t.startswith(F.concat("num", F.lit("."))))
        rows = joined.select("doc_id", F.col("entry").cast("long").alias("entry"), F.struct(score.alias("s"), (-F.col("block_id").cast("long")).alias("o"), F.col("page").cast("long").alias("page")).alias("x"), inside.alias("i"), numbered.alias("n"), F.length(t).between(3, 200).alias("c")).where("x.s > 0")
        best = best.unionByName(rows.select("doc_id", "entry", F.when(F.col("i"), F.col("x")).alias("x1"), F.when(F.col("n"), F.array("x")).otherwise(F.array().cast("array<struct<s:double,o:bigint,page:bigint>>")).alias("firsts"), F.when(F.col("c") & (F.col("x.s") > 0.6), F.col("x")).alias("x3")))
    best = best.groupBy("doc_id", "entry").agg(F.array_max(F.collect_list("x1")).alias("x1"), F.flatten(F.collect_list("firsts")).alias("firsts"), F.array_max(F.collect_list("x3")).alias("x3"))
    best = best.withColumn("better", F.filter("firsts", lambda x: x["s"] > F.coalesce(F.col("x1.s"), F.lit(0.5))))
    best = best.withColumn("x2", F.array_max(F.filter("better", lambda x: x["s"] > 0.7)))
    best = best.withColumn("x2first", F.array_max(F.transform("better", lambda x: F.struct(x["o"].alias("o"), x.alias("x"))))["x"])
    two = (F.coalesce(F.col("x1.s"), F.lit(0.0)) < 0.8) & F.col("x2first").isNotNull()
    best = best.withColumn("y", F.when(two, F.coalesce("x2", "x2first")).otherwise(F.col("x1"))).withColumn("conf", F.when(two, F.greatest(F.col("y.s"), F.lit(0.7))).otherwise(F.col("x1.s")))
    three = (F.coalesce("conf", F.lit(0.0)) < 0.6) & (F.col("x3.s") > F.coalesce("conf", F.lit(0.0)))
    best = best.withColumns({"y": F.when(three, F.col("x3")).otherwise(F.col("y")), "conf": F.when(three, F.col("x3.s")).otherwise(F.col("conf"))})
    kinds = {c: body.schema[n].dataType for c, n in (("block_id", "id"), ("page", "page_idx"))}
    places = best.where("y is not null").select("doc_id", F.col("entry").cast(entries.schema["id"].dataType).alias("entry"), (-F.col("y.o")).cast(kinds["block_id"]).alias("block_id"), F.col("y.page").cast(kinds["page"]).alias("page"), F.col("conf").alias("confidence"))
    places = stored(places, "matched")
    texts = body.select("doc_id", F.col("id").alias("block_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = places.join(texts, ["doc_id", "block_id"], "left").join(e.select("doc_id", "entry", "title", "level"), ["doc_id", "entry"], "left")
    found = found.select("doc_id", "entry", "block_id", "page", "text", "title", "level", "confidence")
    missed = e.join(places.select("doc_id", "entry"), ["doc_id", "entry"], "left_anti").where("expected is not null")
    firsts = body.groupBy("doc_id", F.col("page_idx").alias("page")).agg(F.min("id").alias("block_id"))
    guess = missed.select("doc_id", "entry", "title", "level", F.posexplode(F.array("expected", F.col("expected") + 1, F.col("expected") - 1)).alias("o", "page")).join(firsts, ["doc_id", "page"])
    guess = guess.groupBy("doc_id", "entry", "title", "level").agg(F.min(F.struct("o", "block_id", "page")).alias("g"))
    guess = guess.select("doc_id", "entry", F.col("g.block_id").alias("block_id"), F.col("g.page").alias("page"), F.lit("").alias("text"), "title", "level", F.lit(0.4).alias("confidence"))
    return found.unionByName(guess).withColumn("source", F.lit("toc_match"))


def heading(t: Column) -> Column:
    """(level, conf) of the first heading pattern that a trimmed text fits, or null."""
    out = None
    for level, conf, pattern in HEADINGS:
        found = F.struct(F.lit(level).alias("level"), F.lit(conf).alias("conf"))
        out = F.when(t.rlike(pattern), found) if out is None else out.when(t.rlike(pattern), found)
    return out


def pattern_anchors(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, page, text, title, level, confidence, source) of blocks that look like headings.

    One pattern of all headings together sorts out the other blocks first; what is left is tried pattern by pattern.
    """
    rows = blocks.select("doc_id", "id", "page_idx", "type", "text_level", trim_ws(F.coalesce("text", F.lit(""))).alias("t"))
    rows = rows.where(F.length("t").between(3, 200) & F.col("t").rlike(any_at_start([h[2] for h in HEADINGS])) & ~noisy_heading("t"))
    boost = F.when(F.col("type") == "header", 0.05).otherwise(0.0) + F.when(F.col("text_level") == 1, 0.03).otherwise(0.0)
    rows = rows.withColumn("h", heading(F.col("t")))
    return rows.select("doc_id", F.col("id").alias("block_id"), F.coalesce("page_idx", F.lit(0)).alias("page"), F.col("t").alias("text"), F.col("t").alias("title"), F.col("h.level").alias("level"), F.least(F.col("h.conf") + boost, F.lit(1.0)).alias("confidence"), F.lit("pattern").alias("source"))


def merge_anchors(anchors: DataFrame) -> DataFrame:
    """One anchor for each block (the surest, surer by 0.1 for each further source), sentences and bare labels taken out, three for each page and level."""
    best = anchors.groupBy("doc_id", "block_id").agg(
        F.max_by(F.struct("page", "text", "title", "level", "source"), F.struct("confidence", F.when(F.col("source") == "toc_match", 1).otherwise(0), "title")).alias("a"),
        F.least(F.max("confidence") + 0.1 * (F.count("*") - 1), F.lit(1.0)).alias("confidence"), F.sort_array(F.collect_list("source")).alias("sources"),
    )
    rows = best.select("doc_id", "block_id", "a.page", "a.text", "a.title", "a.level", "confidence", "sources")
    rows = rows.where(~(trim_ws("text").rlike(r"(?i)^Chapter\s+\d+\s+\w{2,}") & (F.length(trim_ws("text")) > 30)))
    w = Window.partitionBy("doc_id").orderBy("block_id")
    label = trim_ws("text").rlike(r"(?i)^(Chapter|Unit|Part|Topic)\s+\d+\s*$") & (F.lead("level").over(w) == F.col("level")) & (F.lead("block_id").over(w) - F.col("block_id") <= 2)
    rows = rows.withColumn("_l", F.coalesce(label, F.lit(False))).where("not _l").drop("_l")
    w3 = Window.partitionBy("doc_id", "page", "level").orderBy("block_id")
    return rows.withColumn("_n", F.row_number().over(w3)).where("_n <= 3").drop("_n")


def anchor_tree(anchors: DataFrame, blocks: DataFrame) -> DataFrame:
    """Chapters of anchors in order of blocks; a chapter ends at the next anchor of its level or above."""
    total = blocks.groupBy("doc_id").agg(F.count("*").cast("int").alias("total"))
    w = Window.partitionBy("doc_id").orderBy("block_id")
    rows = anchors.withColumn("ord", F.row_number().over(w) - 1).join(total, "doc_id")
    after = w.rowsBetween(1, Window.unboundedFollowing)
    end = F.coalesce(*[F.when(F.col("level") == k, F.min(F.when(F.col("level") <= k, F.col("block_id"))).over(after)) for k in (1, 2, 3, 4)], F.col("total"))
    rows = rows.withColumn("_end", end).select("doc_id", "ord", F.col("ord").alias("id"), F.col("title").alias("text"), "level", "page", F.struct(F.col("block_id").alias("start"), F.col("_end").alias("end")).alias("block_range"))
    return with_tree(rows)


def gap_regions(blocks: DataFrame, anchors: DataFrame, sure: float = 0.7, around: int = 3, least: int = 5) -> DataFrame:
    """(doc_id, start_page, end_page): runs of pages with no sure anchor within ``around`` pages, if long enough."""
    pages = blocks.select("doc_id", "page_idx").distinct()
    near = anchors.where(F.col("confidence") >= sure).select("doc_id", F.explode(F.sequence(F.col("page") - around, F.col("page") + around)).alias("page_idx")).distinct().withColumn("hit", F.lit(1))
    w = Window.partitionBy("doc_id").orderBy("page_idx")
    rows = pages.join(near, ["doc_id", "page_idx"], "left").withColumn("island", F.count("hit").over(w)).withColumn("next", F.lead("page_idx").over(w))
    free = rows.where("hit is null").groupBy("doc_id", "island").agg(F.min("page_idx").alias("start_page"), F.max_by(F.coalesce(F.col("next") - 1, F.col("page_idx")), "page_idx").alias("end_page"))
    return free.where(F.col("end_page") - F.col("start_page") >= least).select("doc_id", "start_page", "end_page")


def page_windows(gaps: DataFrame, size: int = 5, stride: int = 3) -> DataFrame:
    """(doc_id, start_page, end_page) of overlapping windows inside the gaps."""
    rows = gaps.select("doc_id", F.col("end_page").alias("last"), F.explode(F.sequence("start_page", "end_page", F.lit(stride))).alias("start_page"))
    return rows.select("doc_id", "start_page", F.least(F.col("start_page") + size - 1, F.col("last")).alias("end_page"))


def window_headings(answers: DataFrame, windows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Anchors that a model named in page windows (doc_id, start_page, end_page); headings outside their window are left out.

    answers: (doc_id, start_page, output) with JSON {"headings": [{"block_id", "title", "level"}]} anywhere in the output.
    """
    schema = "headings array<struct<block_id:int,title:string,level:int>>"
    found = F.from_json(F.regexp_extract("output", r"(?s)(\{.*\})", 1), schema)["headings"]
    rows = answers.join(windows, ["doc_id", "start_page"]).select("doc_id", "start_page", "end_page", F.explode(found).alias("h"))
    b = blocks.select("doc_id", F.col("id").alias("block_id"), F.col("page_idx").alias("page"), "text")
    rows = rows.select("doc_id", "start_page", "end_page", F.col("h.block_id").alias("block_id"), F.col("h.title").alias("title"), F.col("h.level").alias("level"))
    rows = rows.join(b, ["doc_id", "block_id"]).where("page between start_page and end_page and level between 1 and 4")
    return rows.select("doc_id", "block_id", "page", "text", "title", "level", F.lit(0.65).alias("confidence"), F.lit("llm").alias("source")).distinct()


def unmatched_titles(entries: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc_id, title) of contents entries that no anchor has."""
    return entries.select("doc_id", "title").distinct().join(anchors.select("doc_id", "title"), ["doc_id", "title"], "left_anti")


def page_density(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_idx, blocks, entries, ids): the blocks of each page, how many look like contents entries, in order."""
    return blocks.groupBy("doc_id", "page_idx").agg(F.count("*").alias("blocks"), F.count_if(is_entry("text")).alias("entries"), F.sort_array(F.collect_list("id")).alias("ids"))


def total_pages(blocks: DataFrame) -> DataFrame:
    """(doc_id, total_pages)."""
    return blocks.groupBy("doc_id").agg((F.max("page_idx") + 1).alias("total_pages"))


def dispatch(blocks: DataFrame) -> DataFrame:
    """(doc_id, use_contents, use_patterns, use_model): documents with contents pages need no model."""
    found = contents_pages(blocks).select("doc_id").distinct().withColumn("hit", F.lit(True))
    rows = blocks.select("doc_id").distinct().join(found, "doc_id", "left")
    hit = F.coalesce("hit", F.lit(False))
    return rows.select("doc_id", hit.alias("use_contents"), F.lit(True).alias("use_patterns"), (~hit).alias("use_model"))


def rule_anchors(blocks: DataFrame) -> DataFrame:
    """Anchors of stored blocks: of contents entries where there are contents pages, of heading patterns everywhere else.

    Only the blocks of documents with contents pages are split into contents and body; that and the entries are written
    once, as several steps read them. Of other documents no more than the blocks that look like headings is moved.
    """
    pages = stored(contents_pages(blocks), "tree-pages")
    own = blocks.join(pages.select("doc_id").distinct(), "doc_id", "left_semi")
    split = stored(own.join(pages.withColumn("_contents", F.lit(True)), ["doc_id", "page_idx"], "left"), "tree-split")
    body = split.where("_contents is null").drop("_contents")
    entries = stored(contents_entries(split.where("_contents").drop("_contents")), "tree-entries")
    offsets = stored(page_offsets(entries, body), "tree-offsets")
    found = stored(match_contents(entries, body, offsets).drop("entry"), "tree-found")
    return found.unionByName(pattern_anchors(blocks.join(pages, ["doc_id", "page_idx"], "left_anti")))


def rule_tree(blocks: DataFrame) -> DataFrame:
    """The chapter tree of each document by rules alone."""
    blocks = stored(blocks.select(*TREE_COLUMNS), "tree-blocks")
    return anchor_tree(merge_anchors(rule_anchors(blocks)), blocks)
