"""Flattening of layout blocks: nested JSON blocks to dense rows, in one pass and without a shuffle.

A document is one row with the array of its raw blocks. Each raw block becomes an array of flat ones, the arrays are
joined and exploded with their position, so the dense id needs no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.functions.text import LINE_LIMIT, clean_line, outline_line, trim_plain, trim_ws

NOISE_TYPES = ["page_number", "footer", "header"]
CONTENTS_ENTRY = r"\.{4,}\s*\d+$"
TABLE_ROW = r"(?i)(<tr[\s\S]*?</tr>)"

CHILD = T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("text_level", T.IntegerType()), T.StructField("img_path", T.StringType())])
RAW_BLOCK = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("sub_type", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("text_level", T.IntegerType()), T.StructField("page_idx", T.IntegerType()), T.StructField("bbox", T.ArrayType(T.DoubleType())),
    T.StructField("img_path", T.StringType()), T.StructField("image_caption", T.ArrayType(T.StringType())), T.StructField("image_footnote", T.ArrayType(T.StringType())),
    T.StructField("text_format", T.StringType()), T.StructField("list_items", T.ArrayType(T.StringType())), T.StructField("table_body", T.StringType()),
    T.StructField("inside", T.ArrayType(CHILD)),
])
FLAT = ["type", "text", "img_path", "image_caption", "page_idx", "text_level"]


def _flat(kind: Column, text: Column | None = None, img: Column | None = None, caption: Column | None = None, page: Column | None = None, level: Column | None = None) -> Column:
    null = lambda c, t: (F.lit(None) if c is None else c).cast(t)
    return F.struct(
        kind.cast("string").alias("type"), null(text, "string").alias("text"), null(img, "string").alias("img_path"),
        null(caption, "string").alias("image_caption"), null(page, "int").alias("page_idx"), null(level, "int").alias("text_level"),
    )


def is_contents(text: Column) -> Column:
    """A contents mark or entry; what neither can do without is looked for first."""
    mark, entry = text.contains("目录") & (trim_ws(text) == "目录"), text.contains("....") & text.rlike(CONTENTS_ENTRY)
    return F.coalesce((text != "") & (mark | entry), F.lit(False))


def flat_blocks_of(b: Column) -> Column:
    """Array of the flat blocks that one raw block becomes."""
    kind, page, text = F.coalesce(b["type"], F.lit("text")), F.coalesce(b["page_idx"], F.lit(0)), b["text"]
    some = F.coalesce(text, F.lit("")) != ""
    nothing = F.array().cast("array<struct<type:string,text:string,img_path:string,image_caption:string,page_idx:int,text_level:int>>")
    html = F.when(some, text).otherwise(b["table_body"])
    items = F.transform(b["list_items"], lambda x: _flat(F.lit("text"), trim_ws(F.coalesce(x, F.lit(""))), page=page))
    inside = F.transform(b["inside"], lambda c: _flat(F.coalesce(c["type"], F.lit("text")), trim_ws(F.coalesce(c["text"], F.lit(""))), c["img_path"], None, page, c["text_level"]))
    rows = F.transform(F.regexp_extract_all(html, F.lit(TABLE_ROW), F.lit(1)), lambda r: _flat(F.lit("text"), F.concat(F.lit("[Table Row] "), r), page=page))
    image = (kind == "image") & (F.coalesce(b["img_path"], F.lit("")) != "")
    caption = F.when(image & (F.size(b["image_caption"]) > 0), F.array_join(b["image_caption"], " "))
    plain = _flat(kind, F.when(some, trim_ws(text)), F.when(image, b["img_path"]), caption, page, b["text_level"])
    return (
        F.when(b.isNull() | kind.isin(NOISE_TYPES) | is_contents(text), nothing)
        .when((kind == "list") & (b["sub_type"] == "text") & (F.size(b["list_items"]) > 0), items)
        .when((kind == "table") & (F.size(b["inside"]) > 0), inside)
        .when((kind == "table") & F.contains(html, F.lit("<tr")), rows)
        .when(kind == "table", F.array(_flat(F.lit("text"), trim_ws(F.coalesce(text, F.lit(""))), page=page, level=b["text_level"])))
        .otherwise(F.array(plain))
    )


def flatten_blocks(docs: DataFrame, blocks: str = "blocks") -> DataFrame:
    """(doc_id, id, type, text, img_path, image_caption, page_idx, text_level) of (doc_id, blocks); ids are dense from 0."""
    flat = F.flatten(F.transform(F.col(blocks), flat_blocks_of))
    return docs.select("doc_id", F.posexplode(flat).alias("id", "b")).select("doc_id", "id", *[F.col(f"b.{c}").alias(c) for c in FLAT])


def flatten_block_rows(rows: DataFrame) -> DataFrame:
    """The same of (doc_id, pos, fields of a raw block), one row for each raw block: no row grows with the document.

    The dense id is the number of flat blocks before, a running sum over the document.
    """
    raw = F.struct(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in RAW_BLOCK.fields])
    flat = rows.select("doc_id", "pos", flat_blocks_of(raw).alias("_flat"))
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = flat.withColumn("_first", F.coalesce(F.sum(F.size("_flat")).over(before), F.lit(0)))
    out = placed.select("doc_id", "_first", F.posexplode("_flat").alias("_at", "b"))
    return out.select("doc_id", (F.col("_first") + F.col("_at")).cast("int").alias("id"), *[F.col(f"b.{c}").alias(c) for c in FLAT])


def converted(blocks: DataFrame) -> DataFrame:
    """Flat blocks as they are shown to a model: without page and heading level."""
    return blocks.drop("text_level", "page_idx")


def line_array(text: Column, page_lines: int = 10) -> Column:
    """Array of (text, page_idx) of a plain text's lines; noise lines go."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x, i: F.struct(trim_plain(x).alias("text"), F.floor(i / page_lines).cast("int").alias("page_idx")))
    return F.filter(lines, lambda x: (x["text"] != "") & ~is_contents(x["text"]))


def line_kind(text: Column) -> Column:
    return F.when(text.contains("=") & text.rlike(r"^\s*[\d\W_]*=[\d\W_]*$"), "equation").otherwise("text")


def line_blocks(docs: DataFrame, page_lines: int = 10) -> DataFrame:
    """Flat blocks of plain texts: a line is a block, noise lines go; ids are dense, no shuffle."""
    out = docs.select("doc_id", F.posexplode(line_array(F.col("text"), page_lines)).alias("id", "b")).select("doc_id", "id", F.col("b.text").alias("text"), F.col("b.page_idx").alias("page_idx"))
    return out.select("doc_id", "id", line_kind(F.col("text")).alias("type"), "text", "page_idx", F.lit(None).cast("int").alias("text_level"))


def outline_lines(blocks: DataFrame) -> DataFrame:
    """(doc_id, id, line): the outline line of each block, or null; the cleaned text is a column of its own, so that its patterns run once.

    Of a long text without images and formulas only the beginning is cleaned, if that is more than a line shows.
    """
    begin = (F.length("text") > 3 * LINE_LIMIT) & ~F.contains("text", F.lit("![")) & ~F.contains("text", F.lit("$"))
    some = F.when(begin, F.substring("text", 1, 3 * LINE_LIMIT)).otherwise(F.col("text"))
    rows = blocks.select("doc_id", "id", "type", "page_idx", "text_level", "text", begin.alias("begin"), some.alias("some"))
    rows = rows.select("*", clean_line("some").alias("clean"))
    whole = F.when(F.col("begin") & (F.length("clean") <= LINE_LIMIT + 1), clean_line("text")).otherwise(F.col("clean"))
    rows = rows.select("doc_id", "id", "type", "page_idx", "text_level", whole.alias("clean"))
    return rows.select("doc_id", "id", outline_line(F.col("type"), F.col("clean"), F.col("id"), F.col("page_idx"), F.col("text_level")).alias("line"))


def full_text(blocks: DataFrame) -> DataFrame:
    """(doc_id, outline): the outline lines of each document in order; of blocks, or of lines made before (doc_id, id, line).

    Blocks whose table is dealt by doc_id are put together where they are; collect_list leaves out blocks without a line, and documents without any have no row.
    """
    rows = blocks if "line" in blocks.columns else outline_lines(blocks)
    rows = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("id", "line")))).alias("x"))
    return rows.where("size(x) > 0").select("doc_id", F.array_join(F.col("x.line"), "\n").alias("outline"))
