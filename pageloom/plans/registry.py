"""Where queries and their SQL are registered, and the frames that many of them start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.text import word_count
from pageloom.operators.blocks import line_blocks
from pageloom.session import dealt, stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document as a block."""
    return line_blocks(dealt(table(spark, sf_dir, "documents"), "doc_id"))


def kept_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, written once for queries that read them several times."""
    return stored(blocks(spark, sf_dir), "blocks")


#: The same in SQL: view B(doc_id, id, type, text, page_idx).
B = r"""
L AS (SELECT doc_id, unnest(range(0, len(a))) AS i, unnest(a) AS raw FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
T AS (SELECT doc_id, i, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS text FROM L),
B AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS id,
             CASE WHEN regexp_matches(text, '^\s*[\d\W_]*=[\d\W_]*$') THEN 'equation' ELSE 'text' END AS type, text, CAST(floor(i / 10) AS INTEGER) AS page_idx
      FROM T WHERE text <> '' AND text <> '目录' AND NOT regexp_matches(text, '\.{4,}\s*\d+$'))"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries_of(blocks(spark, sf_dir))


def entries_of(b: DataFrame) -> DataFrame:
    """Short lines as chapter entries: level by their number of words, in the order of the blocks."""
    b = b.withColumn("wc", word_count("text", 8)).where("wc <= 8")
    level = F.ceil(F.col("wc") / 2).cast("int")
    return b.select("doc_id", F.col("id").alias("ord"), F.array("id").alias("ids"), level.alias("level"), F.concat(F.lit("T "), "text").alias("title"))


def kept_entries(b: DataFrame) -> DataFrame:
    """The same, written once for queries that read them several times: they are few, and no block is split again."""
    return stored(entries_of(b), "entries")


#: The same in SQL: view E(doc_id, ord, id, level, title), after B.
E = r"""
E AS (SELECT doc_id, id AS ord, id, CAST(ceil(len(regexp_split_to_array(text, '\s+')) / 2.0) AS INTEGER) AS level, 'T ' || text AS title
      FROM B WHERE len(regexp_split_to_array(text, '\s+')) <= 8)"""

#: Chapters in SQL: view C(doc_id, ord, id, text, level, page, s, e, parent_id), after B and E.
C = r"""
N AS (SELECT doc_id, count(*) AS total FROM B GROUP BY doc_id),
C0 AS (SELECT E.*, lead(E.id) OVER (PARTITION BY E.doc_id ORDER BY E.ord) AS nxt, N.total,
              max(CASE WHEN level = 1 THEN ord END) OVER w AS u1, max(CASE WHEN level = 2 THEN ord END) OVER w AS u2, max(CASE WHEN level = 3 THEN ord END) OVER w AS u3
       FROM E JOIN N ON E.doc_id = N.doc_id WINDOW w AS (PARTITION BY E.doc_id ORDER BY E.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
C AS (SELECT C0.doc_id, C0.ord, C0.id, substr(B.text, 1, 80) AS text, C0.level, B.page_idx AS page, C0.id AS s,
             CAST(CASE WHEN nxt IS NULL THEN total WHEN C0.id >= nxt THEN C0.id + 1 ELSE nxt END AS INTEGER) AS e,
             CASE C0.level WHEN 1 THEN NULL WHEN 2 THEN u1 WHEN 3 THEN greatest(u1, u2) ELSE greatest(u1, u2, u3) END AS parent_id
      FROM C0 JOIN B ON C0.doc_id = B.doc_id AND C0.id = B.id)"""

#: Paths in SQL: view P(doc_id, id, path), after C.
P = r"""
P AS (SELECT a.doc_id, a.ord, a.id, a.level, a.s, a.e, concat_ws(' > ', d.text, c.text, b.text, a.text) AS path
      FROM C a LEFT JOIN C b ON a.doc_id = b.doc_id AND a.parent_id = b.id LEFT JOIN C c ON a.doc_id = c.doc_id AND b.parent_id = c.id LEFT JOIN C d ON a.doc_id = d.doc_id AND c.parent_id = d.id)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block as a question over itself and the next block; titles of every kind in turn."""
    titles = F.array(*[F.lit(x) for x in TITLES])
    b = blocks(spark, sf_dir)
    return b.select(
        "doc_id", F.col("id").alias("seq"), F.concat(F.col("id") - F.floor(F.col("id") / 7).cast("int"), F.lit(".")).alias("label"),
        F.when(F.length("text") % 3 == 0, "example").otherwise("exercise").alias("type"), F.get(titles, (F.length("text") % len(TITLES)).cast("int")).alias("chapter_title"),
        F.col("text").alias("question"), F.when(F.length("text") % 2 == 0, F.substring("text", 1, 20)).otherwise("").alias("solution"),
        F.array(F.concat(F.lit("/data/out/images/"), F.col("id"), F.lit(".jpg"))).alias("images"), (F.length("text") % 2 == 0).alias("has_answer"),
        F.concat(F.col("id"), F.lit(","), F.col("id") + 1).alias("question_ids"), F.col("id").cast("string").alias("solution_ids"), F.lit("0").alias("chapter_title_ids"),
    )


TITLES = ["20.1", "", "基础训练", "Unit 3", "练习 2", "  Chapter   4 ", "选择题"]

#: The same in SQL: view Q, after B.
Q = f"""
Q AS (SELECT doc_id, id AS seq, (id - id // 7) || '.' AS label, CASE WHEN length(text) % 3 = 0 THEN 'example' ELSE 'exercise' END AS type,
             [{', '.join(f"'{t}'" for t in TITLES)}][1 + length(text) % {len(TITLES)}] AS chapter_title, text AS question,
             CASE WHEN length(text) % 2 = 0 THEN substr(text, 1, 20) ELSE '' END AS solution, '/data/out/images/' || id || '.jpg' AS image,
             id || ',' || (id + 1) AS question_ids FROM B)"""
NOISE_SQL = "regexp_matches({}, '选择题|填空题|判断题|应用题|计算题|递等式|竖式|基础训练|拓展训练|练习|综合训练')"
