"""Answers of the extraction model: strict and lenient parsing, and text put in place of block ids."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.predicates import is_id_sequence
from pageloom.functions.text import trim_ws

MAX_FORMULA, CUT_MARK = 4096, "... [超长公式已截断]"


def tag(c: Column, name: str) -> Column:
    """Trimmed body of the first <name> on one line, or ''."""
    return F.coalesce(trim_ws(F.regexp_extract(c, f"<{name}>(.*?)</{name}>", 1)), F.lit(""))


def _bodies(c: Column, name: str) -> Column:
    return F.regexp_extract_all(c, F.lit(rf"(?s)(<{name}>.*?</{name}>)"), F.lit(1))


def _pair(p: Column, chapter: Column, pos: Column, lenient: bool) -> Column:
    def ids(name):
        raw = tag(p, name)
        return F.when(is_id_sequence(raw), raw).otherwise(F.array_join(F.regexp_extract_all(raw, F.lit(r"(\d+)"), F.lit(1)), ",")) if lenient else raw

    kind = tag(p, "type")
    return F.struct(
        pos.cast("int").alias("pos"), tag(p, "label").alias("label"), F.when(kind == "", "exercise").otherwise(kind).alias("type"),
        ids("question").alias("question_ids"), ids("solution").alias("solution_ids"), chapter.alias("chapter_title_ids"),
    )


def parse_answers(answers: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, mode, pos, label, type, question_ids, solution_ids, chapter_title_ids) of (doc_id, chunk_index, output).

    Strict parsing holds for a whole answer: any tag that isn't a sequence of ids makes it lenient. Blank answers and
    those with <empty> have no rows. All in one pass over the answers.
    """
    out = F.coalesce(F.col("output"), F.lit(""))
    chapters = F.transform(_bodies(out, "chapter"), lambda c: F.struct(tag(c, "title").alias("t"), _bodies(c, "qa_pair").alias("p")))
    rows = answers.select("doc_id", "chunk_index", out.alias("o"), chapters.alias("ch")).withColumn("blank", (trim_ws("o") == "") | F.col("o").contains("<empty>"))
    strict = F.flatten(F.transform("ch", lambda c: F.transform(c["p"], lambda p: _pair(p, c["t"], F.lit(0), False))))
    titles_ok = F.forall("ch", lambda c: is_id_sequence(c["t"]))
    rows = rows.withColumn("strict", strict)
    pairs_ok = F.forall("strict", lambda q: is_id_sequence(q["question_ids"]) & is_id_sequence(q["solution_ids"]))
    rows = rows.withColumn("ok", ~F.col("blank") & (F.size("ch") > 0) & titles_ok & pairs_ok)
    lenient = F.filter(F.transform(_bodies(F.col("o"), "qa_pair"), lambda p: _pair(p, F.lit(""), F.lit(0), True)), lambda q: q["question_ids"] != "")
    mode = F.when(F.col("ok"), "strict").otherwise("lenient")
    found = rows.where("not blank").select("doc_id", "chunk_index", mode.alias("mode"), F.posexplode(F.when(F.col("ok"), F.col("strict")).otherwise(lenient)).alias("pos", "q"))
    return found.select("doc_id", "chunk_index", "mode", "pos", *[F.col(f"q.{c}").alias(c) for c in ("label", "type", "question_ids", "solution_ids", "chapter_title_ids")])


def parse_legacy(answers: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, pos, label, type, question_ids, solution_ids, answer, chapter_title_ids, error) of older answers.

    They have an <answer> in each pair and are strict only; an answer without any pair is one row with an error.
    """
    out = F.coalesce(F.col("output"), F.lit(""))
    pair = lambda p, c: F.struct(tag(p, "label").alias("label"), F.when(tag(p, "type") == "", "exercise").otherwise(tag(p, "type")).alias("type"), tag(p, "question").alias("question_ids"), tag(p, "solution").alias("solution_ids"), tag(p, "answer").alias("answer"), tag(c, "title").alias("chapter_title_ids"))
    pairs = F.flatten(F.transform(_bodies(out, "chapter"), lambda c: F.transform(_bodies(c, "qa_pair"), lambda p: pair(p, c))))
    rows = answers.select("doc_id", "chunk_index", F.posexplode_outer(pairs).alias("pos", "q"))
    return rows.select("doc_id", "chunk_index", "pos", "q.*", F.when(F.col("q").isNull(), "no question could be read").alias("error"))


def id_list(ids: Column) -> Column:
    """Array of the leading integers of a comma-separated list; what has none is null.

    An empty one isn't cast: a cast that fails costs as much as a hundred that don't.
    """
    return F.transform(F.split(F.coalesce(ids, F.lit("")), ","), lambda x: F.when(x != "", F.regexp_extract(x, r"^\s*([+-]?\d+)", 1).try_cast("int")))


def shown_text(kind: Column, text: Column, img: Column, caption: Column, limit: int = MAX_FORMULA) -> Column:
    """A block as it stands in a question's text, or null if it adds nothing."""
    picture = F.concat(F.lit("!["), F.coalesce(F.nullif(caption, F.lit("")), F.lit("image")), F.lit("]("), img, F.lit(")"))
    cut = F.when((kind == "equation") & (F.length(text) > limit) & F.lit(limit > 0), F.concat(F.substring(text, 1, limit), F.lit(CUT_MARK))).otherwise(text)
    has = F.coalesce(text, F.lit("")) != ""
    return (
        F.when((kind == "image") & (F.coalesce(img, F.lit("")) != ""), picture)
        .when((kind == "table") & has, F.concat(F.lit("[Table] "), text))
        .when(has, cut)
    )


def backfill(rows: DataFrame, ids: str, blocks: DataFrame, key: list[str], sep: str = "\n", plain: bool = False, prefix: str = "") -> DataFrame:
    """Adds ``text`` and ``images`` for the ids of each row, in the order of the ids (a repeated id repeats its text).

    rows need doc_id and the key columns; where they have lo and hi, ids outside are left out. One equi-join on
    (doc_id, id); rows without any block keep an empty text. plain: text only, as for titles.
    """
    keys = list(dict.fromkeys(["doc_id", *key]))
    picked = rows.select(*keys, *[c for c in ("lo", "hi") if c in rows.columns], F.posexplode(id_list(F.col(ids))).alias("at", "id")).where("id is not null")
    if "lo" in rows.columns:
        picked = picked.where("id between lo and hi")
    if plain:
        shown, image = F.when(F.col("text") != "", F.col("text")), F.lit(None).cast("string")
    else:
        shown = shown_text(F.col("type"), F.col("text"), F.col("img_path"), F.col("image_caption"))
        image = F.when((F.col("type") == "image") & (F.coalesce("img_path", F.lit("")) != ""), F.concat(F.lit(prefix), F.col("img_path")))
    parts = blocks.select("doc_id", "id", shown.alias("s"), image.alias("i")).where("s is not null")
    got = picked.join(parts, ["doc_id", "id"]).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", "s", "i"))).alias("x"))
    text = trim_ws(F.array_join(F.col("x.s"), sep))
    images = F.filter(F.col("x.i"), lambda i: i.isNotNull())
    out = rows.join(got.select(*keys, text.alias("text"), images.alias("images")), keys, "left")
    return out.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("images", F.coalesce("images", F.array().cast("array<string>")))


def questions_of(parsed: DataFrame, blocks: DataFrame, chunks: DataFrame, prefix: str = "") -> DataFrame:
    """The extracted questions with their texts; ids outside the chunk are left out, titles may refer to any block of it.

    The id lists of question, solution and title meet the blocks in one equi-join and are put together in one grouping.
    """
    key, kinds = ["doc_id", "chunk_index", "pos"], ["question_ids", "solution_ids", "chapter_title_ids"]
    rows = parsed.join(chunks.select("doc_id", "chunk_index", F.col("start_id").alias("lo"), F.col("end_id").alias("hi")), ["doc_id", "chunk_index"])
    listed = lambda k, c: F.transform(id_list(F.col(c)), lambda x, i: F.struct(F.lit(k).alias("kind"), i.alias("at"), x.alias("id")))
    asked = F.concat(*[listed(k, c) for k, c in enumerate(kinds)])
    asked = F.filter(asked, lambda w: w["id"].between(F.col("lo"), F.col("hi")))
    rest = F.struct(*[c for c in parsed.columns if c not in key]).alias("rest")
    picked = rows.select(*key, rest, F.explode_outer(asked).alias("w")).select(*key, "rest", "w.kind", "w.at", "w.id")
    image = F.when((F.col("type") == "image") & (F.coalesce("img_path", F.lit("")) != ""), F.concat(F.lit(prefix), F.col("img_path")))
    parts = blocks.select("doc_id", "id", shown_text(F.col("type"), F.col("text"), F.col("img_path"), F.col("image_caption")).alias("shown"), F.when(F.col("text") != "", F.col("text")).alias("plain"), image.alias("image"))
    found = F.when(F.coalesce("shown", "plain").isNotNull(), F.struct("kind", "at", "shown", "plain", "image"))
    got = picked.join(parts, ["doc_id", "id"], "left").groupBy(*key).agg(F.first("rest").alias("rest"), F.sort_array(F.collect_list(found)).alias("x"))
    text = lambda k, f, sep: trim_ws(F.array_join(F.transform(F.filter("x", lambda w: w["kind"] == k), lambda w: w[f]), sep))
    images = F.filter(F.transform(F.filter("x", lambda w: (w["kind"] < 2) & w["shown"].isNotNull()), lambda w: w["image"]), lambda i: i.isNotNull())
    out = got.select(*key, "rest.*", text(0, "shown", "\n").alias("question"), text(1, "shown", "\n").alias("solution"), text(2, "plain", " ").alias("chapter_title"), images.alias("images"))
    return out.withColumn("has_answer", F.col("solution") != "")


def repair_json(raw: str) -> dict | list | None:
    """A cut or slightly broken JSON answer, mended step by step; None where it can't be read."""
    import re

    def read(s):
        try:
            return json.loads(s)
        except ValueError:
            return None

    if (found := read(raw)) is not None:
        return found
    s = re.sub(r'("level"\s*:\s*),', r"\1 1,", raw.strip())
    s = re.sub(r",\s*,+", ",", re.sub(r",(\s*[}\]])", r"\1", s))
    if (found := read(s)) is not None:
        return found
    first = s.find("{")
    if first >= 0:
        s = s[first:]
        for end in ("}", "]}", '"]}}'):
            if (found := read(s + end)) is not None:
                return found
        at = s.rfind("}")
        for _ in range(20):
            if at <= first:
                break
            found = read(s[: at + 1] + "]}")
            if isinstance(found, dict) and any(found.get(k) for k in ("directory", "chapters", "entries")):
                return found
            if (found := read(s[: at + 1])) is not None:
                return found
            at = s.rfind("}", 0, at)
    whole = re.search(r"\{.*\}", raw, re.S)
    return read(whole[0]) if whole else None


def directory_entries(answers: DataFrame, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(doc_id, ok, ord, ids, level, title) of (doc_id, output): a directory answer's entries in order, mended where needed.

    Answers that the JVM reads as they are don't go through Python. ids: the numbers among an entry's id or ids; entries
    with none, or with a level that isn't 1 to 4, are left out. ok is false, with no entries, where nothing can be read.
    """
    schema = "directory array<struct<id:string,level:string,title:string>>, chapters array<struct<id:string,level:string,title:string>>, entries array<struct<id:string,level:string,title:string>>"

    @F.pandas_udf("string")
    def mended(raw: pd.Series) -> pd.Series:
        return raw.map(lambda r: None if r is None or (x := repair_json(r)) is None else json.dumps(x))

    rows = answers.select(*key, "output", F.coalesce(F.try_parse_json("output").isNotNull(), F.lit(False)).alias("whole"))
    fine = rows.where("whole").select(*key, F.col("output").alias("j"))
    broken = rows.where("not whole").select(*key, mended("output").alias("j"))
    read = fine.union(broken).select(*key, F.from_json("j", schema).alias("d"))
    items = F.coalesce("d.directory", "d.chapters", "d.entries")
    number = F.filter(F.transform(F.split(F.regexp_replace(F.col("x.id"), r"[\[\]\s]", ""), ","), lambda v: F.when(v.rlike(r"^-?\d+$"), v.try_cast("int"))), lambda v: v.isNotNull())
    out = read.select(*key, items.isNotNull().alias("ok"), F.posexplode_outer(items).alias("ord", "x"))
    out = out.select(*key, "ok", "ord", number.alias("ids"), F.col("x.level").try_cast("int").alias("level"), trim_ws(F.coalesce("x.title", F.lit(""))).alias("title"))
    return out.where("not ok or (size(ids) > 0 and level between 1 and 4)")
