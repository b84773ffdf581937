"""Model answers behind an interface: replayed from a table, made by rules, or asked of a caller's function."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom.operators.blocks import full_text, outline_lines
from pageloom.operators.chunking import members_of
from pageloom.session import discard, scratch_path, stored

#: Seconds before an answer is asked for again.
DELAYS = (2, 4, 8)
# Limits of calls for questions and for chapters.
EXTRACTION = {"temperature": 0.1, "max_tokens": 4000, "timeout": 60}
CHAPTERS = {"temperature": 0, "max_tokens": 32000, "timeout": 300}
#: What a chunk's blocks are put after. The form of the answer is the one that answers.parse_answers reads.
QUESTION_PROMPT = """Find every question, worked example and solution among the blocks below. Refer to blocks by id; never copy their text.

Answer in this form, chapter by chapter and question by question, in the order of the blocks:
<chapter><title>ids of the heading's blocks</title>
<qa_pair><label>the question's own number</label><type>example or exercise</type><question>ids</question><solution>ids, or nothing</solution></qa_pair>
</chapter>

- Ids are whole numbers joined by commas, and only ids that are listed.
- A question has all blocks that belong to it: text, pictures, tables, formulas, parts and choices.
- Several numbered parts under one stem are one question. Headings of sections are no questions.
- A type is example where the text works the question out, else exercise. An exercise has a solution only if it is printed.
- Answer <empty></empty> if there is no question.

## Input JSON:
"""


class Provider(Protocol):
    def answers(self, chunks: DataFrame, blocks: DataFrame, attempt: int | None = None) -> DataFrame:
        """(doc_id, chunk_index, output) for (doc_id, chunk_index, start_id, end_id); attempt counts from 0 where chunks are asked again."""

    def complete(self, prompts: DataFrame, attempt: int | None = None) -> DataFrame:
        """(doc_id, chunk_index, output) for (doc_id, chunk_index, prompt)."""


class ReplayProvider:
    """Answers stored before (doc_id, chunk_index, attempt, output, success); without an attempt the last that succeeded counts."""

    def __init__(self, responses: DataFrame):
        self.responses = responses.where(F.coalesce("success", F.lit(True)))

    def complete(self, prompts: DataFrame, attempt: int | None = None) -> DataFrame:
        own = self.responses
        if attempt is None:
            w = Window.partitionBy("doc_id", "chunk_index").orderBy(F.desc("attempt"))
            own = own.withColumn("_n", F.row_number().over(w)).where("_n = 1")
        else:
            own = own.where(F.col("attempt") == attempt)
        return prompts.select("doc_id", "chunk_index").join(own.select("doc_id", "chunk_index", "output"), ["doc_id", "chunk_index"], "left")

    def answers(self, chunks: DataFrame, blocks: DataFrame, attempt: int | None = None) -> DataFrame:
        return self.complete(chunks, attempt)


class RuleProvider:
    """Each block that begins with a number label starts a question that runs to the next label."""

    label = r"^\s*(?:例\s*)?(\d+)[.．、)]"
    #: Asked again it gives the same answer.
    repeatable = False

    def answers(self, chunks: DataFrame, blocks: DataFrame, attempt: int | None = None) -> DataFrame:
        t = F.coalesce("text", F.lit(""))
        w = Window.partitionBy("doc_id").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
        found = F.when(t.rlike(self.label), F.struct("id", F.regexp_extract(t, self.label, 1).alias("label"), F.when(t.rlike(r"^\s*例"), "example").otherwise("exercise").alias("type")))
        rows = blocks.select("doc_id", "id", F.last(found, ignorenulls=True).over(w).alias("q")).where("q is not null")
        questions = rows.groupBy("doc_id", "q").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("id", F.col("q.id"))
        inside = members_of(chunks).join(questions, ["doc_id", "id"]).where("element_at(ids, -1) <= end_id")  # the chunk has its first block, and all others
        pair = F.concat(F.lit("<qa_pair><label>"), "q.label", F.lit("</label><type>"), "q.type", F.lit("</type><question>"), F.array_join(F.col("ids").cast("array<string>"), ","), F.lit("</question><solution></solution></qa_pair>"))
        made = inside.groupBy("doc_id", "chunk_index").agg(F.sort_array(F.collect_list(F.struct(F.col("q.id").alias("at"), pair.alias("p")))).alias("x"))
        text = F.concat(F.lit("<chapter><title></title>"), F.array_join(F.col("x.p"), ""), F.lit("</chapter>"))
        out = chunks.select("doc_id", "chunk_index").join(made, ["doc_id", "chunk_index"], "left")
        return out.select("doc_id", "chunk_index", F.coalesce(text, F.lit("<empty></empty>")).alias("output"))


class CallLedger:
    """Answers of a model that were paid for, kept by prompt: each wave of calls is a table of its own below a folder.

    A call's name is a digest of its options, its turn and its prompt. Whatever job asks, in whatever session, an
    answered name is never asked again; calls that failed are.
    """

    SCHEMA = "call string, output string, attempt int, success boolean, error string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def rows(self) -> DataFrame:
        """All calls; waves that were not written in full are not there."""
        self.spark.createDataFrame([], self.SCHEMA).write.mode("append").parquet(f"{self.path}/wave=none")  # the folder is there before the first wave
        return self.spark.read.schema(self.SCHEMA).option("recursiveFileLookup", "true").parquet(self.path)

    def answered(self) -> DataFrame:
        """(call, output, attempt): one answer for each call that succeeded."""
        return self.rows().where("success").groupBy("call").agg(F.min_by(F.struct("output", "attempt"), F.struct("attempt", "output")).alias("x")).select("call", "x.output", "x.attempt")

    def write(self, calls: DataFrame) -> None:
        calls.write.parquet(f"{self.path}/wave={uuid.uuid4().hex}")


class CallProvider:
    """Asks a function (prompt -> answer) once for each chunk, on at most ``workers`` tasks, with retries after ``delays`` seconds.

    Answers should be written to a table before they are used twice; ReplayProvider then reads that table.

    ledger: a folder that driver and executors share. Then calls go in waves of ``workers`` times ``per_worker``, each of
    which is written before the next begins: a job that is killed loses its last wave at most, and started again it
    asks only what has no answer yet; equal prompts are asked once. ``point`` is called before each wave, to wait or to stop there.
    """

    def __init__(self, ask: Callable[..., str], workers: int = 5, attempts: int = 3, delays: tuple[float, ...] = DELAYS, options: dict | None = None, ledger: str | None = None, per_worker: int = 1, point: Callable[[], None] | None = None):
        """options: keyword arguments of every call, such as EXTRACTION or CHAPTERS (how warm, how long, how many seconds)."""
        self.ask, self.workers, self.attempts, self.delays, self.options = ask, workers, attempts, delays, dict(options or {})
        self.ledger, self.per_worker, self.point = ledger, per_worker, point

    def _asked(self, prompts: DataFrame, keys: list[str]) -> DataFrame:
        """The key columns with (output, attempt, success, error) of each prompt; calls in flight at a time: workers."""
        ask, attempts, delays, options = self.ask, self.attempts, self.delays, self.options
        kinds = ", ".join(f"{k} {prompts.schema[k].dataType.simpleString()}" for k in keys)

        def one(prompt: str) -> tuple[str | None, int, bool, str | None]:
            error = None
            for turn in range(attempts):
                if turn and delays:
                    time.sleep(delays[min(turn, len(delays)) - 1])
                try:
                    return ask(prompt, **options), turn, True, None
                except Exception as e:  # the caller's function may fail in any way; the failure is recorded
                    error = str(e)
            return None, attempts - 1, False, error

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                got = pd.DataFrame([one(p) for p in pdf["prompt"]], columns=["output", "attempt", "success", "error"], dtype=object)
                yield pd.concat([pdf[keys].reset_index(drop=True), got], axis=1)

        dealt = prompts.select(*keys, "prompt").repartition(self.workers)
        return dealt.mapInPandas(run, f"{kinds}, output string, attempt int, success boolean, error string")

    def complete(self, prompts: DataFrame, attempt: int | None = None) -> DataFrame:
        if self.ledger is None:
            return self._asked(prompts, ["doc_id", "chunk_index"])
        spark = prompts.sparkSession
        ledger, options = CallLedger(spark, self.ledger), json.dumps(self.options, sort_keys=True, default=str)
        call = F.sha2(F.concat_ws("\n", F.lit(options), F.lit(str(attempt or 0)), "prompt"), 256)
        named = stored(prompts.select("doc_id", "chunk_index", "prompt", call.alias("call")), "calls")
        todo = named.select("call", "prompt").dropDuplicates(["call"]).join(ledger.answered().select("call"), "call", "left_anti")
        left = todo.count()
        waves = -(-left // (self.workers * self.per_worker))
        if left:
            path = scratch_path(spark, "call-waves")
            todo.withColumn("wave", F.pmod(F.xxhash64("call"), F.lit(waves)).cast("int")).repartition("wave").write.partitionBy("wave").parquet(path)
            for wave in range(waves):
                if self.point is not None:
                    self.point()
                mine = spark.read.schema("call string, prompt string, wave int").parquet(path).where(F.col("wave") == wave)  # one folder
                ledger.write(self._asked(mine, ["call"]))
            discard(spark, path)
        failed = ledger.rows().where("not success").groupBy("call").agg(F.max("error").alias("error"))
        rows = named.select("doc_id", "chunk_index", "call").join(ledger.answered(), "call", "left").join(failed, "call", "left")
        ok = F.col("attempt").isNotNull()
        return rows.select("doc_id", "chunk_index", "output", F.coalesce("attempt", F.lit(self.attempts - 1)).alias("attempt"), ok.alias("success"), F.when(~ok, F.col("error")).alias("error"))

    def answers(self, chunks: DataFrame, blocks: DataFrame, attempt: int | None = None) -> DataFrame:
        return self.complete(chunk_prompts(chunks, blocks), attempt)


def chunk_prompts(chunks: DataFrame, blocks: DataFrame, head: str = QUESTION_PROMPT) -> DataFrame:
    """(doc_id, chunk_index, prompt): the chunk's blocks as JSON after a head."""
    show = F.to_json(F.struct(*[c for c in ("id", "type", "text", "img_path", "image_caption") if c in blocks.columns]))
    rows = members_of(chunks).join(blocks.select("doc_id", "id", show.alias("_j")), ["doc_id", "id"])
    got = rows.groupBy("doc_id", "chunk_index").agg(F.sort_array(F.collect_list(F.struct("id", "_j"))).alias("x"))
    return got.select("doc_id", "chunk_index", F.concat(F.lit(head + "["), F.array_join(F.col("x._j"), ","), F.lit("]")).alias("prompt"))


_DIRECTORY = """List the chapters and sections of the outline below. A line begins with its id and page in brackets.
Answer with JSON only: {"directory": [{"id": 12, "level": 1, "title": "..."}]}; id is a list where a heading runs over several lines.
Levels are 1 (chapter), 2 (section), 3 and 4 (below). Leave out contents pages, running heads, kinds of exercises, single questions, formulas and imprints.
"""
_WINDOW = """Some headings of the pages below may have been missed. A line begins with its id and page in brackets.
Answer with JSON only: {"headings": [{"block_id": 12, "title": "...", "level": 1}]}, levels 1 to 4, an empty list if there is none.
"""


def directory_prompt(outline: str, known: list[dict] | None = None) -> str:
    """The prompt for a directory of chapters over an outline; with entries: for its check."""
    return _DIRECTORY + ("" if known is None else "Check and complete:\n" + json.dumps({"directory": known}, ensure_ascii=False) + "\n") + outline


def directory_prompts(parts: DataFrame, blocks: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, chunk_index, prompt) for parts (doc_id, chunk_index, start_id, end_id) of outlines; known: only parts with entries, for their check.

    Blocks, or their lines (doc_id, id, line) where these were made before.
    """
    lines = blocks if "line" in blocks.columns else outline_lines(blocks)
    rows = members_of(parts).join(lines, ["doc_id", "id"]).withColumn("doc_id", _part())
    outlines = full_text(rows.select("doc_id", "id", "line"))
    out = outlines.select("doc_id.doc_id", "doc_id.chunk_index", "outline")
    if known is None:
        return out.select("doc_id", "chunk_index", F.concat(F.lit(_DIRECTORY), "outline").alias("prompt"))
    entry = F.to_json(F.struct(F.col("ids").alias("id"), "level", "title"))
    shown = known.groupBy("doc_id", "chunk_index").agg(F.sort_array(F.collect_list(F.struct("ord", entry.alias("j")))).alias("x"))
    listed = F.concat(F.lit(_DIRECTORY + 'Check and complete:\n{"directory": ['), F.array_join(F.col("x.j"), ", "), F.lit("]}\n"), F.col("outline"))
    return out.join(shown, ["doc_id", "chunk_index"]).select("doc_id", "chunk_index", listed.alias("prompt"))


def window_prompts(windows: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, prompt) for page windows (doc_id, start_page, end_page); chunk_index is the first page."""
    pages = windows.select("doc_id", F.col("start_page").alias("chunk_index"), F.explode(F.sequence("start_page", "end_page")).alias("page_idx"))
    rows = pages.join(blocks, ["doc_id", "page_idx"]).withColumn("doc_id", _part())
    outlines = full_text(rows.select("doc_id", "id", "type", "text", "page_idx", "text_level"))
    return outlines.select("doc_id.doc_id", "doc_id.chunk_index", F.concat(F.lit(_WINDOW), "outline").alias("prompt"))


def _part() -> Column:
    """A part of a document as a key of its own, where operators work document by document."""
    return F.struct("doc_id", "chunk_index")
