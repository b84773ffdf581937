"""The whole way from layout blocks to question tables, for many documents in one job."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.predicates import SanityRules, TitleRules, sanity_verdict
from pageloom.operators import anchors, answers, blocks as block_ops, chapters, chunking, questions
from pageloom.operators.exports import write_stage
from pageloom.plans.providers import DELAYS, Provider, directory_prompts, window_prompts
from pageloom.session import scope, spread, stored


@dataclass(frozen=True)
class Settings:
    """chunk_size to sanity as in the operators; attempts: how often a chunk is asked at most; delays: seconds before each
    further attempt; debug: a folder for prompts' blocks, raw answers, verdicts and parsed answers (none: not kept);
    point: called before each attempt, to wait or to stop there.
    """

    chunk_size: int = chunking.SIZE
    overlap: int = chunking.OVERLAP
    budget: int = chunking.BUDGET
    image_prefix: str = ""
    titles: TitleRules = field(default_factory=TitleRules)
    sanity: SanityRules = field(default_factory=SanityRules)
    attempts: int = 4
    delays: tuple[float, ...] = DELAYS
    debug: str | None = None
    point: Callable[[], None] | None = None


def checked(parsed: DataFrame, chunks: DataFrame, blocks: DataFrame, rules: SanityRules = SanityRules()) -> DataFrame:
    """(doc_id, chunk_index, verdict): chunks whose answer should be asked for again have another verdict than ok."""
    t = F.coalesce("text", F.lit(""))
    marks = blocks.select("doc_id", "id", t.rlike(rules.numeric_label).alias("num"), t.rlike(rules.example_label).alias("ex"))
    inside = chunking.members_of(chunks).join(marks, ["doc_id", "id"])
    stats = inside.groupBy("doc_id", "chunk_index").agg(F.count("*").alias("blocks"), F.bool_or("num").alias("num"), F.bool_or("ex").alias("ex"))
    found = parsed.groupBy("doc_id", "chunk_index").agg(F.count("*").alias("n"))
    rows = stats.join(found, ["doc_id", "chunk_index"], "left")
    return rows.select("doc_id", "chunk_index", sanity_verdict(F.coalesce("n", F.lit(0)), F.col("blocks"), F.col("num"), F.col("ex"), rules).alias("verdict"))


def asked_until_sane(provider: Provider, chunks: DataFrame, blocks: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Parsed answers of all chunks. Those without an answer or with a verdict other than ok are asked again, with growing
    delays; what the last attempt gives is taken as it is.

    Each attempt is one job over the chunks still open; its answers are written before they are read more than once, in
    as many parts as the blocks have, since an answer is short but much work.
    """
    taken: list[DataFrame] = []
    left = stored(chunks.select("doc_id", "chunk_index", "start_id", "end_id"), "chunks")
    attempts = settings.attempts if getattr(provider, "repeatable", True) else 1
    for attempt in range(attempts):
        if settings.point is not None:
            settings.point()
        if attempt and settings.delays:
            time.sleep(settings.delays[min(attempt, len(settings.delays)) - 1])
        raw = stored(spread(provider.answers(left, blocks, attempt), blocks, "doc_id", "chunk_index"), f"answers-{attempt}")
        parsed = stored(answers.parse_answers(raw), f"parsed-{attempt}")
        if attempts == 1 and settings.debug is None:
            return parsed
        verdicts = checked(parsed, left, blocks, settings.sanity)
        failed = raw.where("output is null").select("doc_id", "chunk_index").withColumn("none", F.lit(True))
        verdicts = stored(verdicts.join(failed, ["doc_id", "chunk_index"], "left").select("doc_id", "chunk_index", F.when(F.col("none"), "no_answer").otherwise(F.col("verdict")).alias("verdict")), f"verdicts-{attempt}")
        if settings.debug is not None:
            for name, rows in (("raw", raw), ("parsed", parsed), ("verdicts", verdicts)):
                write_stage(rows, settings.debug, f"{name}-{attempt}")
        again = verdicts.where("verdict <> 'ok'").select("doc_id", "chunk_index")
        if attempt == attempts - 1 or again.isEmpty():
            taken.append(parsed)
            break
        taken.append(parsed.join(again, ["doc_id", "chunk_index"], "left_anti"))
        left = stored(left.join(again, ["doc_id", "chunk_index"], "left_semi"), f"chunks-{attempt}")
    out = taken[0]
    for part in taken[1:]:
        out = out.unionByName(part)
    return out


def extract_questions(blocks: DataFrame, provider: Provider, tree: DataFrame | Callable[[DataFrame], DataFrame] | None = None, settings: Settings = Settings()) -> DataFrame:
    """The question table of all documents: chunks, answers, texts, de-duplication, chapters, titles and quality.

    tree: chapters as from chapters.flat_map or anchors.rule_tree, or a function that makes them from the blocks as they
    are stored; none: titles come from the answers alone. Blocks and parsed answers are written once to the shared
    folder: they are used several times, and a model isn't asked twice.
    """
    blocks = stored(blocks, "blocks")
    for column in ("img_path", "image_caption"):
        if column not in blocks.columns:
            blocks = blocks.withColumn(column, F.lit(None).cast("string"))
    if settings.debug is not None:
        write_stage(blocks, settings.debug, "formatted_blocks")
    chunks = stored(chunking.token_chunks(blocks, settings.chunk_size, settings.overlap, settings.budget), "chunks")
    parsed = asked_until_sane(provider, chunks, blocks, settings)
    rows = answers.questions_of(parsed, blocks, chunks, settings.image_prefix)
    rows = stored(rows.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index", "pos"))), "questions")
    rows = questions.typed(questions.greedy_dedup(rows))
    if tree is not None:
        tree = tree(blocks) if callable(tree) else tree
        first = rows.withColumn("first_id", answers.id_list(F.col("question_ids"))[0])
        rows = chapters.chapter_of(first, chapters.chapter_paths(tree), "first_id", "path").drop("first_id")
    else:
        rows = rows.withColumn("path", F.lit(None).cast("string"))
    rows = rows.withColumn("chapter_title", questions.merged_title("path", "chapter_title", settings.titles)).drop("path")
    rows = questions.filled_titles(questions.steady_titles(rows, noise=settings.titles.noise), noise=settings.titles.noise)
    return questions.quality_filtered(rows)


def write_questions(blocks: DataFrame, provider: Provider, path: str, tree: DataFrame | Callable[[DataFrame], DataFrame] | None = None, settings: Settings = Settings()) -> None:
    """The question table written to ``path``; the tables that the way there needed are gone afterwards."""
    with scope(blocks.sparkSession):
        extract_questions(blocks, provider, tree, settings).write.parquet(path)


def chapters_from_answers(round1: DataFrame, round2: DataFrame | None, blocks: DataFrame, rules: TitleRules = TitleRules()) -> DataFrame:
    """The chapter tree from one or two rounds of directory answers (doc_id, output), cleaned and checked."""

    def clean(raw: DataFrame) -> DataFrame:
        entries = stored(answers.directory_entries(raw).where("ok").drop("ok"), "directory")
        entries = stored(chapters.first_wins(chapters.map_local_ids(entries, blocks)), "entries")
        entries = entries.join(chapters.drifted(entries, blocks), "doc_id", "left_anti")
        return stored(chapters.cleaned(entries, blocks, rules).where("reason is null").drop("reason"), "cleaned")

    entries = clean(round1)
    if round2 is not None:
        second = answers.directory_entries(round2).where("ok").drop("ok")
        second = stored(chapters.first_wins(chapters.map_local_ids(second, blocks)), "second")
        entries = stored(chapters.cleaned(chapters.accept_second(entries, second), blocks, rules).where("reason is null").drop("reason"), "accepted")
    return checked_tree(entries, blocks)


def checked_tree(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """The tree of the documents whose entries pass the checks."""
    good = chapters.validation(entries, blocks).where("verdict = 'ok'").select("doc_id")
    return chapters.flat_map(entries.join(good, "doc_id", "left_semi"), blocks)


def outline_parts(blocks: DataFrame, context: int = 128_000, lines: DataFrame | None = None) -> DataFrame:
    """(doc_id, chunk_index, start_id, end_id, mode): one part for a document whose outline fits in a prompt, else its chunks; lines: of the outline, if made before."""
    modes = document_mode(block_ops.full_text(blocks if lines is None else lines), context).select("doc_id", "mode")
    whole = blocks.groupBy("doc_id").agg(F.min("id").alias("start_id"), F.max("id").alias("end_id")).join(modes.where("mode = 'whole'"), "doc_id")
    chunked = chunking.outline_chunks(blocks, int(context * 0.8)).join(modes.where("mode = 'chunked'"), "doc_id")
    return whole.select("doc_id", F.lit(0).alias("chunk_index"), "start_id", "end_id", "mode").unionByName(chunked)


def model_chapters(blocks: DataFrame, first: Provider, second: Provider | None = None, context: int = 128_000, attempts: int = 2, rules: TitleRules = TitleRules(), debug: str | None = None) -> DataFrame:
    """Chapter trees by a model: a first round finds entries in outlines, a second one checks them.

    Documents whose outline is over the limit go part by part; an id that is none of the part's is read as a place in
    it. A second round counts where it has 0.8 of a whole document's entries at least, or 0.5 of a part's. An answer
    that can't be read is asked for again, ``attempts`` times in all. The outline's lines are made and written once.
    """
    blocks = stored(blocks, "chapter-blocks")
    lines = stored(block_ops.outline_lines(blocks), "outline-lines")
    parts = stored(outline_parts(blocks, context, lines), "parts")
    key = F.struct("doc_id", "chunk_index")
    offered = stored(chunking.members_of(parts).join(blocks.select("doc_id", "id"), ["doc_id", "id"]).select(key.alias("doc_id"), "id"), "offered")

    def ask(provider: Provider, prompts: DataFrame, name: str) -> DataFrame:
        """(doc_id, chunk_index, ord, ids, level, title) of all answers that can be read."""
        got: list[DataFrame] = []
        left = stored(prompts, f"{name}-prompts")
        for attempt in range(attempts):
            raw = stored(provider.complete(left, attempt), f"{name}-{attempt}")
            if debug is not None:
                write_stage(left, debug, f"{name}-prompts-{attempt}")
                write_stage(raw, debug, f"{name}-{attempt}")
            read = stored(answers.directory_entries(raw.select("doc_id", "chunk_index", "output"), ("doc_id", "chunk_index")), f"{name}-read-{attempt}")
            got.append(read.where("ok and ids is not null").drop("ok"))
            open_ = read.where("not ok").select("doc_id", "chunk_index").distinct()
            if attempt == attempts - 1 or open_.isEmpty():
                break
            left = stored(left.join(open_, ["doc_id", "chunk_index"], "left_semi"), f"{name}-again-{attempt}")
        out = got[0]
        for more in got[1:]:
            out = out.unionByName(more)
        placed = chapters.map_local_ids(out.withColumn("doc_id", key).drop("chunk_index"), offered, offered)
        return placed.select("doc_id.doc_id", "doc_id.chunk_index", *[c for c in placed.columns if c != "doc_id"])

    def merged(entries: DataFrame) -> DataFrame:
        """Entries of all parts in order, one for each primary id."""
        w = Window.partitionBy("doc_id").orderBy("chunk_index", "ord")
        return stored(chapters.first_wins(entries.withColumn("ord", (F.row_number().over(w) - 1).cast("int"))), "entries")

    entries = merged(ask(first, directory_prompts(parts, lines), "round1"))
    entries = stored(chapters.cleaned(entries, blocks, rules).where("reason is null").drop("reason", "chunk_index"), "cleaned")
    if second is not None:
        members = chunking.members_of(parts).select("doc_id", "chunk_index", "id")
        known = stored(entries.withColumn("id", F.col("ids")[0]).join(members, ["doc_id", "id"]).drop("id"), "known")
        checked_entries = stored(ask(second, directory_prompts(parts, lines, known), "round2"), "round2-entries")
        share = parts.select("doc_id", "chunk_index", F.when(F.col("mode") == "whole", 0.8).otherwise(0.5).alias("share"))
        n1 = known.groupBy("doc_id", "chunk_index").agg(F.count("*").alias("n1"))
        n2 = checked_entries.groupBy("doc_id", "chunk_index").agg(F.count("*").alias("n2"))
        good = n1.join(n2, ["doc_id", "chunk_index"]).join(share, ["doc_id", "chunk_index"]).where("n2 >= share * n1").select("doc_id", "chunk_index")
        both = checked_entries.join(good, ["doc_id", "chunk_index"], "left_semi").unionByName(known.join(good, ["doc_id", "chunk_index"], "left_anti"))
        entries = stored(chapters.cleaned(merged(both).drop("chunk_index"), blocks, rules).where("reason is null").drop("reason"), "accepted")
    return checked_tree(entries, blocks)


def document_mode(outlines: DataFrame, context: int = 128_000) -> DataFrame:
    """(doc_id, tokens, mode): whether a document's outline fits in one prompt."""
    from pageloom.functions.text import document_tokens

    tokens = document_tokens(F.col("outline"))
    return outlines.select("doc_id", tokens.alias("tokens"), F.when(tokens <= int(context * 0.8), "whole").otherwise("chunked").alias("mode"))


def rule_chapters(blocks: DataFrame, scanner: Provider | None = None) -> DataFrame:
    """Chapters by rules. A scanner looks for missed headings in documents without contents pages, in windows of the pages
    that are far from any sure heading; without one no model is asked."""
    if scanner is None:
        return anchors.rule_tree(blocks)
    blocks = stored(blocks.select(*anchors.TREE_COLUMNS), "scanned-blocks")
    found = stored(anchors.rule_anchors(blocks), "anchors")
    alone = anchors.dispatch(blocks).where("use_model").select("doc_id")
    gaps = anchors.gap_regions(blocks.join(alone, "doc_id", "left_semi"), found)
    windows = stored(anchors.page_windows(gaps), "windows")
    said = stored(scanner.complete(window_prompts(windows, blocks), 0), "window-answers")
    more = anchors.window_headings(said.select("doc_id", F.col("chunk_index").alias("start_page"), "output"), windows, blocks)
    return anchors.anchor_tree(anchors.merge_anchors(found.unionByName(more)), blocks)
