"""Extracted questions: de-duplication, chapter titles, quality."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.predicates import TitleRules, good_question, has_noise, structural_title, title_valid
from pageloom.functions.text import label_number, question_kind, refine_title
from pageloom.operators.answers import id_list

THRESHOLD = 0.5


def id_overlaps(questions: DataFrame, key: str = "seq", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, a, b, jaccard): pairs of one document whose id sets overlap that much; only sets with a common id meet."""
    sets = questions.select("doc_id", F.col(key).alias("k"), F.array_distinct(F.filter(id_list(F.col("question_ids")), lambda x: x.isNotNull())).alias("s")).where("size(s) > 0")
    flat = sets.select("doc_id", "k", F.size("s").alias("n"), F.explode("s").alias("id"))
    a, b = flat.select("doc_id", "id", F.col("k").alias("a"), F.col("n").alias("na")), flat.select("doc_id", "id", F.col("k").alias("b"), F.col("n").alias("nb"))
    pairs = a.join(b, ["doc_id", "id"]).where("a < b").groupBy("doc_id", "a", "b", "na", "nb").agg(F.count("*").alias("i"))
    score = F.col("i") / (F.col("na") + F.col("nb") - F.col("i"))
    return pairs.select("doc_id", "a", "b", score.alias("jaccard")).where(F.col("jaccard") >= threshold)


def greedy_keep(id_sets: list[set[int]], threshold: float = THRESHOLD) -> list[int]:
    """Positions kept, in the places of the results: the first kept one that overlaps is the match; a larger set takes its place.

    Only kept sets with a common id are looked at; places are found by id.
    """
    kept: list[int] = []
    places: dict[int, set[int]] = {}
    for i, s in enumerate(id_sets):
        for at in sorted(set().union(*[places.get(x, ()) for x in s])):
            other = id_sets[kept[at]]
            both = len(s & other)
            if both and both / (len(s) + len(other) - both) >= threshold:
                if len(s) > len(other):
                    kept[at] = i
                    for x in s:
                        places.setdefault(x, set()).add(at)
                break
        else:
            for x in s:
                places.setdefault(x, set()).add(len(kept))
            kept.append(i)
    return kept


def greedy_dedup(questions: DataFrame, order: str = "seq", threshold: float = THRESHOLD) -> DataFrame:
    """questions with overlapping ones merged greedily in order, within each document.

    Only places and ids go through the fold; the kept places then meet the whole rows. A larger question stands where
    the smaller one stood.
    """
    kind, place = questions.schema["doc_id"].dataType.simpleString(), questions.schema[order].dataType.simpleString()
    ids = F.filter(id_list(F.col("question_ids")), lambda x: x.isNotNull())
    lists = questions.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.col(order).cast("long").alias("k"), ids.alias("ids")))).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, old, new = [], [], []
            for i, (ks, sets) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                keep = greedy_keep([set(s) for s in sets], threshold)
                which += [i] * len(keep)
                old += [ks[j] for j in keep]
                new += sorted(ks[j] for j in keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int32())), pa.array(old, pa.int64()), pa.array(new, pa.int64())], names=["doc_id", "_old", "_new"])

    kept = lists.select("doc_id", F.col("x.k").alias("k"), F.col("x.ids").alias("ids")).mapInArrow(run, f"doc_id {kind}, _old long, _new long")
    rows = questions.join(kept, (questions["doc_id"].eqNullSafe(kept["doc_id"])) & (questions[order] == kept["_old"]))
    return rows.select(*[F.col("_new").cast(place).alias(order) if c == order else questions[c] for c in questions.columns])


def typed(questions: DataFrame) -> DataFrame:
    return questions.withColumn("type", F.when(F.col("type").isin("example", "exercise"), F.col("type")).otherwise(question_kind("label")))


def merged_title(pre: str, own: str, rules: TitleRules = TitleRules()):
    """The chapter title of a question: of the tree's path and the model's title, the valid one, structure first, path first."""
    p, o = F.col(pre), F.col(own)
    p_ok, o_ok = title_valid(p, rules), title_valid(o, rules)
    p_struct, o_struct = p_ok & structural_title(p, rules), o_ok & structural_title(o, rules)
    return F.when(p_ok & o_ok, F.when(~p_struct & o_struct, o).otherwise(p)).when(p_ok, p).when(o_ok, o).otherwise("")


def steady_titles(questions: DataFrame, order: str = "seq", noise: list[str] | None = None) -> DataFrame:
    """Noise titles in a run of consecutive labels go back to the last good one."""
    noise = TitleRules().noise if noise is None else noise
    w = Window.partitionBy("doc_id").orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    t, n = F.coalesce("chapter_title", F.lit("")), label_number("label")
    good = F.last(F.when((t != "") & ~has_noise(t, noise), t), ignorenulls=True).over(before)
    previous = F.lag(n).over(w)
    back = (previous != -1) & (n == previous + 1) & good.isNotNull() & (t != "") & (t != good) & has_noise(t, noise)
    return questions.withColumn("chapter_title", F.when(back, good).otherwise(F.col("chapter_title")))


def filled_titles(questions: DataFrame, order: str = "seq", noise: list[str] | None = None, aggressive: bool = False) -> DataFrame:
    """Titles refined; noise and empty ones take the last good one before them."""
    noise = TitleRules().noise if noise is None else noise
    before = Window.partitionBy("doc_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = questions.withColumn("_t", refine_title("chapter_title", aggressive))
    bad = has_noise("_t", noise) | (F.col("_t") == "")
    good = F.last(F.when(~bad, F.col("_t")), ignorenulls=True).over(before)
    return rows.withColumn("chapter_title", F.when(bad, F.coalesce(good, F.col("_t"))).otherwise(F.col("_t"))).drop("_t")


def quality_filtered(questions: DataFrame) -> DataFrame:
    return questions.where(good_question("question", "label"))
