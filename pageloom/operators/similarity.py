"""Candidates for comparing texts of one document by their words, without meeting every text that shares any word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words(text: Column | str) -> Column:
    return F.split(text, r"\s+")


def _rare_first(distinct: Column) -> Column:
    """Words in one order for all texts, the longest first: short words, which most texts share, come last."""
    return F.transform(F.sort_array(F.transform(distinct, lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w")))), lambda x: x["w"])


def prefix_words(distinct: Column, tenths: int) -> Column:
    """The words of a set of which a set with a Jaccard likeness above tenths / 10 must share one, by the order of rare words first.

    Such a set shares more than tenths / 10 of the words, so it can't miss all but so many of them.
    """
    n = F.size(distinct)
    return F.slice(_rare_first(distinct), 1, n - F.floor(n * tenths / 10).cast("int"))


def much_alike(a: Column, b: Column, tenths: int) -> Column:
    """Whether two sets of words have a Jaccard likeness above tenths / 10; sizes are compared first."""
    na, nb, both = F.size(a), F.size(b), F.size(F.array_intersect(a, b))
    return (10 * na > tenths * nb) & (10 * nb > tenths * na) & (10 * both > tenths * (na + nb - both))


def similar_pairs(a: DataFrame, b: DataFrame, tenths: int) -> DataFrame:
    """(doc_id, a_id, b_id) of pairs with a Jaccard likeness above tenths / 10; a: (doc_id, a_id, wa), b: (doc_id, b_id, wb), sets of words.

    Pairs meet by a word of both prefixes, are dropped by the sizes of their sets, and are verified on the sets.
    """
    left = a.select("doc_id", "a_id", "wa", F.explode(prefix_words(F.col("wa"), tenths)).alias("word"))
    right = b.select("doc_id", "b_id", "wb", F.explode(prefix_words(F.col("wb"), tenths)).alias("word"))
    na, nb = F.size("wa"), F.size("wb")
    met = left.join(right, ["doc_id", "word"]).where((10 * na > tenths * nb) & (10 * nb > tenths * na))
    both = F.size(F.array_intersect("wa", "wb"))
    return met.where(10 * both > tenths * (na + nb - both)).select("doc_id", "a_id", "b_id").distinct()


def _inner(w: Column, n: int, mark: str) -> Column:
    """(length, key) for each run of n words without the first and the last word: the run between how the word before ends and the one after begins."""
    at = F.when(F.size(w) > n + 1, F.sequence(F.lit(1), F.size(w) - n - 1)).otherwise(F.array().cast("array<int>"))
    run = lambda i: F.array_join(F.slice(w, i + 1, n), " ")
    key = lambda i: F.concat(F.lit(f"{mark}{n} "), F.right(F.get(w, i - 1), F.lit(1)), F.lit(" "), run(i), F.lit(" "), F.substring(F.get(w, i + n), 1, 1))
    return F.transform(at, lambda i: F.struct(F.length(run(i)).alias("l"), key(i).alias("k")))


def _all_inner(w: Column, mark: str) -> Column:
    return F.array_distinct(F.concat(_inner(w, 1, mark)["k"], _inner(w, 2, mark)["k"]))


def _best_inner(w: Column, mark: str) -> Column:
    """The longest run of two inner words, or the inner word where there is but one."""
    return F.when(F.size(w) > 3, F.array_max(_inner(w, 2, mark))["k"]).otherwise(F.array_max(_inner(w, 1, mark))["k"])


def _joints(w: Column, mark: str) -> Column:
    """Two keys for each pair of neighbours: the first word with how the second begins, and how the first ends with the second."""
    at = F.when(F.size(w) > 1, F.sequence(F.lit(1), F.size(w) - 1)).otherwise(F.array().cast("array<int>"))
    one = F.transform(at, lambda i: F.concat(F.lit(f"{mark}< "), F.get(w, i - 1), F.lit(" "), F.substring(F.get(w, i), 1, 1)))
    two = F.transform(at, lambda i: F.concat(F.lit(f"{mark}> "), F.right(F.get(w, i - 1), F.lit(1)), F.lit(" "), F.get(w, i)))
    return F.concat(one, two)


def _marked(w: Column, mark: str) -> Column:
    return F.transform(w, lambda x: F.concat(F.lit(f"{mark} "), x))


def containing_pairs(a: DataFrame, b: DataFrame, longest: int = 120) -> DataFrame:
    """(doc_id, a_id, b_id): pairs one of whose texts may lie within the other, and that share a whole word.

    a: (doc_id, a_id, a), texts of ``longest`` characters at most; b: (doc_id, b_id, b), any texts. No such pair is left
    out, but of texts that score alike (equal ones of up to two words, and all that hold a text of one word) only the
    first of the best is kept, where the best is that with the fewest distinct words. A text within another has all its inner words
    there as whole words, so three words or more meet by one or two inner ones (with the letters beside them); two words
    meet at the joint of two words, one of which is whole; one word meets the best text with that word.
    """
    none = F.array().cast("array<string>")
    a = a.where("a <> ''").withColumn("w", words("a"))
    b = b.where("b <> ''").withColumn("w", words("b"))
    asks = F.concat(
        F.when(F.size("w") > 2, F.array(_best_inner(F.col("w"), "w"))).otherwise(none), F.when(F.size("w") == 2, _joints(F.col("w"), "a")).otherwise(none),
        F.when(F.size("w") == 1, _marked(F.col("w"), "1")).otherwise(none), _all_inner(F.col("w"), "i"), _marked(F.array_distinct("w"), "s"), _joints(F.col("w"), "b"),
    )
    asked = a.select("doc_id", "a_id", F.length("a").alias("la"), F.explode(F.array_distinct(asks)).alias("key"))

    held = F.array_distinct("w")
    holding = b.select("doc_id", "b_id", F.explode(F.concat(_all_inner(F.col("w"), "w"), F.when(F.size("w") > 1, _joints(F.col("w"), "a")).otherwise(none))).alias("key"), F.lit(0).alias("lb"))
    best = b.select("doc_id", F.explode(_marked(held, "1")).alias("key"), F.struct(F.size(held).alias("n"), "b_id").alias("x")).groupBy("doc_id", "key").agg(F.min("x")["b_id"].alias("b_id"))
    short = b.where(F.length("b") <= longest)
    few = short.where(F.size("w") <= 2).groupBy("doc_id", "b", "w").agg(F.min("b_id").alias("b_id"))
    within = short.where(F.size("w") > 2).select("doc_id", "b_id", _best_inner(F.col("w"), "i").alias("key"), F.length("b").alias("lb"))
    small = few.select("doc_id", "b_id", F.explode(F.when(F.size("w") == 1, _marked(F.col("w"), "s")).otherwise(_joints(F.col("w"), "b"))).alias("key"), F.length("b").alias("lb"))
    index = holding.unionByName(best.withColumn("lb", F.lit(0))).unionByName(within).unionByName(small)
    return asked.join(index, ["doc_id", "key"]).where("lb <= la").select("doc_id", "a_id", "b_id").distinct()


def number_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc_id, a_id, b_id) where b's text (t) begins with a's number (num) and a space or a dot."""
    number = F.regexp_extract("t", r"^(\d+(?:\.\d+)*)[ .]", 1)
    parts = F.split(number, r"\.")
    starts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))
    index = b.where(F.col("t").rlike(r"^\d+(\.\d+)*[ .]")).select("doc_id", "b_id", F.explode(starts).alias("num"))
    return a.where("num <> ''").select("doc_id", "a_id", "num").join(index, ["doc_id", "num"]).select("doc_id", "a_id", "b_id").distinct()
