"""Benchmark decontamination over a distributed positional inverted index; DataFrame operations only.

The index holds postings (term, document, position). A test phrase is looked up from its rarest terms: their posting
lists, shifted by the term's place in the phrase, must meet at one start; each common start is then checked word by
word, so terms can be named by hashes. Documents are named by a digest of their text: copies share one posting, and ids
may be null or repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import fold_ascii
from pageloom.session import cut

WINDOW = 10
#: Rarest terms of a window whose posting lists are intersected before the words are compared.
ANCHORS = 2
#: What lies between words of an ASCII-lowered text.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Names of texts with candidates are folded into so many buckets: a bounded filter that spares other texts the shuffle.
FILTER_BUCKETS = 1 << 20
#: Test terms go to every task only up to this many bytes; beyond it Spark joins them by shuffle.
BROADCAST_BYTES = 16 << 20


def _lowered(text: Column) -> Column:
    """A-Z lowered: the fast function where all is ASCII, else letter by letter."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(fold_ascii(text))


def pieces_of(text: Column) -> Column:
    """Words in order, with an empty piece before or after them where the text begins or ends with a gap.

    Splitting is far cheaper than matching. Places are counted in pieces throughout: a leading empty one shifts all.
    """
    return F.split(F.coalesce(_lowered(text), F.lit("")), GAP)


def _pieces(text: Column) -> tuple[Column, Column, Column]:
    """(pieces, one for a leading empty piece, number of words)."""
    pieces = pieces_of(text)
    first = (F.element_at(pieces, 1) == "").cast("int")
    last = ((F.size(pieces) > 1) & (F.element_at(pieces, -1) == "")).cast("int")
    return pieces, first, F.size(pieces) - first - last


def words_of(text: Column) -> Column:
    """Words of the ASCII-lowered text; null has none."""
    pieces, first, n = _pieces(text)
    return F.slice(pieces, first + 1, n)


def n_words(text: Column) -> Column:
    return _pieces(text)[2].cast("long")


def _small(df: DataFrame, size: Column) -> DataFrame:
    """The frame with a broadcast hint, if its measured size is within the bound."""
    n, b = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if b + 64 * n <= BROADCAST_BYTES else df


def phrases(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, w, phrase): every window of an item's words; an item of fewer words is one window."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where("size(words) > 0")
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - window)))
    rows = items.select("item_id", "words", starts.alias("at"))
    rows = rows.select("item_id", F.slice("words", F.col("at") + 1, window).alias("phrase")).distinct()
    return rows.withColumn("w", F.xxhash64("phrase"))


def keyed_docs(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text); key: 128 bits of the text's digest."""
    return docs.select("doc_id", F.coalesce(F.md5("text"), F.lit("")).alias("key"), "text")


def test_terms(windows: DataFrame) -> DataFrame:
    return windows.select(F.explode("phrase").alias("word")).select(F.xxhash64("word").alias("term")).distinct()


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): occurrences in all documents of each given term (zero if none). A term is its word's 64-bit hash."""
    flat = docs.select(F.explode(pieces_of(F.col("text"))).alias("word")).select(F.xxhash64("word").alias("term"))
    hits = flat.join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    return terms.join(hits, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index (term, key, pos) over all documents for the given terms; copies of a text share their postings."""
    flat = docs.select("key", F.posexplode(pieces_of(F.col("text"))).alias("pos", "word")).select("key", "pos", F.xxhash64("word").alias("term"))
    return flat.join(terms, "term", "left_semi").distinct()


def anchored(windows: DataFrame, counts: DataFrame, anchors: int) -> DataFrame:
    """(w, term, offset, k): the rarest terms of each distinct window (ties: the first place)."""
    flat = windows.select("w", "phrase").distinct().select("w", F.posexplode("phrase").alias("offset", "word")).select("w", "offset", F.xxhash64("word").alias("term"))
    placed = flat.join(counts, "term").groupBy("w").agg(F.sort_array(F.collect_list(F.struct("n", "offset", "term"))).alias("t"), F.min("n").alias("least"))
    best = placed.where("least > 0").select("w", F.slice("t", 1, anchors).alias("t"))
    return best.select("w", F.explode("t").alias("t"), F.size("t").alias("k")).select("w", F.col("t.term").alias("term"), F.col("t.offset").alias("offset"), "k")


def phrase_matches(docs: DataFrame, windows: DataFrame, anchors: int = ANCHORS) -> DataFrame:
    """(key, w, start, length): every exact occurrence of a window in a distinct document text."""
    terms = _small(cut(test_terms(windows)), F.lit(8))
    counts = cut(term_counts(docs, terms))
    lookups = cut(anchored(windows, counts, anchors))
    index = postings(docs, _small(lookups.select("term").distinct(), F.lit(8)))
    asked = _small(lookups, F.lit(24))
    starts = index.join(asked, "term").select("key", "w", F.expr("pos - offset").alias("start"), "offset", "k")
    starts = starts.where("start >= 0").groupBy("key", "w", "start").agg(F.count("*").alias("met"), F.max("k").alias("k")).where("met = k")
    starts = cut(starts.select("key", "w", "start"))
    # the other words of the phrase are compared in the texts that have common starts; a filter of bounded size lets few others pass
    bucket = lambda: F.pmod(F.xxhash64("key"), F.lit(FILTER_BUCKETS)).cast("int")
    passed = F.broadcast(starts.select(bucket().alias("bucket")).distinct())
    texts = docs.select("key", "text", bucket().alias("bucket")).join(passed, "bucket", "left_semi").select("key", pieces_of(F.col("text")).alias("words"))
    wanted = windows.select("w", "phrase").distinct()
    sizes = _small(wanted.groupBy("w").agg(F.max(F.size("phrase")).alias("n")), F.lit(12))
    held = starts.join(sizes, "w").groupBy("key").agg(F.collect_list(F.struct("w", "start", "n")).alias("c"))  # three numbers for a place of the text
    same = F.filter("c", lambda x: F.xxhash64(F.slice("words", x["start"] + 1, x["n"])) == x["w"])
    checked = texts.join(held, "key").select("key", F.transform(same, lambda x: F.struct(x["w"], x["start"], F.slice("words", x["start"] + 1, x["n"]).alias("found"))).alias("ok"))
    hits = checked.select("key", F.explode("ok").alias("x")).select("key", "x.w", "x.start", "x.found")
    exact = hits.join(_small(wanted, F.octet_length(F.array_join("phrase", " "))), "w").where("found = phrase")
    return exact.select("key", "w", "start", F.size("phrase").alias("length")).distinct()


def _in_order(phrase: Column, words: Column) -> Column:
    """How many words of a phrase (60 at most) occur in order among the words: the longest common subsequence, a bit for each word of the phrase."""
    full = F.lit((1 << 62) - 1)
    ones = lambda y: F.aggregate(F.transform(phrase, lambda p, i: F.when(p == y, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    def step(row, y):
        met = F.struct(row.alias("v"), row.bitwiseAND(ones(y)).alias("u"))
        return F.transform(F.array(met), lambda m: (m["v"] + m["u"]).bitwiseOR(m["v"] - m["u"]).bitwiseAND(full))[0]

    return F.lit(62) - F.bit_count(F.aggregate(words, full, step))


def proximity_matches(docs: DataFrame, windows: DataFrame, slack: int, missing: int = 1) -> DataFrame:
    """(key, w, start): places of distinct texts near which all but ``missing`` words of a window stand in its order,
    within ``slack`` extra words; start is where its first word would be.

    A near match has one at least of any missing + 1 words of the window, so the postings of its missing + 1 rarest words
    (absent ones have none) give all candidates; each is then checked with all its words. A window of no more than
    ``missing`` words needs one of them. Windows have 60 words at most.
    """
    keyed = keyed_docs(docs)
    terms = _small(cut(test_terms(windows)), F.lit(8))
    counts = cut(term_counts(keyed, terms))
    flat = windows.select("w", "phrase").distinct().select("w", F.posexplode("phrase").alias("offset", "word")).select("w", "offset", F.xxhash64("word").alias("term")).join(counts, "term")
    rarest = F.slice(F.sort_array(F.collect_list(F.struct("n", "offset", "term"))), 1, missing + 1)
    lookups = cut(flat.groupBy("w").agg(rarest.alias("t")).select("w", F.explode("t").alias("t")).select("w", "t.term", "t.offset"))
    index = postings(keyed, _small(lookups.select("term").distinct(), F.lit(8)))
    starts = index.join(_small(lookups, F.lit(24)), "term").select("key", "w", F.expr("pos - offset").alias("start")).distinct()
    wanted = windows.select("w", "phrase").distinct()
    texts = keyed.dropDuplicates(["key"]).select("key", pieces_of(F.col("text")).alias("words"))
    near = starts.join(texts, "key").join(wanted, "w")
    first = F.greatest(F.lit(0), F.col("start") - slack)
    around = F.slice("words", first + 1, F.least(F.size("words"), F.col("start") + F.size("phrase") + slack) - first)
    near = near.select("key", "w", "start", "phrase", around.alias("around"))
    # some run of the window's length and the slack holds the words: each beginning within the slack on either side is tried
    runs = F.transform(F.sequence(F.lit(0), F.lit(2 * slack)), lambda i: _in_order(F.col("phrase"), F.slice("around", i + 1, F.size("phrase") + slack)))
    return near.where(F.array_max(runs) >= F.greatest(F.lit(1), F.size("phrase") - missing)).select("key", "w", "start").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, anchors: int = ANCHORS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of documents.

    Null and empty texts have no words; null benchmark texts have no windows; an item_id that is null marks words but
    is not listed; repeated rows give repeated results, and repeated items count once by id. Other columns are ignored.
    """
    keyed = keyed_docs(docs)
    windows = cut(phrases(benchmark, window))
    found = cut(phrase_matches(keyed, windows, anchors))
    spans = found.groupBy("key", "start").agg(F.max("length").alias("length"))
    spans = spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("s"))
    covered = F.aggregate("s", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), _cover, lambda a: a["n"])
    hits = spans.select("key", covered.cast("long").alias("n_hit"))
    items = found.select("key", "w").distinct().join(windows.select("w", F.col("item_id").cast("string").alias("item")).distinct(), "w").select("key", "item").distinct()
    items = items.groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    per_text = cut(hits.join(items, "key", "left"))  # so that the join below stands alone and a hot text can be split
    rows = keyed.select("doc_id", "key", n_words(F.col("text")).alias("n_words")).join(per_text, "key", "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def _cover(acc: Column, x: Column) -> Column:
    end = x["start"] + x["length"]
    return F.struct((acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], x["start"]))).alias("n"), F.greatest(acc["end"], end).alias("end"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of documents in which no window of any benchmark item occurs.

    Rows with null or empty texts, null ids and repeated rows are judged by their text alone and come through as they
    are; other columns may have any name. Items of null or empty text have no windows; an empty benchmark drops nothing.
    """
    name = "_hit"
    while name in docs.columns:
        name += "_"
    found = phrase_matches(keyed_docs(docs), cut(phrases(benchmark, window))).select(F.col("key").alias(name)).distinct()
    return docs.join(found, F.coalesce(F.md5("text"), F.lit("")) == F.col(name), "left_anti")
