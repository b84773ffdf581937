"""URL rules by a sort-merge range join: a sorted sweep over reversed-host keys.

The host is turned round by labels (www.example.com -> com.example.www) and closed with a dot, so that a rule's host
and all its subdomains form one interval of keys. Key space is cut into ranges at places taken from a bounded sample of
urls. A url goes to the range that holds its (key, path), a rule to every range that its host's interval meets, so rules
are shuffled like urls, whatever their number. Each range is sorted and swept once; a stack holds the rule hosts whose
interval is open, nested ones above those that enclose them.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import fold_ascii

#: (verdict, rule): the part before the first slash is the host, the rest with the slash the start of the path.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
DEFAULT = "allow"
#: Urls (by hash) from which the ranges are cut, for each range, and how many at most. They only say where a url is judged.
SAMPLE_EACH, SAMPLE_MOST = 20, 50_000
#: Above every character of a key.
TOP = "\U0010ffff"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(fold_ascii(rest), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


class Rules:
    """The rules of one host: a path is looked up by its beginnings of the lengths that there are."""

    def __init__(self, key: str):
        self.key, self.paths, self.lengths = key, {}, []

    def add(self, path: str, rule: str, verdict: str) -> None:
        if path not in self.paths:
            self.lengths = sorted({*self.lengths, len(path)}, reverse=True)
        self.paths[path] = max(self.paths.get(path, ("", "")), (rule, verdict))

    def longest(self, path: str) -> tuple[int, str, str] | None:
        for n in self.lengths:
            if n <= len(path) and (found := self.paths.get(path[:n])) is not None:
                return len(found[0]), *found
        return None


def sweep(keys: list[str], paths: list[str], rules: list[Rules], stack: list[Rules], at: int) -> tuple[list[tuple[str | None, str | None]], int]:
    """(rule, verdict) of sorted keys, and how far the rules (sorted by key) have come; the stack goes on from call to call."""
    out = []
    for key, path in zip(keys, paths, strict=True):
        while at < len(rules) and rules[at].key <= key:
            while stack and not rules[at].key.startswith(stack[-1].key):
                stack.pop()
            stack.append(rules[at])
            at += 1
        while stack and not key.startswith(stack[-1].key):
            stack.pop()
        best = max((x for own in stack if (x := own.longest(path)) is not None), default=None)
        out.append((None, None) if best is None else best[1:])
    return out, at


def cut_points(urls: DataFrame, ranges: int) -> list[tuple[str, str]]:
    """Where key space is cut: quantiles of a bounded sample by hash. A place that holds much of the sample is named more than once."""
    n = min(SAMPLE_EACH * ranges, SAMPLE_MOST)
    seen = sorted((r.key, r.path) for r in urls.orderBy(F.xxhash64("page_id", "key", "path")).limit(n).select("key", "path").collect())
    return [seen[i * len(seen) // ranges] for i in range(1, ranges)] if seen else []


def rule_ranges(points: list[tuple[str, str]], key: str, path: str) -> list[int]:
    """The ranges that a rule may be needed in: where its host's urls begin with its path, and where urls of subdomains are.

    So the rules of a host whose urls fill many ranges are shared out among these by their paths.
    """
    first = bisect.bisect_left(points, (key, path))
    past = bisect.bisect_left(range(first, len(points)), True, key=lambda i: points[i][0] != key or not points[i][1].startswith(path))
    below = range(bisect.bisect_left(points, (key + "\0", "")), bisect.bisect_right(points, (key + TOP, "")) + 1)
    return sorted({*range(first, first + past + 1), *below})


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages; rules has (verdict, rule).

    The longest rule that fits wins (ties: the greater text). A null url, or one without ://, has an empty host and
    path, fits no rule and gets the default; repeated rows are judged alike; null rules are left out. Tasks hold the
    rules of their range and of the hosts around it.
    """
    spark = pages.sparkSession
    kind = pages.schema["page_id"].dataType.simpleString()
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("key", reversed_key(F.col("host")))
    known = rules.select("verdict", "rule").where("rule is not null and verdict is not null").distinct()
    host = F.substring_index("rule", "/", 1)
    known = known.select(reversed_key(fold_ascii(host)).alias("key"), F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)").alias("path"), "rule", "verdict")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), pages.rdd.getNumPartitions())
    cuts = spark.sparkContext.broadcast(cut_points(urls, ranges))  # at most a place for each task

    def place_urls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = cuts.value
        for batch in batches:
            out = []
            for key, path, salt in zip(*(batch.column(c).to_pylist() for c in ("key", "path", "salt")), strict=True):
                first, last = bisect.bisect_left(points, (key, path)), bisect.bisect_right(points, (key, path))
                out.append(first + salt % (last - first + 1))  # a very frequent url is shared out among the ranges that it fills
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int32()), *[batch.column(c) for c in ("page_id", "host", "path", "key")]], names=["range", "page_id", "host", "path", "key"])

    def place_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = cuts.value
        for batch in batches:
            spans = [rule_ranges(points, k, p) for k, p in zip(batch.column("key").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            which = pa.array([i for i, s in enumerate(spans) for _ in s], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r for s in spans for r in s], pa.int32()), *[batch.column(c).take(which) for c in ("path", "key", "rule", "verdict")]], names=["range", "path", "key", "rule", "verdict"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, stack, done = None, [], [], 0
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in ("range", "path", "key", "rule", "verdict")}
            found = [None] * batch.num_rows
            i = 0
            while i < batch.num_rows:
                if cols["range"][i] != at:
                    at, own, stack, done = cols["range"][i], [], [], 0
                j = i
                while j < batch.num_rows and cols["range"][j] == at and (cols["rule"][j] is None) == (cols["rule"][i] is None):
                    j += 1
                if cols["rule"][i] is not None:
                    for key, path, rule, verdict in zip(*(cols[c][i:j] for c in ("key", "path", "rule", "verdict")), strict=True):
                        if not own or own[-1].key != key:
                            own.append(Rules(key))
                        own[-1].add(path, rule, verdict)
                else:
                    found[i:j], done = sweep(cols["key"][i:j], cols["path"][i:j], own, stack, done)
                i = j
            keep = pa.array([r is None for r in cols["rule"]], pa.bool_())
            judged = [x for x in found if x is not None]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).filter(keep) for c in ("page_id", "host", "path")], pa.array([r for r, _ in judged], pa.string()), pa.array([v or default for _, v in judged], pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    none = lambda t: F.lit(None).cast(t)
    placed = urls.select("*", F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(1 << 20)).alias("salt")).mapInArrow(place_urls, f"range int, page_id {kind}, host string, path string, key string")
    spread = known.mapInArrow(place_rules, "range int, path string, key string, rule string, verdict string")
    both = placed.select("range", F.lit(1).alias("kind"), "page_id", "host", "path", "key", none("string").alias("rule"), none("string").alias("verdict"))
    both = both.unionByName(spread.select("range", F.lit(0).alias("kind"), none(kind).alias("page_id"), none("string").alias("host"), "path", "key", "rule", "verdict"))
    swept = both.repartition(ranges, "range").sortWithinPartitions("range", "kind", "key", "path").drop("kind")
    return swept.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")
