"""Readers: layout JSON, folders, rule files, stored tables and preset catalogs."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.functions.predicates import SanityRules, TitleRules
from pageloom.operators.blocks import RAW_BLOCK

MODEL = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("supports_vision", T.BooleanType()), T.StructField("recommended", T.BooleanType()), T.StructField("context_window", T.IntegerType())])
#: Characters of an address by which presets and configurations meet.
KEY = 6
#: Presets up to which a catalog's addresses are tried one by one.
FEW = 64
PRESET = T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("base_url", T.StringType()), T.StructField("models", T.ArrayType(MODEL))])


def read_layouts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, blocks): one row for each layout file; the array keeps the blocks' order. doc_id is the file's path."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("doc_id"), F.from_json("value", T.ArrayType(RAW_BLOCK), {"mode": "PERMISSIVE"}).alias("blocks"))


def parse_layouts(rows: DataFrame, text: str = "json") -> DataFrame:
    """The same for (doc_id, json) rows."""
    return rows.select("doc_id", F.from_json(text, T.ArrayType(RAW_BLOCK), {"mode": "PERMISSIVE"}).alias("blocks"))


def candidate_paths(path: str, roots: list[str], upload: str = "uploads") -> list[str]:
    """Where a stored path may lie: from its upload folder on below each root, below the roots as it is, in their upload folders, and by itself."""
    if "://" in path:
        return [path]
    bare, out = path.lstrip("/"), []
    if f"/{upload}/" in path:
        out += [f"{r.rstrip('/')}/{path[path.index(upload + '/'):]}" for r in roots]
    out += [f"{r.rstrip('/')}/{bare}" for r in roots] + [f"{r.rstrip('/')}/{upload}/{bare}" for r in roots]
    return list(dict.fromkeys([*out, path] if path.startswith("/") else out))


def result_candidates(path: str | None, folder: str, name: str, roots: list[str], upload: str = "uploads") -> list[str]:
    """Where a task's result file may lie: its stored path, then the results folder of the task's source folder."""
    below = [f"{r.rstrip('/')}/{mid}{folder}/results/{name}" for mid in (f"{upload}/tasks/", f"{upload}/", "") for r in roots]
    return ([path] if path else []) + below + [f"{folder}/results/{name}"]


def result_text(spark: SparkSession, candidates: list[str], fetch: Callable[[], str] | None = None) -> DataFrame | None:
    """(value) of a result file, from the first candidate that exists, else from the caller's function (as for an object store's address)."""
    found = read_first(spark, candidates)
    return spark.createDataFrame([(fetch(),)], "value string") if found is None and fetch is not None else found


def read_first(spark: SparkSession, candidates: list[str], reader=None) -> DataFrame | None:
    """The first of some paths that exists on its Hadoop file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in candidates:
        if path.startswith(("http://", "https://")):
            raise ValueError("a web address is no input path; copy the file to storage first")
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            return (reader or (lambda x: spark.read.text(x, wholetext=True)))(path)
    return None


def file_role(path: Column | str) -> Column:
    """markdown, layout, image, page_image or null, by name."""
    p = F.col(path) if isinstance(path, str) else path
    name = F.element_at(F.split(p, "/"), -1)
    return (
        F.when(name.rlike(r"(?i)^page_\d+\.(jpg|png|jpeg)$"), "page_image").when(name.endswith(".md"), "markdown")
        .when((name == "content_list.json") | name.endswith("_content_list.json"), "layout").when(p.rlike(r"(?i)(^|/)images/[^/]*\.(jpg|png|jpeg)$"), "image")
    )


def folder_summary(files: DataFrame, path: str = "path") -> DataFrame:
    """(folder, markdown, layout, images, page_images, total_pages) of a listing of files; total_pages is 1 at least."""
    p, role = F.col(path), file_role(path)
    folder = F.regexp_replace(F.regexp_replace(p, "/[^/]*$", ""), "/images$", "")
    rows = files.select(folder.alias("folder"), p.alias("p"), role.alias("role"))
    pages = F.count_if(F.col("role") == "page_image")
    first = lambda r: F.min(F.when(F.col("role") == r, F.col("p"))).alias(r)
    return rows.groupBy("folder").agg(first("markdown"), first("layout"), F.count_if(F.col("role") == "image").alias("images"), pages.alias("page_images"), F.greatest(pages, F.lit(1)).alias("total_pages"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of all files under a folder, without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def _read_json(spark: SparkSession, path: str | None):
    try:
        found = None if path is None else read_first(spark, [path])
        return None if found is None else json.loads(found.first()[0])
    except ValueError:
        return None


def title_rules(spark: SparkSession, path: str | None = None, noise_path: str | None = None) -> TitleRules:
    """Title rules from a rule file, else noise words from a list, else the defaults; unreadable files are as if absent."""
    own, words = _read_json(spark, path), _read_json(spark, noise_path)
    is_words = lambda x: isinstance(x, list) and all(isinstance(w, str) for w in x)
    if isinstance(own, dict) and is_words(own.get("noisePatterns")):
        return TitleRules(enabled=own.get("enabled", True), noise=own["noisePatterns"], structural=own.get("structuralPatterns", TitleRules().structural))
    return TitleRules(noise=words) if is_words(words) and words else TitleRules()


def sanity_rules(spark: SparkSession, path: str | None = None) -> SanityRules:
    own = _read_json(spark, path)
    if not isinstance(own, dict):
        return SanityRules()
    d, p = SanityRules(), own.get("patterns", {})
    return SanityRules(own.get("minBlocks", d.min_blocks), own.get("minRatio", d.min_ratio), p.get("numericLabels", d.numeric_label), p.get("exampleLabels", d.example_label))


def stored_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored table; an empty one with its schema where there is none yet."""
    found = read_first(spark, [path], spark.read.parquet)
    return spark.createDataFrame([], schema) if found is None else found


def presets(spark: SparkSession, records: list[dict]) -> DataFrame:
    """A preset catalog from its owner's records (id, name, base_url, models); ord is their order."""
    return spark.createDataFrame([{"ord": i, **r} for i, r in enumerate(records)], PRESET)


def read_presets(spark: SparkSession, path: str) -> DataFrame:
    """A preset catalog from a JSON file that holds an array of records."""
    found = _read_json(spark, path)
    return presets(spark, found if isinstance(found, list) else [])


def vision_presets(catalog: DataFrame) -> DataFrame:
    return catalog.where(F.exists("models", lambda m: F.coalesce(m["supports_vision"], F.lit(False))))


def recommended_models(catalog: DataFrame) -> DataFrame:
    """(preset_id, model_id): the first model of each preset that is recommended and sees images."""
    good = F.filter("models", lambda m: F.coalesce(m["supports_vision"] & m["recommended"], F.lit(False)))
    return catalog.select(F.col("id").alias("preset_id"), F.get(good, F.lit(0))["id"].alias("model_id")).where("model_id is not null")


def preset_of_url(configs: DataFrame, catalog: DataFrame) -> DataFrame:
    """configs with preset_id: the first preset, in the catalog's order, whose address is part of the configuration's.

    The addresses of a catalog of FEW presets at most are tried one by one where each configuration is: no shuffle, and
    nothing for the driver but these presets. Those of a larger one meet by their first KEY characters (shorter ones by
    all they have), an equi-join whatever the catalog's size; what meets is then compared whole.
    """
    c = catalog.select("ord", F.col("id").alias("preset"), "base_url").where("ord is not null and base_url is not null")
    few = c.limit(FEW + 1).collect()
    rest = [x for x in configs.columns if x != "api_url"]
    if len(few) <= FEW:
        found = F.lit(None).cast("string")
        for r in sorted(few, key=lambda r: r.ord, reverse=True):
            found = F.when(F.contains("api_url", F.lit(r.base_url)), F.lit(r.preset).cast("string")).otherwise(found)
        return configs.select("api_url", *rest, found.alias("preset_id"))
    c = c.withColumn("key", F.substring("base_url", 1, KEY))
    lengths = sorted(r[0] for r in c.select(F.length("key")).distinct().collect())  # KEY + 1 at most
    urls = configs.select("api_url").where("api_url is not null").distinct()
    at = F.transform(F.sequence(F.lit(1), F.length("api_url") + 1), lambda i: F.array(*[F.substring("api_url", i, F.lit(n)) for n in lengths]))
    met = urls.select("api_url", F.explode(F.array_distinct(F.flatten(at))).alias("key")).join(c, "key").where(F.contains("api_url", F.col("base_url")))
    best = met.groupBy("api_url").agg(F.min_by("preset", "ord").alias("preset_id"))
    return configs.join(best, "api_url", "left")
