"""Queries on blocks: flattening, formatting, estimates, chunks, labels, titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.functions import predicates, strategies, text
from pageloom.operators import anchors, blocks as ops, chunking
from pageloom.plans.extraction import document_mode
from pageloom.plans.registry import B, blocks, query
from pageloom.session import scratch_path, table
from pageloom.sources import readers
from pageloom.sources.layouts import LayoutSource
from pageloom.sources.results import ResultSink


@query("blocks_flatten", f"WITH {B} SELECT doc_id, id, type, text, page_idx FROM B")
def blocks_flatten(spark, sf):
    return blocks(spark, sf).select("doc_id", "id", "type", "text", "page_idx")


@query("blocks_noise_filtered", f"WITH {B}, K AS (SELECT doc_id, count(*) AS kept FROM B GROUP BY doc_id) SELECT d.doc_id, CAST(len(string_split(coalesce(d.text, ''), chr(10))) AS BIGINT) AS n_lines, coalesce(kept, 0) AS kept FROM documents d LEFT JOIN K ON d.doc_id = K.doc_id")
def blocks_noise_filtered(spark, sf):
    d = table(spark, sf, "documents")
    kept = blocks(spark, sf).groupBy("doc_id").agg(F.count("*").alias("kept"))
    return d.select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines")).join(kept, "doc_id", "left").select("doc_id", "n_lines", F.coalesce("kept", F.lit(0)).alias("kept"))


@query("page_list_items", r"SELECT page_id, CAST(unnest(range(0, len(x))) AS INTEGER) AS pos, unnest(x) AS item FROM (SELECT page_id, regexp_extract_all(html, '(?s)<li[^>]*>(.*?)</li>', 1) AS x FROM pages)")
def page_list_items(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?s)<li[^>]*>(.*?)</li>"), F.lit(1))).alias("pos", "item"))


@query("page_headings", r"SELECT page_id, regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1) AS heading FROM pages")
def page_headings(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", r"<h1[^>]*>(.*?)</h1>", 1).alias("heading"))


def _raw_layout(spark, sf):
    """Every page as a layout: heading, list, table of rows, page number, image with a caption."""
    items = F.regexp_extract_all("html", F.lit(r"(?s)<li[^>]*>(.*?)</li>"), F.lit(1))
    head = F.regexp_extract("html", r"<h1[^>]*>(.*?)</h1>", 1)
    rows = F.array_join(F.transform(items, lambda x: F.concat(F.lit("<tr><td>"), x, F.lit("</td></tr>"))), "")

    def raw(**v):
        return F.struct(*[v.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ops.RAW_BLOCK.fields])

    page = F.lit(3)
    parts = F.array(
        raw(type=F.lit("text"), text=F.concat(F.lit(" "), head), text_level=F.lit(1), page_idx=page), raw(type=F.lit("list"), sub_type=F.lit("text"), list_items=items, page_idx=page),
        raw(type=F.lit("table"), table_body=rows, page_idx=page), raw(type=F.lit("page_number"), text=F.lit("1")), raw(type=F.lit("image"), img_path=F.col("url"), image_caption=F.array(F.lit("see"), head)), raw(type=F.lit("text"), text=F.lit("Intro ..... 12")),
    )
    return table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), parts.alias("blocks"))


_LAYOUT = r"""WITH H AS (SELECT page_id AS doc_id, url, regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1) AS head, regexp_extract_all(html, '(?s)<li[^>]*>(.*?)</li>', 1) AS x FROM pages),
R AS (SELECT doc_id, 0 AS a, 0 AS b, 'text' AS type, regexp_replace(head, '^\s+|\s+$', '', 'g') AS text, NULL AS img_path, NULL AS image_caption, 3 AS page_idx, 1 AS text_level FROM H
 UNION ALL SELECT doc_id, 1, unnest(range(0, len(x))), 'text', regexp_replace(unnest(x), '^\s+|\s+$', '', 'g'), NULL, NULL, 3, NULL FROM H
 UNION ALL SELECT doc_id, 2, unnest(range(0, len(x))), 'text', '[Table Row] <tr><td>' || unnest(x) || '</td></tr>', NULL, NULL, 3, NULL FROM H
 UNION ALL SELECT doc_id, 4, 0, 'image', NULL, url, 'see ' || head, 0, NULL FROM H)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a, b) - 1 AS INTEGER) AS id, type, text, img_path, image_caption, page_idx, text_level FROM R"""


@query("layout_flatten", _LAYOUT)
def layout_flatten(spark, sf):
    return ops.flatten_blocks(_raw_layout(spark, sf))


@query("layout_converted", f"SELECT doc_id, id, type, text, img_path, image_caption FROM ({_LAYOUT})")
def layout_converted(spark, sf):
    return ops.converted(ops.flatten_blocks(_raw_layout(spark, sf)))


_LINE = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '!\[.*?\]\(.*?\)', '[IMG]', 'g'), '(?s)\$\$.*?\$\$', '[EQ]', 'g'), '\$[^$]+\$', '[EQ]', 'g'), '\s+', ' ', 'g'))"
_OUT = rf"""O AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY id) AS outline FROM (SELECT doc_id, id,
 CASE WHEN type = 'equation' THEN '[' || id || '|p' || page_idx || '] [Equation]' WHEN c <> '' THEN '[' || id || '|p' || page_idx || '] ' || CASE WHEN length(c) > 200 THEN substr(c, 1, 200) || '...' ELSE c END END AS line
 FROM (SELECT *, {_LINE} AS c FROM B)) WHERE line IS NOT NULL GROUP BY doc_id)"""


@query("format_full_text", f"WITH {B}, {_OUT} SELECT doc_id, outline FROM O")
def format_full_text(spark, sf):
    return ops.full_text(blocks(spark, sf))


@query("doc_token_mode", f"WITH {B}, {_OUT} SELECT doc_id, CAST(ceil(length(outline) / 1.5) AS BIGINT) AS tokens, CASE WHEN ceil(length(outline) / 1.5) <= 800 THEN 'whole' ELSE 'chunked' END AS mode FROM O")
def doc_token_mode(spark, sf):
    return document_mode(ops.full_text(blocks(spark, sf)), 1000)


_TOK = "CASE WHEN type IN ('image', 'figure', 'equation') THEN 30 WHEN length(text) = 0 THEN 0 ELSE ceil((least(length(text), 200) + 20) / 1.5) END"
_BTOK = "CASE WHEN type = 'image' THEN 50 ELSE floor(length(regexp_replace(text, '[^一-龥]', '', 'g')) * 1.5 + (length(text) - length(regexp_replace(text, '[^一-龥]', '', 'g'))) * 0.25) END"


@query("block_token_estimates", f"WITH {B} SELECT doc_id, CAST(sum({_TOK}) AS BIGINT) AS outline_tokens, CAST(sum({_BTOK}) AS BIGINT) AS block_tokens FROM B GROUP BY doc_id")
def block_token_estimates(spark, sf):
    t = (F.col("type"), F.col("text"))
    return blocks(spark, sf).groupBy("doc_id").agg(F.sum(text.outline_tokens(*t)).alias("outline_tokens"), F.sum(text.block_tokens(*t)).alias("block_tokens"))


_WIN = "W AS (SELECT doc_id, n, CAST(k AS INTEGER) AS chunk_index, CAST(k * 15 AS INTEGER) AS start_id, CAST(least(k * 15 + 20, n) - 1 AS INTEGER) AS end_id FROM (SELECT doc_id, n, unnest(range(0, 1 + greatest(0, CAST(ceil((n - 20) / 15.0) AS BIGINT)))) AS k FROM (SELECT doc_id, count(*) AS n FROM B GROUP BY doc_id)))"


@query("chunk_windows", f"WITH {B}, {_WIN} SELECT doc_id, chunk_index, start_id, end_id FROM W")
def chunk_windows(spark, sf):
    return chunking.chunk_windows(blocks(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n")), 20, 5)


@query("chunk_membership", f"WITH {B}, {_WIN} SELECT W.doc_id, W.chunk_index, count(*) AS n, min(id) AS lo, max(id) AS hi FROM W JOIN B ON W.doc_id = B.doc_id AND B.id BETWEEN start_id AND end_id GROUP BY ALL")
def chunk_membership(spark, sf):
    return chunking.chunk_members(blocks(spark, sf), 20, 5).groupBy("doc_id", "chunk_index").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))


_LISTS = "TL AS (SELECT doc_id, list(t ORDER BY id) AS t FROM (SELECT doc_id, id, {} AS t FROM B) GROUP BY doc_id), TC AS (SELECT doc_id, len(t) AS n, [CAST(coalesce(list_sum(t[1 : i]), 0) AS BIGINT) for i in range(0, len(t) + 1)] AS c FROM TL)"
_FOLD = rf"""WITH RECURSIVE {B}, {_LISTS.format(_BTOK)},
R AS (SELECT doc_id, n, c, 0 AS k, CAST(0 AS BIGINT) AS s, CAST(least(n, 100, len([x for x in c if x < 400]), greatest(len([x for x in c if x <= 400]) - 1, 1)) AS BIGINT) AS e FROM TC
UNION ALL SELECT doc_id, n, c, k + 1, s2, CAST(least(n, s2 + 100, len([x for x in c if x < c[s2 + 1] + 400]), greatest(len([x for x in c if x <= c[s2 + 1] + 400]) - 1, s2 + 1)) AS BIGINT) FROM (SELECT *, greatest(e - 30, s + 1) AS s2 FROM R WHERE e < n))
SELECT doc_id, CAST(k AS INTEGER) AS chunk_index, CAST(s AS INTEGER) AS start_id, CAST(e - 1 AS INTEGER) AS end_id FROM R"""
_FOLD_LINES = rf"""WITH RECURSIVE {B}, {_LISTS.format(_TOK)},
R AS (SELECT doc_id, n, c, 0 AS k, CAST(0 AS BIGINT) AS s, CAST(least(n, greatest(len([x for x in c if x <= 3200]) - 1, 1)) AS BIGINT) AS e FROM TC
UNION ALL SELECT doc_id, n, c, k + 1, s2, CAST(least(n, greatest(len([x for x in c if x <= c[s2 + 1] + 3200]) - 1, e + 1)) AS BIGINT) FROM (SELECT *, greatest(0, len([x for x in c if x <= c[e + 1] - 2000]) - 1) AS s2 FROM R WHERE e < n))
SELECT doc_id, CAST(k AS INTEGER) AS chunk_index, CAST(s AS INTEGER) AS start_id, CAST(e - 1 AS INTEGER) AS end_id FROM R"""


@query("token_chunks_greedy", _FOLD)
def token_chunks_greedy(spark, sf):
    return chunking.token_chunks(blocks(spark, sf), 100, 30, 400)


@query("outline_chunks_greedy", _FOLD_LINES)
def outline_chunks_greedy(spark, sf):
    return chunking.outline_chunks(blocks(spark, sf), 4000)


@query("chunk_sanity", rf"""WITH {B}, {_WIN}, S AS (SELECT W.doc_id, W.chunk_index, count(*) AS n, bool_or(regexp_matches(text, '^\s*\d+[.．、]')) AS num, bool_or(regexp_matches(text, '例\d')) AS ex, count(*) FILTER (WHERE length(text) > 300) AS q
 FROM W JOIN B ON W.doc_id = B.doc_id AND B.id BETWEEN start_id AND end_id GROUP BY ALL)
SELECT doc_id, chunk_index, CASE WHEN q = 0 AND (num OR ex) THEN 'zero_output' WHEN n > 10 AND q / n < 0.1 AND NOT num THEN 'low_ratio' ELSE 'ok' END AS verdict FROM S""")
def chunk_sanity(spark, sf):
    rules = predicates.SanityRules(min_blocks=10, min_ratio=0.1)
    s = chunking.chunk_members(blocks(spark, sf), 20, 5).groupBy("doc_id", "chunk_index").agg(
        F.count("*").alias("n"), F.bool_or(F.col("text").rlike(rules.numeric_label)).alias("num"), F.bool_or(F.col("text").rlike(rules.example_label)).alias("ex"), F.count_if(F.length("text") > 300).alias("q"))
    return s.select("doc_id", "chunk_index", predicates.sanity_verdict(F.col("q"), F.col("n"), F.col("num"), F.col("ex"), rules).alias("verdict"))


@query("question_type", rf"WITH {B} SELECT doc_id, id, CASE WHEN regexp_matches(text, '^例|^示例|^(?i:Example)|^(?i:Ex\.)|^(?i:Ex)$') THEN 'example' ELSE 'exercise' END AS kind FROM (SELECT doc_id, id, regexp_replace(text, '^E(n|l|s)', 'Ex.') AS text FROM B)")
def question_type(spark, sf):
    return blocks(spark, sf).select("doc_id", "id", text.question_kind(F.regexp_replace("text", "^E(n|l|s)", "Ex.")).alias("kind"))


@query("label_number", rf"WITH {B} SELECT doc_id, id, coalesce(TRY_CAST(nullif(regexp_extract(text, '(\d+)', 1), '') AS INTEGER), -1) AS number FROM B")
def label_number(spark, sf):
    return blocks(spark, sf).select("doc_id", "id", text.label_number("text").alias("number"))


@query("refined_titles", rf"""WITH {B}, T2 AS (SELECT doc_id, id, regexp_replace(text, '\s+', ' ', 'g') AS plain, regexp_replace(text, '\s+', '', 'g') AS bare FROM B)
SELECT doc_id, id, plain, coalesce(nullif(regexp_extract(bare, '(\d+(?:\.\d+)*)', 1), ''), nullif(regexp_extract(bare, '([一二三四五六七八九十百零]+)', 1), ''), bare) AS short FROM T2""")
def refined_titles(spark, sf):
    return blocks(spark, sf).select("doc_id", "id", text.refine_title("text").alias("plain"), text.refine_title("text", True).alias("short"))


def _alt(ps):
    return predicates.any_of(ps).replace("'", "''")


_WC = r"len(regexp_split_to_array(text, '\s+'))"
_DIG = r"length(regexp_replace(text, '[^\d]', '', 'g')) / length(text)"
_PLAIN = f"NOT regexp_matches(text, '(?i)({predicates.STRUCTURAL})')"


CLEANUP_SQL = rf"""CASE WHEN regexp_matches(text, '{_alt(predicates.NOISE_WITH_CASE)}') OR regexp_matches(text, '(?i){_alt(predicates.NOISE_ANY_CASE)}') THEN 'noise'
 WHEN length(text) < 2 OR length(text) > 120 THEN 'length' WHEN {_WC} > 16 THEN 'words' WHEN {_DIG} > 0.5 AND {_PLAIN} THEN 'digits'
 WHEN regexp_matches(text, '(?i){predicates.QUESTION_VERB}') AND {_PLAIN} THEN 'question' WHEN regexp_matches(text, '{predicates.FORMULA}') AND {_PLAIN} THEN 'formula' END"""


@query("cleanup_reasons", f"WITH {B} SELECT doc_id, id, {CLEANUP_SQL} AS reason FROM B")
def cleanup_reasons(spark, sf):
    return blocks(spark, sf).select("doc_id", "id", predicates.cleanup_reason("text", "text").alias("reason"))


@query("title_validity", rf"""WITH {B}, X AS (SELECT doc_id, id, CASE WHEN id % 5 = 0 THEN 'Unit 1 > ' || text ELSE text END AS text FROM B),
Y AS (SELECT *, contains(text, ' > ') AS path, regexp_matches(text, '{_alt(predicates.STRUCTURAL_TITLES)}') AS st FROM X)
SELECT doc_id, id, NOT (regexp_matches(text, '{"|".join(predicates.NOISE_TITLES)}') OR (NOT path AND (length(text) < 2 OR length(text) > 120 OR {_WC} > 16)) OR ({_DIG} > 0.5 AND NOT st)
 OR (regexp_matches(text, '(?i){predicates.QUESTION_VERB}') AND NOT st) OR (NOT path AND regexp_matches(text, '{predicates.FORMULA}') AND NOT st)) AS valid FROM Y""")
def title_validity(spark, sf):
    t = F.when(F.col("id") % 5 == 0, F.concat(F.lit("Unit 1 > "), "text")).otherwise(F.col("text"))
    return blocks(spark, sf).select("doc_id", "id", predicates.title_valid(t).alias("valid"))


@query("strategy_title_filter", rf"WITH {B} SELECT doc_id, id, CASE WHEN regexp_matches(text, '{strategies.SECTION_MARKER}') THEN 'drop' WHEN length(text) > 100 THEN 'drop' ELSE 'keep' END AS action, CASE WHEN regexp_matches(text, '{strategies.SECTION_MARKER}') THEN 'Section marker' WHEN length(text) > 100 THEN 'Title too long' END AS reason FROM (SELECT doc_id, id, CASE WHEN page_idx = 1 THEN '一、选择题 ' || text ELSE text END AS text FROM B)")
def strategy_title_filter(spark, sf):
    t = F.when(F.col("page_idx") == 1, F.concat(F.lit("一、选择题 "), "text")).otherwise(F.col("text"))
    return blocks(spark, sf).select("doc_id", "id", strategies.run_chain(strategies.TITLE_FILTERS, "section_marker_filter", t).alias("r")).select("doc_id", "id", "r.action", "r.reason")


@query("strategy_answer_header", rf"WITH {B} SELECT doc_id, id, CASE WHEN regexp_matches(text, '{strategies.ANSWER_HEADER}') THEN 'found' ELSE 'keep' END AS action, CASE WHEN regexp_matches(text, '{strategies.ANSWER_HEADER}') THEN 1.0 END::DOUBLE AS score FROM (SELECT doc_id, id, CASE WHEN page_idx = 1 THEN 'Answer  key ' || text ELSE text END AS text FROM B)")
def strategy_answer_header(spark, sf):
    t = F.when(F.col("page_idx") == 1, F.concat(F.lit("Answer  key "), "text")).otherwise(F.col("text"))
    return blocks(spark, sf).select("doc_id", "id", strategies.run_chain(strategies.ANSWER_HEADERS, "explicit_header_match", t).alias("r")).select("doc_id", "id", "r.action", "r.score")


@query("normal_titles", rf"WITH {B} SELECT doc_id, id, trim(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '[^A-Za-z0-9_\s一-鿿]', '', 'g')) AS title, regexp_replace(text, '([0-9])([A-Z])', '\1 \2', 'g') AS spaced FROM B")
def normal_titles(spark, sf):
    return blocks(spark, sf).select("doc_id", "id", text.normal_title("text").alias("title"), text.split_digit_capital("text").alias("spaced"))


@query("entry_levels", rf"WITH {B} SELECT doc_id, id, CASE {' '.join(f'WHEN regexp_matches(title, {chr(39)}{p}{chr(39)}) THEN {k}' for k, p in anchors.ENTRY_LEVELS)} ELSE 1 END AS level FROM (SELECT doc_id, id, CASE id % 6 WHEN 0 THEN 'Unit 1 ' WHEN 1 THEN '1.2 ' WHEN 2 THEN '1.2.3 ' WHEN 3 THEN 'Lesson ' WHEN 4 THEN 'exercise ' ELSE '7 ' END || text AS title FROM B)")
def entry_levels(spark, sf):
    p = F.get(F.array(*[F.lit(x) for x in ("Unit 1 ", "1.2 ", "1.2.3 ", "Lesson ", "exercise ", "7 ")]), F.col("id") % 6)
    return blocks(spark, sf).select("doc_id", "id", anchors.entry_level(F.concat(p, "text")).alias("level"))


@query("language_names", f"SELECT doc_id, CASE lang {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in text.LANGUAGES.items())} ELSE lang END AS language, 'audio' AS ending FROM documents")
def language_names(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.language_name("lang").alias("language"), text.sound_ending("lang").alias("ending"))


@query("word_jaccard", rf"WITH {B}, X AS (SELECT doc_id, id, list_distinct(regexp_split_to_array(text, '\s+')) AS a, list_distinct(regexp_split_to_array(lead(text) OVER (PARTITION BY doc_id ORDER BY id), '\s+')) AS b FROM B) SELECT doc_id, id, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS likeness FROM X WHERE b IS NOT NULL")
def word_jaccard(spark, sf):
    from pyspark.sql import Window

    b = blocks(spark, sf).withColumn("b", F.lead("text").over(Window.partitionBy("doc_id").orderBy("id")))
    return b.where("b is not null").select("doc_id", "id", text.word_jaccard("text", "b").alias("likeness"))


_LAYOUT_SQL = r"""WITH H AS (SELECT page_id AS doc_id, regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1) AS head, regexp_extract_all(html, '(?s)<li[^>]*>(.*?)</li>', 1) AS x FROM pages),
R AS (SELECT doc_id, 0 AS a, unnest(range(0, len(x))) AS b, 'text' AS type, regexp_replace(unnest(x), '^\s+|\s+$', '', 'g') AS text, 7 AS page_idx, 2 AS text_level FROM H
 UNION ALL SELECT doc_id, 1, 0, 'text', regexp_replace(head, '^\s+|\s+$', '', 'g'), 7, NULL FROM H
 UNION ALL SELECT doc_id, 2, 0, 'list', NULL, 7, NULL FROM H UNION ALL SELECT doc_id, 3, 0, 'equation', 'x = ' || doc_id, 0, NULL FROM H)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a, b) - 1 AS INTEGER) AS id, type, text, page_idx, text_level FROM R"""


def _layout_texts(spark, sf):
    """(doc_id, json): every page as layout JSON: a table with blocks inside, an opaque table, a list that isn't of texts, a formula, a cut table."""
    items = F.regexp_extract_all("html", F.lit(r"(?s)<li[^>]*>(.*?)</li>"), F.lit(1))
    head = F.regexp_extract("html", r"<h1[^>]*>(.*?)</h1>", 1)
    block = lambda **v: F.to_json(F.struct(*[c.alias(k) for k, c in v.items()]))
    inside = F.transform(items, lambda x: F.struct(F.concat(F.lit(" "), x).alias("text"), F.lit(2).alias("text_level")))
    seven = F.lit(7)
    parts = F.array(
        block(type=F.lit("table"), inside=inside, page_idx=seven), block(type=F.lit("table"), text=head, page_idx=seven), block(type=F.lit("list"), list_items=items, page_idx=seven),
        block(type=F.lit("equation"), text=F.concat(F.lit("x = "), "page_id")), block(type=F.lit("table"), table_body=F.lit("<tr><td>cut")), block(type=F.lit("footer"), text=F.lit("foot")),
    )
    kept = F.filter(parts, lambda x: ~(x.contains('"inside":[]')))  # a table without children is another case
    json = F.concat(F.lit("["), F.array_join(kept, ","), F.lit("]"))
    return table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), json.alias("json"))


@query("layout_json", _LAYOUT_SQL)
def layout_json(spark, sf):
    """Every page's layout JSON, read back as one array for each page."""
    return ops.flatten_blocks(readers.parse_layouts(_layout_texts(spark, sf))).select("doc_id", "id", "type", "text", "page_idx", "text_level")


@query("layout_files", _LAYOUT_SQL)
def layout_files(spark, sf):
    """Every page's layout JSON as a file in the shared folder, read by the layout source as one row for each raw block."""
    folder = scratch_path(spark, "layout-files")
    spark.dataSource.register(ResultSink)
    spark.dataSource.register(LayoutSource)
    files = _layout_texts(spark, sf).select(F.concat("doc_id", F.lit("_content_list.json")).alias("name"), F.col("json").alias("content"))
    files.write.format("results").mode("append").option("path", folder).save()
    rows = spark.read.format("layout").load(folder)
    page = F.regexp_extract("doc_id", r"([0-9]+)_content_list\.json$", 1).cast("long")
    return ops.flatten_block_rows(rows).select(page.alias("doc_id"), "id", "type", "text", "page_idx", "text_level")
