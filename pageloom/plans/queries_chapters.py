"""Queries on chapters, answers, questions, exports and rule-based anchors."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.functions import predicates, text as text_functions
from pageloom.operators import anchors, answers, chapters, chunking, exports, questions as ops, text_diff
from pageloom.plans.extraction import Settings, chapters_from_answers, extract_questions as extract, model_chapters, rule_chapters
from pageloom.plans.providers import ReplayProvider, RuleProvider
from pageloom.plans.registry import B, C, E, NOISE_SQL, P, Q, blocks, entries, entries_of, kept_blocks, kept_entries, query, questions
from pageloom.plans.queries_blocks import CLEANUP_SQL
from pageloom.session import stored, table


def tree(spark, sf, b=None):
    b = kept_blocks(spark, sf) if b is None else b
    return chapters.flat_map(kept_entries(b), b)


@query("chapter_ranges", f"WITH {B}, {E}, {C} SELECT doc_id, ord, id, text, level, page, s AS range_start, e AS range_end FROM C")
def chapter_ranges(spark, sf):
    return tree(spark, sf).select("doc_id", "ord", "id", "text", "level", "page", F.col("block_range.start").alias("range_start"), F.col("block_range.end").alias("range_end"))


@query("chapter_parents", f"WITH {B}, {E} SELECT a.doc_id, a.id, (SELECT max(b.ord) FROM E b WHERE b.doc_id = a.doc_id AND b.ord < a.ord AND b.level < a.level) AS parent_id FROM E a")
def chapter_parents(spark, sf):
    return tree(spark, sf).select("doc_id", "id", "parent_id")


@query("chapter_paths", f"WITH {B}, {E}, {C}, {P} SELECT doc_id, id, path FROM P")
def chapter_paths(spark, sf):
    return chapters.chapter_paths(tree(spark, sf)).select("doc_id", "id", "path")


_AT = f"""{B}, {E}, {C}, {P}, M AS (SELECT B.doc_id, B.id, P.path, row_number() OVER (PARTITION BY B.doc_id, B.id ORDER BY P.level DESC NULLS LAST, P.ord) AS n
 FROM B LEFT JOIN P ON B.doc_id = P.doc_id AND B.id >= P.s AND B.id < P.e)"""


@query("chapter_paths_by_joins", f"WITH {B}, {E}, {C}, {P} SELECT doc_id, id, path FROM P")
def chapter_paths_by_joins(spark, sf):
    return chapters.chapter_paths(tree(spark, sf).drop("path")).select("doc_id", "id", "path")


@query("block_chapter", f"WITH {_AT} SELECT doc_id, id, path FROM M WHERE n = 1")
def block_chapter(spark, sf):
    b = kept_blocks(spark, sf)
    return chapters.chapter_of(b.select("doc_id", "id"), chapters.chapter_paths(tree(spark, sf, b)))


@query("nearest_chapter", f"WITH {B}, {E}, {C}, M AS (SELECT B.doc_id, B.id, C.text, row_number() OVER (PARTITION BY B.doc_id, B.id ORDER BY C.level DESC NULLS LAST, C.ord) AS n FROM B LEFT JOIN C ON B.doc_id = C.doc_id AND B.id >= C.s AND B.id < C.e) SELECT doc_id, id, text FROM M WHERE n = 1")
def nearest_chapter(spark, sf):
    b = kept_blocks(spark, sf)
    return chapters.chapter_of(b.select("doc_id", "id"), tree(spark, sf, b), value="text")


@query("chapter_coverage", f"""WITH {B}, {E}, {C}, X AS (SELECT DISTINCT doc_id, unnest(range(s, e)) AS b FROM C), F AS (SELECT doc_id, min(s) AS first FROM C GROUP BY doc_id), K AS (SELECT doc_id, count(*) AS covered FROM X GROUP BY doc_id),
U AS (SELECT N.doc_id, coalesce(covered, 0) AS covered, total, first, CASE WHEN first IS NULL THEN total ELSE greatest(0, total - first - covered) END AS uncovered FROM N LEFT JOIN F ON N.doc_id = F.doc_id LEFT JOIN K ON N.doc_id = K.doc_id)
SELECT doc_id, covered, uncovered, CASE WHEN first IS NULL THEN 0.0 WHEN total > first THEN (total - first - uncovered) / (total - first) ELSE 1.0 END::DOUBLE AS coverage_rate FROM U""")
def chapter_coverage(spark, sf):
    b = kept_blocks(spark, sf)
    return chapters.coverage(tree(spark, sf, b), b)


@query("level_histogram", f"WITH {B}, {E} SELECT doc_id, count(*) FILTER (WHERE level = 1) AS l1, count(*) FILTER (WHERE level = 2) AS l2, count(*) FILTER (WHERE level = 3) AS l3, count(*) FILTER (WHERE level = 4) AS l4 FROM E GROUP BY doc_id")
def level_histogram(spark, sf):
    return entries(spark, sf).groupBy("doc_id").agg(*[F.count_if(F.col("level") == k).alias(f"l{k}") for k in (1, 2, 3, 4)])


@query("chapter_validation", f"""WITH {B}, {E}, N AS (SELECT doc_id, count(*) AS total FROM B GROUP BY doc_id), S AS (SELECT E.doc_id, count(*) AS n, count(*) FILTER (WHERE level = 1) AS top, max(CASE WHEN level = 1 THEN id * 2 ELSE id END) AS hi FROM E GROUP BY E.doc_id)
SELECT S.doc_id, CASE WHEN hi >= total THEN 'unknown_id' WHEN n > 20 AND top / n > 0.5 THEN 'many_top_level' WHEN total > 100 AND n / total > 0.25 THEN 'many_entries' ELSE 'ok' END AS verdict FROM S JOIN N ON S.doc_id = N.doc_id""")
def chapter_validation(spark, sf):
    b = kept_blocks(spark, sf)
    e = entries_of(b).withColumn("ids", F.array(F.when(F.col("level") == 1, F.col("ids")[0] * 2).otherwise(F.col("ids")[0])))
    return chapters.validation(e, b)


_SAME = f"{B}, {E}, D AS (SELECT doc_id, ord, level, title, min(id) OVER (PARTITION BY doc_id, title) AS pid FROM E)"


def _same_ids(spark, sf):
    from pyspark.sql import Window

    first = F.min(F.col("ids")[0]).over(Window.partitionBy("doc_id", "title"))
    return entries(spark, sf).withColumn("ids", F.array(first))


@query("entry_dedup_first_wins", f"WITH {_SAME} SELECT doc_id, pid, ord, title FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pid ORDER BY ord) AS n FROM D) WHERE n = 1")
def entry_dedup_first_wins(spark, sf):
    return chapters.first_wins(_same_ids(spark, sf)).select("doc_id", F.col("ids")[0].alias("pid"), "ord", "title")


@query("unknown_ids", f"WITH {B}, {E} SELECT E.doc_id, E.id + 5 AS id FROM E WHERE NOT EXISTS (SELECT 1 FROM B WHERE B.doc_id = E.doc_id AND B.id = E.id + 5)")
def unknown_ids(spark, sf):
    b = kept_blocks(spark, sf)
    return chapters.unknown_ids(entries_of(b).withColumn("ids", F.array(F.col("ids")[0] + 5)), b)


@query("entries_in_chunk", f"WITH {B}, {E} SELECT doc_id, ord, level FROM E WHERE id < 20")
def entries_in_chunk(spark, sf):
    b = kept_blocks(spark, sf)
    first = chunking.chunk_members(b, 20, 5).where("chunk_index = 0")
    return chapters.entries_in_chunk(entries_of(b), first).select("doc_id", "ord", "level")


@query("local_id_map", f"WITH {B}, {E}, O AS (SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY id) - 1 AS place FROM B WHERE length(text) > 40) SELECT E.doc_id, E.ord, coalesce(K.id, O.id) AS id FROM E LEFT JOIN (SELECT doc_id, id FROM B WHERE length(text) > 40) K ON E.doc_id = K.doc_id AND E.id = K.id LEFT JOIN O ON E.doc_id = O.doc_id AND E.id = O.place WHERE coalesce(K.id, O.id) IS NOT NULL")
def local_id_map(spark, sf):
    b = kept_blocks(spark, sf)
    offered = b.where(F.length("text") > 40)
    return chapters.map_local_ids(entries_of(b), offered, offered).select("doc_id", "ord", F.col("ids")[0].alias("id"))


@query("id_drift", f"WITH {B}, {E}, X AS (SELECT doc_id, min(id) AS lo, max(id) AS hi FROM E GROUP BY doc_id), Y AS (SELECT doc_id, min(id + length(text) * 10) AS least FROM B GROUP BY doc_id) SELECT X.doc_id FROM X JOIN Y ON X.doc_id = Y.doc_id WHERE (hi < 100 AND least > 1000) OR (lo = 0 AND hi < 100 AND least > 500)")
def id_drift(spark, sf):
    b = kept_blocks(spark, sf)
    return chapters.drifted(entries_of(b), b.withColumn("id", F.col("id") + F.length("text") * 10))


@query("round_acceptance", f"""WITH {B}, {E}, R2 AS (SELECT * FROM E WHERE level <= 3), A AS (SELECT doc_id, count(*) AS n1 FROM E GROUP BY doc_id), Z AS (SELECT doc_id, count(*) AS n2 FROM R2 GROUP BY doc_id), G AS (SELECT A.doc_id FROM A JOIN Z ON A.doc_id = Z.doc_id WHERE n2 >= 0.8 * n1)
SELECT doc_id, ord, level FROM R2 WHERE doc_id IN (SELECT doc_id FROM G) UNION ALL SELECT doc_id, ord, level FROM E WHERE doc_id NOT IN (SELECT doc_id FROM G)""")
def round_acceptance(spark, sf):
    e = kept_entries(blocks(spark, sf))
    return chapters.accept_second(e, e.where("level <= 3")).select("doc_id", "ord", "level")


def _lists(spark, sf):
    """One id list for each document: some in order, one twice, one beyond the end, one that is no number."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.concat(F.lit("2, 0,x,"), F.pmod("doc_id", F.lit(7)), F.lit(",0,1 4,,99999")).alias("ids"))


_IDS = f"{B}, I AS (SELECT doc_id, unnest([0, 1, 2, 3, 4]) AS k, unnest([2, 0, CAST(doc_id % 7 AS INTEGER), 0, 1]) AS id FROM documents)"


@query("id_backfill", f"WITH {_IDS} SELECT d.doc_id, coalesce(x.text, '') AS text FROM documents d LEFT JOIN (SELECT I.doc_id, string_agg(B.text, chr(10) ORDER BY k) AS text FROM I JOIN B ON I.doc_id = B.doc_id AND I.id = B.id GROUP BY I.doc_id) x ON d.doc_id = x.doc_id")
def id_backfill(spark, sf):
    b = blocks(spark, sf).withColumn("img_path", F.lit(None).cast("string")).withColumn("image_caption", F.lit(None).cast("string"))
    return answers.backfill(_lists(spark, sf), "ids", b, ["doc_id"]).select("doc_id", "text")


@query("title_backfill", f"WITH {_IDS} SELECT d.doc_id, coalesce(x.text, '') AS text FROM documents d LEFT JOIN (SELECT I.doc_id, string_agg(B.text, ' ' ORDER BY k) AS text FROM I JOIN B ON I.doc_id = B.doc_id AND I.id = B.id GROUP BY I.doc_id) x ON d.doc_id = x.doc_id")
def title_backfill(spark, sf):
    return answers.backfill(_lists(spark, sf), "ids", blocks(spark, sf), ["doc_id"], sep=" ", plain=True).select("doc_id", "text")


def _answers(spark, sf, question):
    pair = F.concat(F.lit("<qa_pair><label> "), F.col("id") + 1, F.lit(" </label><type>"), F.when(F.length("text") % 2 == 0, "example").otherwise(""), F.lit("</type><question>"), question, F.lit("</question><solution></solution></qa_pair>"))
    rows = blocks(spark, sf).select("doc_id", F.floor(F.col("id") / 20).cast("int").alias("chunk_index"), "id", pair.alias("p"))
    got = rows.groupBy("doc_id", "chunk_index").agg(F.sort_array(F.collect_list(F.struct("id", "p"))).alias("x"))
    return got.select("doc_id", "chunk_index", F.concat(F.lit("ok:\n<chapter><title>0</title>"), F.array_join(F.col("x.p"), "\n"), F.lit("</chapter>")).alias("output"))


@query("answer_parse_strict", f"WITH {B} SELECT doc_id, CAST(floor(id / 20) AS INTEGER) AS chunk_index, 'strict' AS mode, CAST(id % 20 AS INTEGER) AS pos, CAST(id + 1 AS VARCHAR) AS label, CASE WHEN length(text) % 2 = 0 THEN 'example' ELSE 'exercise' END AS type, id || ', ' || (id + 1) AS question_ids, '' AS solution_ids, '0' AS chapter_title_ids FROM B")
def answer_parse_strict(spark, sf):
    return answers.parse_answers(_answers(spark, sf, F.concat(F.col("id"), F.lit(", "), F.col("id") + 1)))


@query("answer_parse_lenient", f"WITH {B} SELECT doc_id, CAST(floor(id / 20) AS INTEGER) AS chunk_index, 'lenient' AS mode, CAST(id % 20 AS INTEGER) AS pos, CAST(id + 1 AS VARCHAR) AS label, CASE WHEN length(text) % 2 = 0 THEN 'example' ELSE 'exercise' END AS type, id || ',' || (id + 1) AS question_ids, '' AS solution_ids, '' AS chapter_title_ids FROM B")
def answer_parse_lenient(spark, sf):
    return answers.parse_answers(_answers(spark, sf, F.concat(F.lit("blocks "), F.col("id"), F.lit(" and "), F.col("id") + 1)))


@query("id_sequences", r"""SELECT doc_id, regexp_matches(regexp_replace(s, '\s', '', 'g'), '^[\d,]*$') AS sequence FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '1, 2' WHEN 1 THEN '' WHEN 2 THEN lang ELSE doc_id || ',x' END AS s FROM documents)""")
def id_sequences(spark, sf):
    m = F.pmod("doc_id", F.lit(4))
    s = F.when(m == 0, "1, 2").when(m == 1, "").when(m == 2, F.col("lang")).otherwise(F.concat("doc_id", F.lit(",x")))
    return table(spark, sf, "documents").select("doc_id", predicates.is_id_sequence(s).alias("sequence"))


@query("overlap_pairs_jaccard", f"WITH {B}, X AS (SELECT doc_id, id, count(*) OVER (PARTITION BY doc_id) AS n FROM B) SELECT a.doc_id, a.id AS a, b.id AS b, CAST(1 AS DOUBLE) / 3 AS jaccard FROM X a JOIN X b ON a.doc_id = b.doc_id AND b.id = a.id + 1")
def overlap_pairs_jaccard(spark, sf):
    return ops.id_overlaps(questions(spark, sf), threshold=0.3)


@query("greedy_dedup", f"WITH {B}, {Q} SELECT doc_id, seq, label, question_ids FROM Q WHERE seq % 2 = 0")
def greedy_dedup(spark, sf):
    return ops.greedy_dedup(questions(spark, sf), threshold=0.3).select("doc_id", "seq", "label", "question_ids")


@query("title_continuity", f"""WITH {B}, {Q}, X AS (SELECT *, CAST(regexp_extract(label, '(\\d+)', 1) AS INTEGER) AS num, {NOISE_SQL.format('chapter_title')} AS bad FROM Q),
Y AS (SELECT *, lag(num) OVER w AS prev, last_value(CASE WHEN chapter_title <> '' AND NOT bad THEN chapter_title END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS good FROM X WINDOW w AS (PARTITION BY doc_id ORDER BY seq))
SELECT doc_id, seq, CASE WHEN num = prev + 1 AND good IS NOT NULL AND chapter_title <> '' AND bad THEN good ELSE chapter_title END AS chapter_title FROM Y""")
def title_continuity(spark, sf):
    return ops.steady_titles(questions(spark, sf)).select("doc_id", "seq", "chapter_title")


@query("title_forward_fill", f"""WITH {B}, {Q}, X AS (SELECT *, trim(regexp_replace(chapter_title, '\\s+', ' ', 'g')) AS t FROM Q), Y AS (SELECT *, t = '' OR {NOISE_SQL.format('t')} AS bad FROM X)
SELECT doc_id, seq, CASE WHEN bad THEN coalesce(last_value(CASE WHEN NOT bad THEN t END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), t) ELSE t END AS chapter_title FROM Y""")
def title_forward_fill(spark, sf):
    return ops.filled_titles(questions(spark, sf)).select("doc_id", "seq", "chapter_title")


@query("chapter_merge", f"""WITH {B}, {Q}, X AS (SELECT doc_id, seq, chapter_title AS o, CASE seq % 4 WHEN 0 THEN 'Unit 1 > 基础' WHEN 1 THEN '' WHEN 2 THEN 'Chapter 2' ELSE '选择题 9' END AS p FROM Q),
Y AS (SELECT *, trim(o) <> '' AND NOT {NOISE_SQL.format('o')} AS ok_o, p <> '' AND NOT {NOISE_SQL.format('p')} AS ok_p, regexp_matches(o, '{predicates.any_of(predicates.STRUCTURAL_TITLES)}') AS so, regexp_matches(p, '{predicates.any_of(predicates.STRUCTURAL_TITLES)}') AS sp FROM X)
SELECT doc_id, seq, CASE WHEN ok_o AND ok_p THEN CASE WHEN so AND NOT sp THEN o ELSE p END WHEN ok_p THEN p WHEN ok_o THEN o ELSE '' END AS chapter_title FROM Y""")
def chapter_merge(spark, sf):
    p = F.get(F.array(*[F.lit(x) for x in ("Unit 1 > 基础", "", "Chapter 2", "选择题 9")]), F.col("seq") % 4)
    return questions(spark, sf).withColumn("p", p).select("doc_id", "seq", ops.merged_title("p", "chapter_title").alias("chapter_title"))


@query("quality_filter", f"WITH {B}, {Q} SELECT doc_id, seq FROM Q WHERE length(trim(question)) >= 5 AND trim(label) <> ''")
def quality_filter(spark, sf):
    return ops.quality_filtered(questions(spark, sf)).select("doc_id", "seq")


@query("export_markdown", f"""WITH {B}, {Q}, X AS (SELECT *, coalesce(last_value(nullif(chapter_title, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS cur FROM Q),
Y AS (SELECT doc_id, seq, CASE WHEN chapter_title <> '' AND chapter_title <> cur THEN '## ' || chapter_title || chr(10) || chr(10) ELSE '' END || '### ' || label || ' (' || CASE type WHEN 'example' THEN '例题' ELSE '练习题' END || ')' || chr(10) || chr(10) || '**题目**: ' || question || chr(10) || chr(10)
 || '![图片](' || replace(image, '/data/out/', '') || ')' || chr(10) || chr(10) || CASE WHEN type = 'example' AND solution <> '' THEN '**解答**: ' || solution || chr(10) || chr(10) ELSE '' END || '---' || chr(10) || chr(10) AS part FROM X)
SELECT doc_id, count(*) AS total, md5('# 提取的题目' || chr(10) || chr(10) || '**总数**: ' || count(*) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || string_agg(part, '' ORDER BY seq)) AS digest FROM Y GROUP BY doc_id""")
def export_markdown(spark, sf):
    return exports.markdown_text(questions(spark, sf), "/data/out").select("doc_id", "total", F.md5("markdown").alias("digest"))


@query("export_json", f"WITH {B}, {Q} SELECT doc_id, count(*) AS total, md5(string_agg(label || '|' || question || '|' || solution || '|' || replace(image, '/data/out/', '../out/'), chr(10) ORDER BY seq)) AS digest FROM Q GROUP BY doc_id")
def export_json(spark, sf):
    """The JSON of each document, read back: the export keeps all questions, texts and paths, in order."""
    j = exports.json_text(questions(spark, sf), "/data/results")
    back = F.from_json("json", "total long, questions array<struct<label string, question string, solution string, images array<string>>>")
    lines = F.transform(F.col("r.questions"), lambda q: F.concat_ws("|", q["label"], q["question"], q["solution"], q["images"][0]))
    return j.select("doc_id", back.alias("r")).select("doc_id", F.col("r.total").alias("total"), F.md5(F.array_join(lines, "\n")).alias("digest"))


_EXTRACTED = rf"""WITH {_AT}, V AS (SELECT doc_id, id, type, CASE WHEN length(text) > 60 THEN (id + 1) || '. ' || text ELSE text END AS text FROM B),
L2 AS (SELECT *, nullif(regexp_extract(text, '^\s*(?:例\s*)?(\d+)[.．、)]', 1), '') AS lab, regexp_matches(text, '^\s*例') AS ex FROM V),
G AS (SELECT *, max(CASE WHEN lab IS NOT NULL THEN id END) OVER (PARTITION BY doc_id ORDER BY id) AS q FROM L2),
U AS (SELECT doc_id, q, max(id) AS last, string_agg(id, ',' ORDER BY id) AS ids, string_agg(CASE WHEN type = 'equation' AND length(text) > 4096 THEN substr(text, 1, 4096) || '{answers.CUT_MARK}' ELSE text END, chr(10) ORDER BY id) AS body, max(CASE WHEN id = q THEN lab END) AS label, bool_or(id = q AND ex) AS ex FROM G WHERE q IS NOT NULL GROUP BY ALL),
N1 AS (SELECT doc_id, count(*) AS n FROM B GROUP BY doc_id),
W AS (SELECT doc_id, k AS chunk, k * 70 AS lo, least(k * 70 + 100, n) - 1 AS hi FROM (SELECT doc_id, n, unnest(range(0, 1 + greatest(0, CAST(ceil((n - 100) / 70.0) AS BIGINT)))) AS k FROM N1)),
R AS (SELECT U.*, row_number() OVER (PARTITION BY U.doc_id ORDER BY chunk, q) AS seq FROM U JOIN W ON U.doc_id = W.doc_id AND q >= lo AND last <= hi),
K AS (SELECT *, row_number() OVER (PARTITION BY doc_id, q ORDER BY seq) AS copy FROM R),
F1 AS (SELECT K.*, M.path FROM K LEFT JOIN M ON K.doc_id = M.doc_id AND K.q = M.id AND M.n = 1 WHERE copy = 1),
F2 AS (SELECT *, contains(path, ' > ') AS long, regexp_matches(path, '{predicates.any_of(predicates.STRUCTURAL_TITLES)}') AS st FROM F1),
F3 AS (SELECT *, CASE WHEN path IS NULL OR trim(path) = '' OR {NOISE_SQL.format('path')} OR (NOT long AND (length(path) < 2 OR length(path) > 120 OR len(regexp_split_to_array(path, '\s+')) > 16)) OR (length(regexp_replace(path, '[^\d]', '', 'g')) / length(path) > 0.5 AND NOT st)
 OR (regexp_matches(path, '(?i){predicates.QUESTION_VERB}') AND NOT st) OR (NOT long AND regexp_matches(path, '{predicates.FORMULA}') AND NOT st) THEN NULL ELSE regexp_replace(trim(path), '\s+', ' ', 'g') END AS t FROM F2)
SELECT doc_id, CAST(seq AS INTEGER) AS seq, label, CASE WHEN ex THEN 'example' ELSE 'exercise' END AS type, coalesce(last_value(t IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS chapter_title, regexp_replace(body, '^\s+|\s+$', '', 'g') AS question, ids AS question_ids, false AS has_answer
FROM F3 QUALIFY length(trim(body)) >= 5"""


#: The tree of this query is made of the numbered texts.
_EXTRACTED = _EXTRACTED.replace("substr(B.text, 1, 80)", "substr(CASE WHEN length(B.text) > 60 THEN (B.id + 1) || '. ' || B.text ELSE B.text END, 1, 80)")


@query("extract_questions", _EXTRACTED)
def extract_questions(spark, sf):
    """End to end: every sentence that begins a line is numbered as a question, rules stand in for the model."""
    plain = kept_blocks(spark, sf)
    b = plain.withColumn("text", F.when(F.length("text") > 60, F.concat(F.col("id") + 1, F.lit(". "), "text")).otherwise(F.col("text")))
    made = extract(b, RuleProvider(), chapters.flat_map(kept_entries(plain), b))
    return made.select("doc_id", "seq", "label", "type", "chapter_title", "question", "question_ids", "has_answer")


@query("json_repair")
def json_repair(spark, sf):
    """Directory answers cut at every place that their document's id gives, mended and read."""
    cut = _directories(blocks(spark, sf)).withColumnRenamed("output", "t").select("doc_id", F.expr("substring(t, 1, length(t) - doc_id % 50)").alias("output"))
    return answers.directory_entries(cut)


_ANSWERED = rf"""WITH {B}, {E.replace("E AS", "E0 AS")}, R0 AS (SELECT E0.*, B.text, {CLEANUP_SQL} AS reason FROM E0 JOIN B ON E0.doc_id = B.doc_id AND E0.id = B.id),
S0 AS (SELECT R0.doc_id, count(*) AS n, count(*) FILTER (WHERE level = 1) AS top, max(total) AS total FROM R0 JOIN (SELECT doc_id, count(*) AS total FROM B GROUP BY doc_id) T0 ON R0.doc_id = T0.doc_id WHERE reason IS NULL GROUP BY R0.doc_id),
E AS (SELECT R0.doc_id, row_number() OVER (PARTITION BY R0.doc_id ORDER BY ord) - 1 AS rank, ord, id, level, title FROM R0 JOIN S0 ON R0.doc_id = S0.doc_id WHERE reason IS NULL AND NOT (n > 20 AND top / n > 0.5) AND NOT (total > 100 AND n / total > 0.25)), {C}
SELECT doc_id, id, text, level, (SELECT id FROM C u WHERE u.doc_id = C.doc_id AND u.ord = C.parent_id) AS parent_id FROM C"""


def _directories(b):
    """Directory answers that name all entries of each document."""
    e = entries_of(b).select("doc_id", "ord", F.to_json(F.struct(F.col("ids")[0].alias("id"), "level", "title")).alias("j"))
    a = e.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "j"))).alias("x"))
    return a.select("doc_id", F.concat(F.lit('{"directory": ['), F.array_join(F.col("x.j"), ", "), F.lit("]}")).alias("output"))


@query("chapters_from_answers", _ANSWERED)
def chapters_of_answers(spark, sf):
    b = kept_blocks(spark, sf)
    raw = stored(_directories(b), "directories")
    return chapters_from_answers(raw, raw, b).select("doc_id", "id", "text", "level", "parent_id")


@query("model_chapters", _ANSWERED)
def model_chapters_replayed(spark, sf):
    """Two rounds of a model, replayed: every first answer is cut short and asked for again."""
    b = kept_blocks(spark, sf)
    whole = _directories(b).select("doc_id", F.lit(0).alias("chunk_index"), F.lit(1).alias("attempt"), "output", F.lit(True).alias("success"))
    whole = stored(whole, "directories")
    short = whole.withColumn("attempt", F.lit(0)).withColumn("output", F.lit("no answer"))
    both = stored(whole.unionByName(short), "responses")
    return model_chapters(b, ReplayProvider(both), ReplayProvider(both), context=100_000_000).select("doc_id", "id", "text", "level", "parent_id")


def _refined(spark, sf):
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf, "documents").select("doc_id", text.alias("a"), F.regexp_replace(text, "the ", "").alias("b"))


@query("line_diff", """WITH RECURSIVE T AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a, string_split(replace(coalesce(text, ''), 'the ', ''), chr(10)) AS b FROM documents),
R AS (SELECT doc_id, 0 AS i, list_transform(a, lambda x: 0) AS r FROM T
      UNION ALL SELECT doc_id, i + 1, list_transform(range(1, len(a) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN a[k] = b[i + 1] THEN coalesce(r[k - 1], 0) + 1 ELSE r[k] END)))
      FROM R JOIN T USING (doc_id) WHERE i < len(b))
SELECT doc_id, CAST(r[len(a)] AS BIGINT) AS same, CAST(len(b) - r[len(a)] AS BIGINT) AS added, CAST(len(a) - r[len(a)] AS BIGINT) AS removed FROM R JOIN T USING (doc_id) WHERE i = len(b)""")
def line_diff(spark, sf):
    """(doc_id, same, added, removed): lines of each document against those of its refined form."""
    return text_diff.line_diff(_refined(spark, sf))


@query("line_diff_hunks")
def line_diff_hunks(spark, sf):
    """The edit script of each document against its refined form; which of several shortest scripts it is, SQL can't say."""
    return text_diff.diff_hunks(_refined(spark, sf))


@query("line_diff_multiset", r"""WITH A AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents), Z AS (SELECT regexp_replace(unnest(string_split(text, chr(10))), 'the ', '', 'g') AS line FROM documents),
X AS (SELECT line, count(*) AS n FROM A GROUP BY line), Y AS (SELECT line, count(*) AS n FROM Z GROUP BY line)
SELECT * FROM (SELECT 'removed' AS change, coalesce(X.line, '') AS line, CAST(X.n - coalesce(Y.n, 0) AS BIGINT) AS n FROM X LEFT JOIN Y ON X.line = Y.line UNION ALL SELECT 'added', Y.line, CAST(Y.n - coalesce(X.n, 0) AS BIGINT) FROM Y LEFT JOIN X ON X.line = Y.line) WHERE n > 0""")
def line_diff_multiset(spark, sf):
    a = table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    b = a.select(F.regexp_replace("line", "the ", "").alias("line"))
    gone, new = a.exceptAll(b), b.exceptAll(a)
    return gone.groupBy("line").agg(F.count("*").alias("n")).select(F.lit("removed").alias("change"), "line", "n").union(new.groupBy("line").agg(F.count("*").alias("n")).select(F.lit("added").alias("change"), "line", "n"))


def headed(spark, sf, b=None):
    """Blocks with a chapter heading, a section number or a contents entry put before short lines."""
    n = F.length("text")
    head = F.when((F.col("page_idx") == 0) & (F.col("id") == 0), F.lit("Contents")).when((F.col("page_idx") == 0) & (n < 120), F.concat(F.lit("Unit "), F.col("id"), F.lit(" "), F.substring("text", 1, 30), F.lit(" "), F.col("id") + 1))
    late = F.when((n % 11 == 0), F.concat(F.lit("Chapter "), F.col("id"))).when(n % 11 == 1, F.concat(F.lit("Section "), F.col("id"), F.lit(" "), "text")).when(n % 11 == 2, F.concat(F.col("id"), F.lit(".1 Part "), F.substring("text", 1, 40)))
    return (blocks(spark, sf) if b is None else b).withColumn("text", F.coalesce(head, late, F.col("text")))


_HEAD = r"""H AS (SELECT doc_id, id, type, page_idx, CASE WHEN page_idx = 0 AND id = 0 THEN 'Contents' WHEN page_idx = 0 AND length(text) < 120 THEN 'Unit ' || id || ' ' || substr(text, 1, 30) || ' ' || (id + 1)
 WHEN length(text) % 11 = 0 THEN 'Chapter ' || id WHEN length(text) % 11 = 1 THEN 'Section ' || id || ' ' || text WHEN length(text) % 11 = 2 THEN id || '.1 Part ' || substr(text, 1, 40) ELSE text END AS text FROM B)"""
_CASES = lambda i: " ".join(f"WHEN regexp_matches(text, '{h[2]}') THEN {h[i]}" for h in anchors.HEADINGS)
_NOISY = f"(regexp_matches(text, '(?i){predicates.any_of(predicates.TITLE_NOISE_ANY_CASE)}') OR regexp_matches(text, '{predicates.any_of(predicates.TITLE_NOISE_WITH_CASE)}'))"
_ANCH = f"A AS (SELECT doc_id, id AS block_id, page_idx AS page, trim(text) AS text, CASE {_CASES(0)} END AS level, CAST(CASE {_CASES(1)} END AS DOUBLE) AS confidence FROM H WHERE length(text) BETWEEN 3 AND 200 AND NOT {_NOISY})"


@query("pattern_anchors", f"WITH {B}, {_HEAD}, {_ANCH} SELECT doc_id, block_id, page, text, level, confidence FROM A WHERE level IS NOT NULL")
def pattern_anchors(spark, sf):
    return anchors.pattern_anchors(headed(spark, sf)).select("doc_id", "block_id", "page", "text", "level", "confidence")


@query("noisy_headings", f"WITH {B} SELECT doc_id, id, {_NOISY} AS noisy FROM (SELECT doc_id, id, CASE id % 3 WHEN 0 THEN 'Step 2 ' ELSE '' END || text AS text FROM B)")
def noisy_headings(spark, sf):
    return blocks(spark, sf).select("doc_id", "id", predicates.noisy_heading(F.concat(F.when(F.col("id") % 3 == 0, "Step 2 ").otherwise(""), "text")).alias("noisy"))


_MERGED = r"""F AS (SELECT * FROM A WHERE level IS NOT NULL AND NOT (regexp_matches(text, '(?i)^Chapter\s+\d+\s+\w{2,}') AND length(text) > 30)),
G AS (SELECT *, lead(level) OVER w AS nl, lead(block_id) OVER w AS nb FROM F WINDOW w AS (PARTITION BY doc_id ORDER BY block_id)),
G2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, level ORDER BY block_id) AS k FROM G WHERE NOT coalesce(regexp_matches(text, '(?i)^(Chapter|Unit|Part|Topic)\s+\d+\s*$') AND nl = level AND nb - block_id <= 2, false)),
M AS (SELECT doc_id, block_id, page, level, confidence FROM G2 WHERE k <= 3)"""


@query("anchor_merge", f"WITH {B}, {_HEAD}, {_ANCH}, {_MERGED} SELECT * FROM M")
def anchor_merge(spark, sf):
    return anchors.merge_anchors(anchors.pattern_anchors(headed(spark, sf))).select("doc_id", "block_id", "page", "level", "confidence")


@query("anchor_tree", f"""WITH {B}, {_HEAD}, {_ANCH}, {_MERGED}, N AS (SELECT doc_id, count(*) AS total FROM H GROUP BY doc_id), O AS (SELECT M.*, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block_id) - 1 AS INTEGER) AS ord FROM M)
SELECT a.doc_id, a.ord, a.level, a.block_id AS range_start, CAST(coalesce((SELECT min(b.block_id) FROM O b WHERE b.doc_id = a.doc_id AND b.ord > a.ord AND b.level <= a.level), N.total) AS INTEGER) AS range_end,
 (SELECT max(b.ord) FROM O b WHERE b.doc_id = a.doc_id AND b.ord < a.ord AND b.level < a.level) AS parent_id FROM O a JOIN N ON a.doc_id = N.doc_id""")
def anchor_tree(spark, sf):
    b = headed(spark, sf, kept_blocks(spark, sf))
    t = anchors.anchor_tree(anchors.merge_anchors(anchors.pattern_anchors(b)), b)
    return t.select("doc_id", "ord", "level", F.col("block_range.start").alias("range_start"), F.col("block_range.end").alias("range_end"), "parent_id")


@query("gap_regions", f"""WITH {B}, {_HEAD}, {_ANCH}, X AS (SELECT DISTINCT doc_id, id // 2 AS page FROM B), S AS (SELECT DISTINCT doc_id, unnest(range(block_id // 2 - 3, block_id // 2 + 4)) AS page FROM A WHERE level IS NOT NULL AND confidence >= 0.7),
R AS (SELECT X.doc_id, X.page, S.page AS hit, count(S.page) OVER w AS island, lead(X.page) OVER w AS nxt FROM X LEFT JOIN S ON X.doc_id = S.doc_id AND X.page = S.page WINDOW w AS (PARTITION BY X.doc_id ORDER BY X.page))
SELECT doc_id, CAST(min(page) AS INTEGER) AS start_page, CAST(max_by(coalesce(nxt - 1, page), page) AS INTEGER) AS end_page FROM R WHERE hit IS NULL GROUP BY doc_id, island HAVING end_page - start_page >= 5""")
def gap_regions(spark, sf):
    a = anchors.pattern_anchors(headed(spark, sf)).withColumn("page", F.floor(F.col("block_id") / 2).cast("int"))
    return anchors.gap_regions(blocks(spark, sf).withColumn("page_idx", F.floor(F.col("id") / 2).cast("int")), a)


@query("page_windows", f"WITH {B}, G AS (SELECT doc_id, 0 AS a, max(id) AS z FROM B GROUP BY doc_id) SELECT doc_id, CAST(s AS INTEGER) AS start_page, CAST(least(s + 4, z) AS INTEGER) AS end_page FROM (SELECT doc_id, z, unnest(range(a, z + 1, 3)) AS s FROM G)")
def page_windows(spark, sf):
    return anchors.page_windows(blocks(spark, sf).groupBy("doc_id").agg(F.lit(0).alias("start_page"), F.max("id").alias("end_page")))


_ENTRY = f"(length(text) >= 3 AND NOT regexp_matches(text, '(?i){predicates.any_of(anchors.IMPRINT)}') AND (regexp_matches(text, '{predicates.any_of(anchors.ENTRY_WITH_CASE)}') OR regexp_matches(text, '(?i){predicates.any_of(anchors.ENTRY_ANY_CASE)}')))"


_MARK = r"(regexp_matches(text, '{0}') OR regexp_matches(trim(regexp_replace(text, '^[>\-\s–—•·*#]+', '')), '{0}'))".format(anchors.CONTENTS_MARK)
#: Contents pages in SQL: view CP(doc_id, page_idx), after H.
_PAGES = rf"""PG AS (SELECT doc_id, page_idx, count(*) FILTER (WHERE {_ENTRY}) AS n, count(*) FILTER (WHERE {_ENTRY} OR regexp_matches(text, '^\d+(\.\d+)*\s+[A-Z]')) AS m, bool_or({_MARK}) AS mark FROM H WHERE page_idx <= 30 GROUP BY ALL),
PA AS (SELECT *, CASE WHEN lead(page_idx) OVER w = page_idx + 1 THEN lead(n) OVER w END AS nxt FROM PG WINDOW w AS (PARTITION BY doc_id ORDER BY page_idx)),
PS AS (SELECT doc_id, coalesce(min(page_idx) FILTER (WHERE mark AND n + coalesce(nxt, 0) >= 5), min(page_idx) FILTER (WHERE page_idx <= 15 AND n >= 8)) AS st FROM PA GROUP BY doc_id),
PR AS (SELECT PG.doc_id, page_idx, page_idx - st - row_number() OVER (PARTITION BY PG.doc_id ORDER BY page_idx) + 1 AS gap FROM PG JOIN PS ON PG.doc_id = PS.doc_id WHERE page_idx BETWEEN st AND least(st + 10, 30) AND (page_idx = st OR m >= 3)),
CP AS (SELECT doc_id, page_idx FROM PR WHERE gap = 0)"""


@query("contents_pages", f"WITH {B}, {_HEAD}, {_PAGES} SELECT doc_id, page_idx FROM CP")
def contents_pages(spark, sf):
    return anchors.contents_pages(headed(spark, sf))


#: Contents entries in SQL: view EN(doc_id, id, title, page_number, level, source_page), after CP.
_ENTRIES = rf"""K AS (SELECT H.*, regexp_matches(text, '^(.+?)[\s.]{{2,}}(\d{{1,4}})\s*$') AS wide, regexp_extract(text, '^(.+?)[\s.]{{2,}}(\d{{1,4}})\s*$', 1) AS t1, regexp_extract(text, '^(.+?)[\s.]{{2,}}(\d{{1,4}})\s*$', 2) AS n1,
 regexp_extract(text, '^(.+?)\s+(\d{{1,4}})\s*$', 1) AS t2, regexp_extract(text, '^(.+?)\s+(\d{{1,4}})\s*$', 2) AS n2, trim(regexp_replace(text, '^[>\-\s]+', '')) AS bare FROM H JOIN CP ON H.doc_id = CP.doc_id AND H.page_idx = CP.page_idx),
T2 AS (SELECT doc_id, id, page_idx, regexp_replace(trim(regexp_replace(trim(CASE WHEN wide THEN t1 WHEN length(t2) > 3 THEN t2 ELSE text END), '\.{{2,}}$', '')), '([0-9])([A-Z])', '\1 \2', 'g') AS title, TRY_CAST(CASE WHEN wide THEN n1 WHEN length(t2) > 3 THEN n2 END AS INTEGER) AS page_number
 FROM K WHERE length(text) >= 2 AND NOT regexp_matches(bare, '(?i)^(table\s+of\s+)?contents?$') AND bare <> '目录' AND NOT regexp_matches(text, '(?i){predicates.any_of(anchors.IMPRINT + anchors.IMPRINT_MORE)}')),
EN AS (SELECT doc_id, id, title, page_number, CASE {' '.join(f"WHEN regexp_matches(title, '{p}') THEN {k}" for k, p in anchors.ENTRY_LEVELS)} ELSE 1 END AS level, page_idx AS source_page
 FROM T2 WHERE length(title) BETWEEN 2 AND 120 AND NOT regexp_matches(title, '(?i){predicates.any_of(anchors.FRONT_MATTER)}'))"""


@query("contents_entries", f"WITH {B}, {_HEAD}, {_PAGES}, {_ENTRIES} SELECT doc_id, id, title, page_number, level, source_page FROM EN")
def contents_entries(spark, sf):
    b = headed(spark, sf, kept_blocks(spark, sf))
    return anchors.contents_entries(b, anchors.contents_pages(b))


@query("page_offset_mode", rf"""WITH {B}, X AS (SELECT doc_id, id, page_idx, trim(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '[^A-Za-z0-9_\s一-鿿]', '', 'g')) AS t FROM B),
S AS (SELECT *, list_distinct(string_split(t, ' ')) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY id) AS k FROM X),
M AS (SELECT a.doc_id, a.k, a.page_idx - a.doc_id % 5 AS printed, arg_min(b.page_idx, b.id) AS page FROM S a JOIN S b ON a.doc_id = b.doc_id AND b.t <> '' WHERE a.k <= 10 AND length(a.t) >= 3 AND len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) > 0.8 GROUP BY ALL),
O AS (SELECT doc_id, page - printed AS o, count(*) AS n, min(k) AS k FROM M GROUP BY ALL)
SELECT doc_id, CAST(o AS BIGINT) AS page_offset FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, k) AS r FROM O) WHERE r = 1""")
def page_offset_mode(spark, sf):
    b = kept_blocks(spark, sf)
    printed = b.select("doc_id", "id", F.col("text").alias("title"), (F.col("page_idx") - F.pmod("doc_id", F.lit(5))).alias("page_number"))
    return anchors.page_offsets(printed, b)


@query("total_pages", f"WITH {B} SELECT doc_id, max(page_idx) + 1 AS total_pages FROM B GROUP BY doc_id")
def total_pages(spark, sf):
    return anchors.total_pages(blocks(spark, sf))


@query("page_density", f"WITH {B}, {_HEAD} SELECT doc_id, page_idx, count(*) AS blocks, count(*) FILTER (WHERE {_ENTRY}) AS entries, md5(string_agg(id, ',' ORDER BY id)) AS digest FROM H GROUP BY ALL")
def page_density(spark, sf):
    d = anchors.page_density(headed(spark, sf))
    return d.select("doc_id", "page_idx", "blocks", "entries", F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("digest"))


@query("unmatched_titles", f"WITH {B}, {E} SELECT DISTINCT doc_id, title FROM E WHERE NOT EXISTS (SELECT 1 FROM E x WHERE x.doc_id = E.doc_id AND x.title = E.title AND x.level = 1)")
def unmatched_titles(spark, sf):
    e = entries_of(kept_blocks(spark, sf))
    return anchors.unmatched_titles(e, e.where("level = 1"))


@query("window_headings", f"""WITH {B}, G AS (SELECT doc_id, max(page_idx) AS z FROM B GROUP BY doc_id), W AS (SELECT doc_id, s AS start_page, least(s + 4, z) AS end_page FROM (SELECT doc_id, z, unnest(range(0, z + 1, 3)) AS s FROM G))
SELECT DISTINCT B.doc_id, B.id AS block_id, B.page_idx AS page, 'T' || B.id AS title, 2 AS level, CAST(0.65 AS DOUBLE) AS confidence FROM W JOIN B ON W.doc_id = B.doc_id AND B.page_idx BETWEEN start_page AND end_page AND (B.id = start_page * 10 OR B.id = start_page * 10 + 1)""")
def window_headings(spark, sf):
    b = blocks(spark, sf)
    w = anchors.page_windows(b.groupBy("doc_id").agg(F.lit(0).alias("start_page"), F.max("page_idx").alias("end_page")))
    one = lambda i: F.concat(F.lit('{"block_id": '), i, F.lit(', "level": 2, "title": "T'), i, F.lit('"}'))
    text = F.concat(F.lit('found: {"headings": ['), one(F.col("start_page") * 10), F.lit(", "), one(F.col("start_page") * 10 + 1), F.lit("]} end"))
    a = w.select("doc_id", "start_page", text.alias("output"))
    return anchors.window_headings(a, w, b).select("doc_id", "block_id", "page", "title", "level", F.col("confidence").cast("double"))


_SET = r"list_distinct(regexp_split_to_array({}, '\s+'))"


_NORMAL = r"trim(regexp_replace(regexp_replace(lower({}), '\s+', ' ', 'g'), '[^A-Za-z0-9_\s一-鿿]', '', 'g'))"
_NUMBER = r"regexp_extract({}, '^(\d+(?:\.\d+)*)', 1)"
#: The best block of each entry, of view J(doc_id, entry, block_id, page, num, text, ta, tb, wa, wb): view P4(doc_id, entry, y, conf).
_BEST = r"""J2 AS (SELECT *, CASE WHEN ta = '' OR tb = '' THEN 0.0 ELSE len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb))) END AS s FROM J),
R AS (SELECT *, tb <> '' AND (contains(tb, ta) OR contains(ta, tb)) AND s > 0 AS i, num <> '' AND (starts_with(text, num || ' ') OR starts_with(text, num || '.')) AS n, length(text) BETWEEN 3 AND 200 AND s > 0.6 AS c FROM J2),
R1 AS (SELECT *, max(CASE WHEN i THEN s END) OVER (PARTITION BY doc_id, entry) AS s1 FROM R),
P1 AS (SELECT doc_id, entry, max(CASE WHEN i THEN {'s': s, 'o': -block_id, 'b': block_id, 'p': page} END) AS x1,
       max(CASE WHEN n AND s > coalesce(s1, 0.5) AND s > 0.7 THEN {'s': s, 'o': -block_id, 'b': block_id, 'p': page} END) AS x2,
       arg_min(CASE WHEN n AND s > coalesce(s1, 0.5) THEN {'s': s, 'o': -block_id, 'b': block_id, 'p': page} END, block_id) FILTER (WHERE n AND s > coalesce(s1, 0.5)) AS x2f,
       max(CASE WHEN c THEN {'s': s, 'o': -block_id, 'b': block_id, 'p': page} END) AS x3 FROM R1 GROUP BY ALL),
P2 AS (SELECT *, coalesce(x1.s, 0) < 0.8 AND x2f IS NOT NULL AS two FROM P1),
P3 AS (SELECT *, CASE WHEN two THEN coalesce(x2, x2f) ELSE x1 END AS y, CASE WHEN two THEN greatest(coalesce(x2, x2f).s, 0.7) ELSE x1.s END AS conf FROM P2),
P4 AS (SELECT doc_id, entry, CASE WHEN three THEN x3 ELSE y END AS y, CASE WHEN three THEN x3.s ELSE conf END AS conf FROM (SELECT *, coalesce(coalesce(conf, 0) < 0.6 AND x3.s > coalesce(conf, 0), false) AS three FROM P3))"""


@query("anchors_of_contents", f"""WITH {B}, X AS (SELECT doc_id, id, page_idx, text, {_NORMAL.format('text')} AS t, {_NUMBER.format('text')} AS num FROM B),
S AS (SELECT *, {_SET.format('t')} AS w FROM X),
J AS (SELECT a.doc_id, a.id AS entry, b.id AS block_id, b.page_idx AS page, a.num, b.text, a.t AS ta, b.t AS tb, a.w AS wa, b.w AS wb FROM S a JOIN S b ON a.doc_id = b.doc_id AND b.page_idx BETWEEN a.page_idx - 1 AND a.page_idx + 1 WHERE a.t <> ''), {_BEST}
SELECT doc_id, entry, y.b AS block_id, y.p AS page, CAST(conf AS DOUBLE) AS confidence, 'toc_match' AS source FROM P4 WHERE y IS NOT NULL""")
def anchors_of_contents(spark, sf):
    """Every line as its own contents entry, looked for on its page and its neighbours."""
    b = kept_blocks(spark, sf)
    e = b.where(text_functions.normal_title("text") != "").select("doc_id", "id", F.col("text").alias("title"), F.col("page_idx").alias("page_number"), F.lit(1).alias("level"))
    zero = b.select("doc_id").distinct().withColumn("page_offset", F.lit(0))
    return anchors.match_contents(e, b, zero, reach=1).select("doc_id", "entry", "block_id", "page", "confidence", "source")


_RULES = f"""WITH {B}, {_HEAD}, {_PAGES}, {_ENTRIES}, BODY AS (SELECT H.* FROM H LEFT JOIN CP ON H.doc_id = CP.doc_id AND H.page_idx = CP.page_idx WHERE CP.doc_id IS NULL),
BT AS (SELECT *, {_SET.format('t')} AS w FROM (SELECT doc_id, id, page_idx, text, {_NORMAL.format('text')} AS t FROM BODY)),
F0 AS (SELECT doc_id, page_number, t, {_SET.format('t')} AS w, row_number() OVER (PARTITION BY doc_id ORDER BY id) AS k FROM (SELECT doc_id, id, page_number, {_NORMAL.format('title')} AS t FROM EN WHERE page_number IS NOT NULL)),
O1 AS (SELECT F0.doc_id, k, page_number, arg_min(BT.page_idx, BT.id) AS page FROM F0 JOIN BT ON F0.doc_id = BT.doc_id WHERE k <= 10 AND length(F0.t) >= 3 AND BT.t <> '' AND len(list_intersect(F0.w, BT.w)) / len(list_distinct(list_concat(F0.w, BT.w))) > 0.8 GROUP BY ALL),
O2 AS (SELECT doc_id, page - page_number AS o, count(*) AS n, min(k) AS k FROM O1 GROUP BY ALL),
OFS AS (SELECT doc_id, o FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, k) AS r FROM O2) WHERE r = 1),
EX AS (SELECT *, {_SET.format('ta')} AS wa FROM (SELECT EN.doc_id, EN.id AS entry, title, level, page_number + coalesce(o, 0) AS expected, {_NORMAL.format('title')} AS ta, {_NUMBER.format('title')} AS num FROM EN LEFT JOIN OFS ON EN.doc_id = OFS.doc_id)),
J AS (SELECT EX.doc_id, entry, BT.id AS block_id, BT.page_idx AS page, num, BT.text, ta, BT.t AS tb, wa, BT.w AS wb FROM EX JOIN BT ON EX.doc_id = BT.doc_id AND (BT.page_idx BETWEEN expected - 5 AND expected + 5 OR expected IS NULL)), {_BEST},
FOUND AS (SELECT P4.doc_id, P4.entry, y.b AS block_id, y.p AS page, BODY.text, EX.title, EX.level, conf AS confidence FROM P4 JOIN EX ON P4.doc_id = EX.doc_id AND P4.entry = EX.entry JOIN BODY ON BODY.doc_id = P4.doc_id AND BODY.id = y.b WHERE y IS NOT NULL),
FIRSTS AS (SELECT doc_id, page_idx AS page, min(id) AS block_id FROM BODY GROUP BY ALL),
G0 AS (SELECT EX.doc_id, EX.entry, title, level, FIRSTS.block_id, FIRSTS.page, CASE FIRSTS.page - expected WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS o FROM EX JOIN FIRSTS ON EX.doc_id = FIRSTS.doc_id AND FIRSTS.page BETWEEN expected - 1 AND expected + 1 WHERE NOT EXISTS (SELECT 1 FROM FOUND WHERE FOUND.doc_id = EX.doc_id AND FOUND.entry = EX.entry)),
G1 AS (SELECT doc_id, block_id, page, '' AS text, title, level, 0.4 AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, entry ORDER BY o) AS r FROM G0) WHERE r = 1),
{_ANCH.replace("FROM H WHERE", "FROM BODY WHERE")},
ALLA AS (SELECT doc_id, block_id, page, text, title, level, confidence, 1 AS toc FROM FOUND UNION ALL SELECT *, 1 FROM G1 UNION ALL SELECT doc_id, block_id, page, text, text, level, confidence, 0 FROM A WHERE level IS NOT NULL),
MB AS (SELECT doc_id, block_id, arg_max({{'page': page, 'text': text, 'title': title, 'level': level}}, {{'c': CAST(confidence AS DOUBLE), 'toc': toc, 'title': title}}) AS a FROM ALLA GROUP BY ALL),
F AS (SELECT doc_id, block_id, a.page AS page, a.text AS text, a.title AS title, a.level AS level FROM MB WHERE NOT (regexp_matches(a.text, '(?i)^Chapter\\s+\\d+\\s+\\w{{2,}}') AND length(trim(a.text)) > 30)),
G AS (SELECT *, lead(level) OVER w AS nl, lead(block_id) OVER w AS nb FROM F WINDOW w AS (PARTITION BY doc_id ORDER BY block_id)),
G2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, level ORDER BY block_id) AS k FROM G WHERE NOT coalesce(regexp_matches(text, '(?i)^(Chapter|Unit|Part|Topic)\\s+\\d+\\s*$') AND nl = level AND nb - block_id <= 2, false)),
N AS (SELECT doc_id, count(*) AS total FROM H GROUP BY doc_id),
O AS (SELECT doc_id, block_id, page, title, level, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block_id) - 1 AS INTEGER) AS ord FROM G2 WHERE k <= 3),
Z AS (SELECT a.*, N.total, (SELECT min(b.block_id) FROM O b WHERE b.doc_id = a.doc_id AND b.ord > a.ord AND b.level <= a.level) AS nxt, (SELECT max(b.ord) FROM O b WHERE b.doc_id = a.doc_id AND b.ord < a.ord AND b.level < a.level) AS up FROM O a JOIN N ON a.doc_id = N.doc_id)
SELECT a.doc_id, a.ord, a.title AS text, a.level, a.page, a.block_id AS range_start, CAST(coalesce(a.nxt, a.total) AS INTEGER) AS range_end, a.up AS parent_id, concat_ws(' > ', d.title, c.title, b.title, a.title) AS path
FROM Z a LEFT JOIN Z b ON a.doc_id = b.doc_id AND a.up = b.ord LEFT JOIN Z c ON a.doc_id = c.doc_id AND b.up = c.ord LEFT JOIN Z d ON a.doc_id = d.doc_id AND c.up = d.ord"""


@query("rule_tree", _RULES)
def rule_tree(spark, sf):
    t = rule_chapters(headed(spark, sf))  # which writes the blocks once itself
    return t.select("doc_id", "ord", "text", "level", "page", F.col("block_range.start").alias("range_start"), F.col("block_range.end").alias("range_end"), "parent_id", "path")


@query("chapter_dispatch", f"WITH {B}, {_HEAD}, {_PAGES} SELECT DISTINCT doc_id, doc_id IN (SELECT doc_id FROM CP) AS use_contents, true AS use_patterns, doc_id NOT IN (SELECT doc_id FROM CP) AS use_model FROM B")
def chapter_dispatch(spark, sf):
    return anchors.dispatch(headed(spark, sf, kept_blocks(spark, sf)))


@query("coverage_of_all", f"WITH {B}, {E}, {C}, X AS (SELECT DISTINCT doc_id, unnest(range(s, e)) AS b FROM C), K AS (SELECT doc_id, count(*) AS covered FROM X GROUP BY doc_id) SELECT N.doc_id, coalesce(covered, 0) / total AS coverage_rate FROM N LEFT JOIN K ON N.doc_id = K.doc_id")
def coverage_of_all(spark, sf):
    b = kept_blocks(spark, sf)
    return chapters.coverage_of_all(tree(spark, sf, b), b)


@query("block_texts", rf"""WITH X AS (SELECT doc_id, coalesce(text, '') AS t, repeat(coalesce(text, ''), 3) AS f FROM documents),
Y AS (SELECT doc_id, '![image](i/' || doc_id || '.jpg)' AS a, '![see ' || doc_id || '](i/b.jpg)' AS b, CASE WHEN t <> '' THEN '[Table] ' || t END AS c, CASE WHEN length(f) > 4096 THEN substr(f, 1, 4096) || '{answers.CUT_MARK}' WHEN f <> '' THEN f END AS e FROM X)
SELECT doc_id, md5(regexp_replace(concat_ws(chr(10), a, b, c, e), '^\s+|\s+$', '', 'g')) AS whole, 'pre/i/' || doc_id || '.jpg,pre/i/b.jpg' AS images, md5(regexp_replace(concat_ws(chr(10), b, c), '^\s+|\s+$', '', 'g')) AS inner_text FROM Y""")
def block_texts(spark, sf):
    """Images, tables and long formulas as they stand in a question; of the second list only ids within the chunk's bounds."""
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    none = F.lit(None).cast("string")
    one = lambda i, kind, text=none, img=none, caption=none: F.struct(F.lit(i).alias("id"), F.lit(kind).alias("type"), text.alias("text"), img.alias("img_path"), caption.alias("image_caption"))
    made = F.array(
        one(0, "image", img=F.concat(F.lit("i/"), "doc_id", F.lit(".jpg"))), one(1, "image", img=F.lit("i/b.jpg"), caption=F.concat(F.lit("see "), "doc_id")),
        one(2, "table", F.col("t")), one(3, "equation", F.repeat("t", 3)), one(4, "text", F.lit("")),
    )
    b = d.select("doc_id", F.explode(made).alias("b")).select("doc_id", "b.*")
    lists = d.select("doc_id", F.lit("0,1,2,3,4,9").alias("ids"))
    whole = answers.backfill(lists, "ids", b, ["doc_id"], prefix="pre/").select("doc_id", F.md5("text").alias("whole"), F.array_join("images", ",").alias("images"))
    inner = answers.backfill(lists.withColumn("lo", F.lit(1)).withColumn("hi", F.lit(2)), "ids", b, ["doc_id"]).select("doc_id", F.md5("text").alias("inner_text"))
    return whole.join(inner, "doc_id")


@query("chapter_merged_text", rf"""WITH {B}, {E} SELECT E.doc_id, E.ord, trim(concat_ws(' ', nullif(substr(B.text, 1, 80), ''), nullif(substr(N.text, 1, 80), ''))) AS text, B.page_idx AS page, CASE WHEN N.id IS NULL THEN E.id || ',' || (E.id + 1) ELSE E.id || ',' || (E.id + 1) END AS merged
FROM E JOIN B ON E.doc_id = B.doc_id AND E.id = B.id LEFT JOIN B N ON N.doc_id = E.doc_id AND N.id = E.id + 1""")
def chapter_merged_text(spark, sf):
    """Headings that run over two blocks."""
    b = kept_blocks(spark, sf)
    e = entries_of(b).withColumn("ids", F.array(F.col("ids")[0], F.col("ids")[0] + 1))
    return chapters.flat_map(e, b).select("doc_id", "ord", F.trim("text").alias("text"), "page", F.array_join(F.col("merged_ids").cast("array<string>"), ",").alias("merged"))


@query("answer_parse_legacy", f"WITH {B} SELECT doc_id, CAST(floor(id / 20) AS INTEGER) AS chunk_index, CAST(id % 20 AS INTEGER) AS pos, CAST(id + 1 AS VARCHAR) AS label, CASE WHEN length(text) % 2 = 0 THEN 'example' ELSE 'exercise' END AS type, CAST(id AS VARCHAR) AS question_ids, 'A' || id AS answer, CAST(NULL AS VARCHAR) AS error FROM B UNION ALL SELECT doc_id, -1, NULL, NULL, NULL, NULL, NULL, 'no question could be read' FROM documents")
def answer_parse_legacy(spark, sf):
    pairs = _answers(spark, sf, F.concat(F.col("id"), F.lit("</question><answer> A"), F.col("id"), F.lit(" </answer><question>")))
    bad = table(spark, sf, "documents").select("doc_id", F.lit(-1).alias("chunk_index"), F.lit("nothing here").alias("output"))
    return answers.parse_legacy(pairs.unionByName(bad)).select("doc_id", "chunk_index", "pos", "label", "type", "question_ids", "answer", "error")


#: Broken directory answers and what is read of them: (answer, whether it can be read, entries as id|level|title); # is a number of the document's.
_BROKEN = [
    ('{"directory": [{"id": #1, "level": 1, "title": "A#"}]}', True, ["#1|1|A#"]),
    ('{"directory": [{"id": #2, "level": , "title": "B"},]}', True, ["#2|1|B"]),
    ('{"chapters": [{"id": [3#, #4], "level": 2, "title": " C# "}', True, ["3#,#4|2|C#"]),
    ('note {"entries": [{"id": "5#", "level": "3", "title": "D"}]} end', True, ["5#|3|D"]),
    ('{"directory": [{"id": 6#, "level": 1, "title": "E#"}, {"id": 7#, "lev', True, ["6#|1|E#"]),
    ('{"directory": [{"id": 8#, "level": 9, "title": "F"}, {"id": "x#", "level": 1, "title": "G"}]}', True, []),
    ("no answer #", False, []),
]
_READ = [(i, "true", *(f"'{x}'" if k != 1 else x for k, x in enumerate(e.split("|")))) for i, (_, ok, es) in enumerate(_BROKEN) if ok for e in es]
_READ += [(i, "false", "CAST(NULL AS VARCHAR)", "CAST(NULL AS INTEGER)", "''") for i, (_, ok, _) in enumerate(_BROKEN) if not ok]


@query("json_repair_cases", "SELECT doc_id, k AS chunk_index, ok, replace(ids, '#', n) AS ids, level, replace(title, '#', n) AS title FROM (SELECT doc_id, CAST(len(string_split(coalesce(text, ''), chr(10))) AS VARCHAR) AS n FROM documents), (VALUES " + ", ".join(f"({', '.join(map(str, r))})" for r in _READ) + ") t(k, ok, ids, level, title)")
def json_repair_cases(spark, sf):
    """Each document's answer broken in every way that can be mended, and in one that can't; ids and titles hold its number of lines."""
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("string")
    cases = F.array(*[F.lit(t) for t, _, _ in _BROKEN])
    raw = table(spark, sf, "documents").select("doc_id", lines.alias("n"), F.posexplode(cases).alias("chunk_index", "t"))
    read = answers.directory_entries(raw.select("doc_id", "chunk_index", F.replace("t", F.lit("#"), F.col("n")).alias("output")), ("doc_id", "chunk_index"))
    return read.select("doc_id", "chunk_index", "ok", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "level", "title")
