"""Results as JSON and Markdown, one text for each document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.text import relative_path

JSON_FIELDS = ["label", "type", "chapter_title", "question", "solution", "images", "page_idx", "has_answer", "questionIds", "solutionIds", "chapterTitleIds"]


def _portable(questions: DataFrame, folder: str | None) -> DataFrame:
    return questions if folder is None else questions.withColumn("images", F.transform("images", lambda p: relative_path(p, F.lit(folder))))


def json_rows(questions: DataFrame, folder: str | None = None) -> DataFrame:
    """(doc_id, seq, json): a question for each line, the form in which large results are written."""
    q = _portable(questions, folder)
    names = {"questionIds": "question_ids", "solutionIds": "solution_ids", "chapterTitleIds": "chapter_title_ids"}
    fields = [F.col(names.get(f, f)).alias(f) for f in JSON_FIELDS if names.get(f, f) in q.columns]
    return q.select("doc_id", "seq", F.to_json(F.struct(*fields)).alias("json"))


def json_text(questions: DataFrame, folder: str | None = None) -> DataFrame:
    """(doc_id, total, json): all questions of a document in one text."""
    rows = json_rows(questions, folder).groupBy("doc_id").agg(F.count("*").alias("total"), F.sort_array(F.collect_list(F.struct("seq", "json"))).alias("x"))
    return rows.select("doc_id", "total", F.concat(F.lit('{"total":'), F.col("total").cast("string"), F.lit(',"questions":['), F.array_join(F.col("x.json"), ","), F.lit("]}")).alias("json"))


def markdown_parts(questions: DataFrame, folder: str | None = None) -> DataFrame:
    """(doc_id, seq, part): the Markdown of each question; a heading where the chapter changes."""
    q = _portable(questions, folder)
    before = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    title = F.coalesce("chapter_title", F.lit(""))
    current = F.coalesce(F.last(F.when(title != "", title), ignorenulls=True).over(before), F.lit(""))
    head = F.when((title != "") & (title != current), F.concat(F.lit("## "), title, F.lit("\n\n"))).otherwise("")
    kind = F.when(F.col("type") == "example", "例题").otherwise("练习题")
    pictures = F.array_join(F.transform(F.coalesce("images", F.array().cast("array<string>")), lambda i: F.concat(F.lit("![图片]("), i, F.lit(")\n\n"))), "")
    answer = F.when((F.col("type") == "example") & (F.coalesce("solution", F.lit("")) != ""), F.concat(F.lit("**解答**: "), "solution", F.lit("\n\n"))).otherwise("")
    part = F.concat(head, F.lit("### "), "label", F.lit(" ("), kind, F.lit(")\n\n**题目**: "), "question", F.lit("\n\n"), pictures, answer, F.lit("---\n\n"))
    return q.select("doc_id", "seq", part.alias("part"))


def markdown_text(questions: DataFrame, folder: str | None = None) -> DataFrame:
    """(doc_id, total, markdown)."""
    rows = markdown_parts(questions, folder).groupBy("doc_id").agg(F.count("*").alias("total"), F.sort_array(F.collect_list(F.struct("seq", "part"))).alias("x"))
    head = F.concat(F.lit("# 提取的题目\n\n**总数**: "), F.col("total").cast("string"), F.lit("\n\n---\n\n"))
    return rows.select("doc_id", "total", F.concat(head, F.array_join(F.col("x.part"), "")).alias("markdown"))


def result_names(tasks: DataFrame) -> DataFrame:
    """(id, json_name, markdown_name): the names under which a task's results are handed out."""
    return tasks.select("id", F.concat("name", F.lit("_questions.json")).alias("json_name"), F.concat("name", F.lit("_questions.md")).alias("markdown_name"))


def write_results(questions: DataFrame, path: str, folder: str | None = None) -> None:
    """One JSON line for each question, as text files, and one Markdown text for each document, written in parallel."""
    json_rows(questions, folder).select("json").write.mode("overwrite").text(f"{path}/json")
    markdown_text(questions, folder).write.mode("overwrite").parquet(f"{path}/markdown")


def write_stage(rows: DataFrame, folder: str, name: str) -> None:
    """A stage's table kept for inspection: formatted blocks, prompts, raw and parsed answers, verdicts."""
    rows.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")
