"""Layout files as rows and streams, and result files under their names."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from pageloom.operators import exports
from pageloom.operators.blocks import RAW_BLOCK, flatten_block_rows, flatten_blocks
from pageloom.sources import layouts, readers, results


def plain_file(rnd, n):
    kinds = [{"type": "text", "text": "päge [1], {x} \"q\" 東京\n", "text_level": 1, "page_idx": 3}, {"type": "list", "sub_type": "text", "list_items": ["a", "b "]}, {"type": "image", "img_path": "i.jpg", "image_caption": ["x", "y"], "bbox": [1, 2.5, 3, 4]}, {"type": "table", "table_body": "<tr>1</tr>", "inside": [{"type": "text", "text": "in", "text_level": None}]}, {"type": None, "page_idx": "7", "other": [1]}, {}]
    return [dict(rnd.choice(kinds)) for _ in range(n)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rnd, top = random.Random(5), tmp_path_factory.mktemp("layouts")
    for i in range(7):
        os.makedirs(top / f"t{i}")
        text = json.dumps(plain_file(rnd, rnd.randint(0, 60)), ensure_ascii=i % 2 == 0, indent=i % 3 or None)
        (top / f"t{i}" / "x_content_list.json").write_text(text, encoding="utf-8")
    (top / "t0" / "other.json").write_text("[]")
    return str(top)


def test_elements_of_any_pieces():
    want = [1, {"a": "]}\\\""}, [2, [3]], "x,y", None, -4.5, "é"]
    raw = json.dumps(want, ensure_ascii=False).encode()
    for size in (1, 2, 3, 7, 1000):
        assert list(layouts.elements(iter([raw[i : i + size] for i in range(0, len(raw), size)]))) == want
    for raw, want in ((b"", []), (b"{}", []), (b"[", []), (b"[1, 2", [1, 2]), (b'[1, {"a": ', [1]), (b"[] 5", []), (b"\xef\xbb\xbf[12]", [12])):
        assert list(layouts.elements(iter([raw]))) == want


def test_source_equals_whole_files(spark, folder):
    spark.dataSource.register(layouts.LayoutSource)
    rows = spark.read.format("layout").load(folder)
    assert rows.columns == ["doc_id", "pos", *RAW_BLOCK.names]
    whole = readers.read_layouts(spark, f"{folder}/*/x_content_list.json").select(F.regexp_replace("doc_id", "^file:/*", "/").alias("doc_id"), F.posexplode("blocks").alias("pos", "b")).select("doc_id", "pos", "b.*")
    show = lambda df: sorted(map(repr, df.collect()))
    assert show(rows) == show(whole) and rows.count() > 50
    same = readers.read_layouts(spark, f"{folder}/*/x_content_list.json").withColumn("doc_id", F.regexp_replace("doc_id", "^file:/*", "/"))
    assert show(flatten_block_rows(rows)) == show(flatten_blocks(same))


def test_some_fields_and_partitions(spark, folder, monkeypatch):
    spark.dataSource.register(layouts.LayoutSource)
    few = spark.read.format("layout").schema("doc_id string, pos int, type string, text string").load(folder)
    assert few.columns == ["doc_id", "pos", "type", "text"]
    assert sorted(map(tuple, few.collect())) is not None and few.where("type = 'text'").count() == spark.read.format("layout").load(folder).where("type = 'text'").count()
    monkeypatch.setattr(layouts, "PARTITION_BYTES", 1)
    parts = layouts.LayoutSource({"path": folder}).reader(layouts.LayoutSource({}).schema()).partitions()
    assert len(parts) == 7 and spark.read.format("layout").load(folder + "/none").count() == 0


def test_stream_of_new_files(spark, tmp_path):
    spark.dataSource.register(layouts.LayoutSource)
    os.makedirs(tmp_path / "in")

    def follow():
        stream = spark.readStream.format("layout").option("path", str(tmp_path / "in")).load().select("doc_id", "pos", "text")
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()
        return sorted((r.doc_id.split("/")[-1][:2], r.pos, r.text) for r in spark.read.schema("doc_id string, pos int, text string").parquet(str(tmp_path / "out")).collect())

    (tmp_path / "in" / "01_content_list.json").write_text('[{"text": "a"}, {"text": "b"}]')
    assert follow() == [("01", 0, "a"), ("01", 1, "b")]
    (tmp_path / "in" / "02_content_list.json").write_text('[{"text": "c"}]')
    assert follow() == [("01", 0, "a"), ("01", 1, "b"), ("02", 0, "c")]


def questions(spark):
    rows = [(d, i, f"{i}", "exercise", "T", f"q{d}{i} é", "", ["/o/images/a.jpg"], 0, False, str(i), "", "") for d in (1, 2, 3) for i in range(d)]
    return spark.createDataFrame(rows, "doc_id long, seq int, label string, type string, chapter_title string, question string, solution string, images array<string>, page_idx int, has_answer boolean, question_ids string, solution_ids string, chapter_title_ids string")


def test_results_under_their_names(spark, tmp_path):
    q, tasks = questions(spark), spark.createDataFrame([(1, "one"), (2, "zwei é"), (3, "three"), (4, "none")], "id long, name string")
    results.write_result_files(q, tasks, str(tmp_path / "out"), "/o")
    want = {f"{n}_questions.{kind}": text for n, i in (("one", 1), ("zwei é", 2), ("three", 3)) for kind, text in (("json", exports.json_text(q, "/o").where(F.col("doc_id") == i).first().json), ("md", exports.markdown_text(q, "/o").where(F.col("doc_id") == i).first().markdown))}
    assert {n: (tmp_path / "out" / n).read_bytes() for n in os.listdir(tmp_path / "out")} == {n: t.encode() for n, t in want.items()}


def test_failed_writes_leave_nothing(spark, tmp_path):
    spark.dataSource.register(results.ResultSink)
    write = lambda rows: spark.createDataFrame(rows, results.SCHEMA).repartition(3).write.format("results").mode("append").option("path", str(tmp_path / "out")).save()
    write([("kept", "x")])
    for rows in ([("a", "1"), ("b", "2"), ("../c", "3")], [("a", "1"), ("b", "2"), ("a", "3")]):
        with pytest.raises(Exception, match="name"):
            write(rows)
        assert os.listdir(tmp_path / "out") == ["kept"]
    write([("kept", "y"), ("more", None)])
    assert {n: (tmp_path / "out" / n).read_text() for n in sorted(os.listdir(tmp_path / "out"))} == {"kept": "y", "more": ""}
