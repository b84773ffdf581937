import pytest

WORDS = "the of and la de un moron idiot you une der die zwei gato été niño 東京 x1 don't".split()


def sentence(seed: int, n: int) -> str:
    out, x = [], seed * 2654435761 % 2**32
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 8) % len(WORDS)] + (str(x % 7) if x % 3 else ""))
    return " ".join(out)


def edge_rows() -> list[tuple]:
    a, b = sentence(1, 60), sentence(2, 90)
    rows = [
        (5, a), (3, a), (9, a + " tail"), (2, b), (7, "Head " + b), (11, None), (12, ""), (None, "Null id text, " + a), (None, None),
        (4, " \n\t "), (4, " \n\t "), (20, "one"), (21, "Two words"), (22, "HELLO Wörld İß ǅ ½ ² ٣ 's 'S don't\x1c\x85 \u3000\u200b  end  \n\n"),
        (30, sentence(3, 30000)), (31, sentence(1, 25) + " mid " + sentence(1, 25)), (32, "rep " * 50), (33, "rep " * 50), (34, "x" * 5000),
        (40, sentence(9, 40) + " " + a[: len(a) // 2]), (41, sentence(10, 15) + " " + b), (42, "a b " * 15),
    ]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark):
    rows = [(*r, "key", 1, "words", 2.0, "w") for r in edge_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, fp int, words string, score double, chunk string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture(scope="session")
def some_docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
