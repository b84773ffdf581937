"""The driver's contract, with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
FAST = ["blocks_flatten", "layout_flatten", "chapter_paths", "block_chapter", "title_continuity", "export_markdown", "answer_parse_lenient", "anchor_tree", "task_roots", "transitions_valid", "events_sessions", "compare_results"]


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns and df.limit(5).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_corpus_operators(tmp_path):
    for name in ("pageloom", "__spark_entry__.py"):
        (shutil.copytree if os.path.isdir(f"{ROOT}/{name}") else shutil.copy)(f"{ROOT}/{name}", tmp_path / name)
    shutil.rmtree(tmp_path / "pageloom" / "llm", ignore_errors=True)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()))"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split()[1] == "False" and int(out.stdout.split()[0]) > 60


@pytest.mark.parametrize("name", FAST)
def test_against_sql(spark, sf, name):
    """Row counts and columns here; the driver compares all values of all queries."""
    import __spark_entry__ as e

    con = duckdb.connect()
    for t in ("documents", "pages", "events", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(e.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    rows = want.fetchall()
    got = e.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(cols)
    mine = [tuple(r[c] for c in cols) for r in got.collect()]
    show = lambda r: "|".join(f"{x:.6g}" if isinstance(x, float) else str(x)[:19] if hasattr(x, "isoformat") else repr(x) for x in r)
    assert sorted(map(show, mine)) == sorted(map(show, rows))
