"""The ledger of model calls, and edit scripts of texts."""

import os
import random
from collections import Counter

import pytest

from pageloom.operators import text_diff
from pageloom.plans.providers import CallLedger, CallProvider


def asker(folder, dies_at=None, fails=()):
    """Notes each prompt in a file of its own; may end its process, or fail."""

    def ask(prompt, temperature=0):
        import os as o
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(prompt)
        if prompt == dies_at and not o.path.exists(f"{folder}.dead"):
            open(f"{folder}.dead", "w").close()
            o._exit(1)
        if prompt in fails and not o.path.exists(f"{folder}.mended"):
            raise ValueError("no " + prompt)
        return f"answer to {prompt} at {temperature}"

    return ask


def asked(folder):
    return Counter(open(f"{folder}/{name}").read() for name in os.listdir(folder))


@pytest.fixture
def prompts(spark):
    rows = [(f"d{i}", i % 3, f"prompt {i % 20}") for i in range(24)]  # four prompts are there twice
    return spark.createDataFrame(rows, "doc_id string, chunk_index int, prompt string")


def test_killed_job_goes_on(spark, tmp_path, prompts):
    folder, ledger = str(tmp_path / "asked"), str(tmp_path / "ledger")
    os.mkdir(folder)

    def provider(**more):
        return CallProvider(asker(folder, **more), workers=4, delays=(), options={"temperature": 1}, ledger=ledger)

    with pytest.raises(Exception, match="(?i)worker|exit|crash|lost|fail"):
        provider(dies_at="prompt 7").complete(prompts, 0)
    before, kept = asked(folder), {r.call for r in CallLedger(spark, ledger).answered().collect()}
    got = provider(dies_at="prompt 7").complete(prompts, 0).collect()
    assert sorted((r.doc_id, r.output, r.success, r.error) for r in got) == sorted((f"d{i}", f"answer to prompt {i % 20} at 1", True, None) for i in range(24))
    twice = [p for p, n in asked(folder).items() if n > 1]
    assert len(kept) >= sum(before.values()) - 8 and len(twice) <= 8, (len(kept), before, twice)  # the wave that died, at most
    total = sum(asked(folder).values())
    other = CallProvider(asker(folder), workers=2, delays=(), options={"temperature": 1}, ledger=ledger)
    assert other.complete(prompts, 0).count() == 24 and sum(asked(folder).values()) == total  # nothing is asked again
    other.complete(prompts.limit(2), 1).count()
    assert sum(asked(folder).values()) == total + 2  # another turn is another call


def test_stop_between_waves_and_failed_calls(spark, tmp_path, prompts):
    folder, ledger, turns = str(tmp_path / "asked"), str(tmp_path / "ledger"), []
    os.mkdir(folder)

    def point():
        turns.append(1)
        if len(turns) == 3:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        CallProvider(asker(folder), workers=3, delays=(), ledger=ledger, point=point).complete(prompts)
    first = asked(folder)
    assert first and max(first.values()) == 1
    failing = CallProvider(asker(folder, fails=["prompt 3", "prompt 4"]), workers=3, attempts=2, delays=(), ledger=ledger)
    got = {r.doc_id: r for r in failing.complete(prompts).collect()}
    assert len(got) == 24 and all(asked(folder)[p] == 1 for p in first)
    lost = {p for p in ("prompt 3", "prompt 4") if p not in first}
    assert {r.doc_id for r in got.values() if not r.success} == {f"d{i}" for i in range(24) if f"prompt {i % 20}" in lost} and all(r.output is None and r.error.startswith("no ") for r in got.values() if not r.success)
    open(f"{folder}.mended", "w").close()
    assert failing.complete(prompts).where("success").count() == 24


def test_hunks_rebuild_both_texts(spark):
    rnd = random.Random(8)
    text = lambda: "\n".join(rnd.choice(["a", "b", "c", "", "dd"]) for _ in range(rnd.randint(0, 60)))
    rows = [(i, text(), text()) for i in range(60)] + [(90, None, "x"), (91, "x", None), (92, "", ""), (93, "x\n" * 2000, "y\n" + "x\n" * 2000), (94, "same\nsame", "same\nsame")]
    texts = spark.createDataFrame(rows, "doc_id long, a string, b string")
    got = {}
    for r in text_diff.diff_hunks(texts).orderBy("doc_id", "ord").collect():
        got.setdefault(r.doc_id, []).append(r)
    counts = {r.doc_id: (r.same, r.added, r.removed) for r in text_diff.line_diff(texts).collect()}
    for i, a, b in rows:
        runs = got[i]
        lines = lambda *kinds: [x for r in runs if r.kind in kinds for x in r.lines]
        assert lines("equal", "removed") == (a or "").split("\n") and lines("equal", "added") == (b or "").split("\n")
        assert (len(lines("equal")), len(lines("added")), len(lines("removed"))) == counts[i]
        assert [r.ord for r in runs] == list(range(len(runs))) and all(x.kind != y.kind for x, y in zip(runs, runs[1:]))
        assert all((a or "").split("\n")[r.a_line : r.a_line + len(r.lines)] == r.lines for r in runs if r.kind != "added")
        assert all((b or "").split("\n")[r.b_line : r.b_line + len(r.lines)] == r.lines for r in runs if r.kind != "removed")


def test_halved_tables_are_as_good():
    rnd = random.Random(9)
    for _ in range(200):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 40))] for _ in range(2))
        for bits in (1, 50, 1 << 20):
            pairs = text_diff.matches(a, b, bits)
            assert len(pairs) == text_diff.common_lines(a, b) and all(a[i] == b[j] for i, j in pairs)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
