"""Named strategies with fallbacks, compiled to one column when the plan is built."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.text import _col, trim_ws

# Section markers and headers of answers; the strategies' names, scores and reasons below are fixed, too.
SECTION_MARKER = "^(一、|二、|三、|四、|五、|六、|七、|八、|九、|十、)(选择题|填空题|判断题|解答题|综合题|本章小结|复习题)"
ANSWER_HEADER = r"(?i)(参考答案|答案|解答|Answer\s*Key)"


@dataclass(frozen=True)
class Strategy:
    """run: text column -> result struct; fallback: the strategy asked next while the action is keep."""

    run: Callable[[Column], Column]
    fallback: str | None = None


def result(action: str, score: float | None = None, reason: str | None = None) -> Column:
    return F.struct(F.lit(action).alias("action"), F.lit(score).cast("double").alias("score"), F.lit(reason).cast("string").alias("reason"))


def run_chain(strategies: Mapping[str, Strategy], name: str, text: Column | str) -> Column:
    """The result of a chain as a struct (action, score, reason); cycles and unknown names end it."""
    t, seen, steps = trim_ws(F.coalesce(_col(text), F.lit(""))), set(), []
    at: str | None = name
    while at is not None and at in strategies and at not in seen:
        seen.add(at)
        steps.append(strategies[at].run(t))
        at = strategies[at].fallback
    if not steps:
        return result("keep")
    out = steps[-1]
    for step in reversed(steps[:-1]):
        out = F.when(step["action"] != "keep", step).otherwise(out)
    return out


TITLE_FILTERS = {
    "section_marker_filter": Strategy(lambda t: F.when(t.rlike(SECTION_MARKER), result("drop", 1.0, "Section marker")).otherwise(result("keep")), "length_filter"),
    "length_filter": Strategy(lambda t: F.when(F.length(t) > 100, result("drop", None, "Title too long")).otherwise(result("keep"))),
}
ANSWER_HEADERS = {
    "explicit_header_match": Strategy(lambda t: F.when(t.rlike(ANSWER_HEADER), result("found", 1.0)).otherwise(result("keep")), "short_header_match"),
    "short_header_match": Strategy(
        lambda t: F.when(F.length(t) > 40, result("keep", None, "Text too long for heuristic")).when(t.rlike(ANSWER_HEADER), result("found", 0.8)).otherwise(result("keep"))
    ),
}
