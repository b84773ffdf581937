"""Boolean and verdict columns over titles, ids and chunks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.text import _col, trim_ws, word_count

# Heading texts that are no chapters; the first group is matched with case, the second without.
NOISE_WITH_CASE = [
    "^要点归纳$", "^疑难分析$", "^基础训练$", "^拓展训练$", "^综合训练$",
    r"^[一二三四五六七八九十]\s*[、.．]\s*(填空题|选择题|解答题|计算题|综合题|证明题)",
    r"^例题?\s*\d", r"^练习\s*\d", r"^习题\s*\d",
    r"^定价\s*[\d.]", r"^(开本|版次|印张|字数|印刷)[\s\d]", "^出版发行", r"^(社址|书名|编\s*者)", r"^(邮编|热线|电话)\s*\d",
    r"^(网\s*址|官方微[博信]|销售咨询)", "版权所有", "凡购买", r"CIP数据|\(CIP\)", r"^\s*[■◆●▪]", r"^目\s*录$", r"^\[Image\]$", "^图书销售",
]
NOISE_ANY_CASE = [
    r"^Key\s+Points$", "^Tip$", "^Note$", r"^Activity\s*\d*$", r"^Exercise\s*\d*$", r"^Exercises\s*\d*$", r"^Q\s*&\s*A$",
    r"^Multiple\s+Choice$", r"^Section\s+[A-Z]$", r"^Question\s*\d+$", r"^Example\s*\d*", r"^Practice\s*(Test|Questions)?",
    r"^Past\s+paper\s+questions?", r"^ISBN\s",
]
# Words that mark a structure, verbs that begin a question, signs of a formula.
STRUCTURAL = "chapter|unit|module|part|section|lesson|topic|appendix|glossary|index|review|summary|preface|introduction|foreword"
QUESTION_VERB = r"^(simplify|solve|find|calculate|evaluate|show|prove|determine|given|use|draw|write|work\s+out)\b"
FORMULA = r"[=<>$]|\\frac|\\sqrt|\\sum|\\int"
# Kinds of exercises that are no titles, titles that mark a structure, labels of questions and examples.
NOISE_TITLES = ["选择题", "填空题", "判断题", "应用题", "计算题", "递等式", "竖式", "基础训练", "拓展训练", "练习", "练习题", "随堂练习", "综合训练"]
STRUCTURAL_TITLES = [r"^\d+(\.\d+)*$", "第[一二三四五六七八九十百零]+章", r"^Unit\s*\d+", r"^Chapter\s*\d+"]
NUMERIC_LABEL, EXAMPLE_LABEL = r"^\s*\d+[.．、]", r"例\d"
# Headings that are no chapters, without and with case.
TITLE_NOISE_ANY_CASE = [
    r"^(Question|Problem|Q)\s*\d", r"^\d+\.\s+(Find|Calculate|Solve|Determine|Evaluate|Simplify|Write|Show|Prove|Given)",
    r"^(Figure|Table|Diagram|Graph)\s+\d", r"^Page\s+\d", "^(Answer|Solution|Hint|Explanation)",
    r"^(EXAMPLE|STEP|TRY IT|DO YOU|FOCUS ON|LOOK FOR|PRACTICE|APPLY|ASSESS|COMMON ERROR)\s", r"^(Example|Step)\s+\d",
]
TITLE_NOISE_WITH_CASE = [r"^[A-E]\.\s", r"^\([a-e]\)", r"^\d+\s*$"]


def any_of(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def any_at_start(patterns: list[str]) -> str:
    """The same for patterns that all begin with ^ (or with (?i)^): what comes after the first character is never tried."""
    flags = ["(?i)" if p.startswith("(?i)") else "" for p in patterns]
    bare = [p.removeprefix(f) for p, f in zip(patterns, flags, strict=True)]
    if not all(p.startswith("^") for p in bare):
        raise ValueError(patterns)
    return "^(?:" + "|".join(f"(?:{f}{p[1:]})" for p, f in zip(bare, flags, strict=True)) + ")"


@dataclass(frozen=True)
class TitleRules:
    """Limits of chapter titles, and the texts that are noise or mark a structure."""

    min_length: int = 2
    max_length: int = 120
    max_words: int = 16
    max_digit_ratio: float = 0.5
    enabled: bool = True
    noise: list[str] = field(default_factory=lambda: list(NOISE_TITLES))
    structural: list[str] = field(default_factory=lambda: list(STRUCTURAL_TITLES))


@dataclass(frozen=True)
class SanityRules:
    min_blocks: int = 40
    min_ratio: float = 0.02
    numeric_label: str = NUMERIC_LABEL
    example_label: str = EXAMPLE_LABEL


def digit_ratio(c: Column | str) -> Column:
    c = _col(c)
    return F.when(F.length(c) > 0, F.length(F.regexp_replace(c, r"[^\d]+", "")) / F.length(c)).otherwise(0.0)


def cleanup_reason(text: Column | str, title: Column | str, rules: TitleRules = TitleRules()) -> Column:
    """Why a chapter entry goes (noise, empty, length, words, digits, question, formula), or null if it stays."""
    t, title = trim_ws(F.coalesce(_col(text), _col(title))), _col(title)
    plain = ~t.rlike(f"(?i)({STRUCTURAL})")
    return (
        F.when(t.rlike(any_of(NOISE_WITH_CASE)) | t.rlike("(?i)" + any_of(NOISE_ANY_CASE)), "noise")
        .when((t == "") & (trim_ws(title) == ""), "empty")
        .when((F.length(t) < rules.min_length) | (F.length(t) > rules.max_length), "length")
        .when(word_count(t, rules.max_words) > rules.max_words, "words")
        .when((digit_ratio(t) > rules.max_digit_ratio) & plain, "digits")
        .when(t.rlike("(?i)" + QUESTION_VERB) & plain, "question")
        .when(t.rlike(FORMULA) & plain, "formula")
    )


def has_noise(title: Column | str, words: list[str]) -> Column:
    title = _col(title)
    out = F.lit(False)
    for w in words:
        out = out | title.contains(w)
    return F.coalesce(out, F.lit(False))


def title_valid(title: Column | str, rules: TitleRules = TitleRules()) -> Column:
    """Whether a question's chapter title may be used; a path (' > ') is free of the limits of length and formulas."""
    t = trim_ws(F.coalesce(_col(title), F.lit("")))
    if not rules.enabled:
        return F.coalesce(_col(title), F.lit("")) != ""
    path = t.contains(" > ")
    loose = ~t.rlike(any_of(rules.structural)) if rules.structural else F.lit(True)
    bad = (
        (t == "") | has_noise(t, rules.noise)
        | (~path & ((F.length(t) < rules.min_length) | (F.length(t) > rules.max_length) | (word_count(t, rules.max_words) > rules.max_words)))
        | ((digit_ratio(t) > rules.max_digit_ratio) & loose)
        | (t.rlike("(?i)" + QUESTION_VERB) & loose)
        | (~path & t.rlike(FORMULA) & loose)
    )
    return ~bad


def structural_title(title: Column | str, rules: TitleRules = TitleRules()) -> Column:
    return F.coalesce(_col(title), F.lit("")).rlike(any_of(rules.structural))


def good_question(question: Column | str, label: Column | str, least: int = 5) -> Column:
    q = trim_ws(F.coalesce(_col(question), F.lit("")))
    return (F.length(q) >= least) & (trim_ws(F.coalesce(_col(label), F.lit(""))) != "")


def is_id_sequence(ids: Column | str) -> Column:
    bare = F.regexp_replace(F.coalesce(_col(ids), F.lit("")), r"\s", "")
    return bare.rlike(r"^[\d,]*$")


def sanity_verdict(questions: Column, blocks: Column, numeric: Column, example: Column, rules: SanityRules = SanityRules()) -> Column:
    """ok, zero_output (labels seen but nothing found) or low_ratio."""
    return (
        F.when((questions == 0) & (numeric | example), "zero_output")
        .when((blocks > rules.min_blocks) & (questions / blocks < rules.min_ratio) & ~numeric, "low_ratio")
        .otherwise("ok")
    )


def noisy_heading(text: Column | str) -> Column:
    t = trim_ws(text)
    return t.rlike("(?i)" + any_at_start(TITLE_NOISE_ANY_CASE)) | t.rlike(any_at_start(TITLE_NOISE_WITH_CASE))


def serves_purpose(purpose: Column | str, wanted: str) -> Column:
    """Whether a model configuration serves 'vision' or 'long' work."""
    p = _col(purpose)
    return p.isNull() | p.isin("vision_extract", "general") if wanted == "vision" else F.coalesce(p.isin("long_context", "general"), F.lit(False))
