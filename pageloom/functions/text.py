"""Column expressions for text: trimming, token estimates, labels, titles and display formats.

White space is the class that the source format uses (it includes U+00A0, U+3000 and U+FEFF), not Java's ASCII one.
Classes that are tried on every character name ASCII ones singly, which Java keeps in one bit set, and have others behind
one range.
"""

from __future__ import annotations

from string import ascii_letters, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[ \t\n\x0B\f\r\x{00A0}[\x{1680}-\x{FEFF}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]]]"
WS_NO_SPACE = WS.replace("[ ", "[", 1)
#: The characters of WS, for trimming without a pattern.
WS_CHARS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Characters that normal titles have none of; Chinese numerals.
NO_WORD = rf"[^{ascii_letters}{digits}_ \t\n\x0B\f\r\x{{4e00}}-\x{{9fff}}]"
NUMERAL = r"[\x{4e00}-\x{9fff}&&[一二三四五六七八九十百零]]"
LINE_LIMIT, TITLE_LIMIT = 200, 80

# Display names of language codes and file endings of sound types.
LANGUAGES = {
    "en": "English", "es": "Spanish", "fr": "French", "de": "German", "it": "Italian", "pt": "Portuguese", "ru": "Russian",
    "ja": "Japanese", "ko": "Korean", "zh": "Chinese", "ar": "Arabic", "hi": "Hindi", "nl": "Dutch", "pl": "Polish",
    "tr": "Turkish", "sv": "Swedish", "da": "Danish", "no": "Norwegian", "fi": "Finnish",
}
SOUND_ENDINGS = {
    "audio/webm": "webm", "audio/mp3": "mp3", "audio/mpeg": "mp3", "audio/wav": "wav", "audio/wave": "wav",
    "audio/ogg": "ogg", "audio/m4a": "m4a", "audio/mp4": "m4a",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_ws(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(WS_CHARS))


def trim_plain(c: Column | str) -> Column:
    """The same for a column as it is: trimming from the right takes notes of every character, so it is left out where the last one is no white space."""
    c = _col(c)
    return F.when(F.substring(c, -1, 1).isin(*WS_CHARS), trim_ws(c)).otherwise(F.ltrim(c, F.lit(WS_CHARS)))


def collapse_ws(c: Column | str) -> Column:
    """Each run of white space as one space; single spaces are no match, so that a plain text is only read."""
    return F.regexp_replace(_col(c), f"(?: {WS}|{WS_NO_SPACE}){WS}*", " ")


def word_count(c: Column | str, upto: int | None = None) -> Column:
    """Number of runs without white space; with ``upto`` those beyond it count as one, and the text behind them isn't looked at."""
    if upto is None:
        t = trim_ws(c)
        return F.when(t == "", 0).otherwise(F.size(F.split(t, f"{WS}+")))
    runs = F.split(F.ltrim(_col(c), F.lit(WS_CHARS)), f"{WS}+", upto + 1)
    return F.aggregate(runs, F.lit(0), lambda n, run: n + F.when(run == "", 0).otherwise(1))  # white space at the end leaves an empty one


def utf16_length(c: Column | str) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    c = _col(c)
    return F.length(c) + F.length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]+", ""))


def clean_line(c: Column | str) -> Column:
    """Images and formulas as placeholders, white space collapsed, ends trimmed; texts without the marks skip their patterns."""
    c = _col(c)
    out = F.when(c.contains("!["), F.regexp_replace(c, r"!\[.*?\]\(.*?\)", "[IMG]")).otherwise(c)
    formulas = F.regexp_replace(F.regexp_replace(out, r"\$\$[\s\S]*?\$\$", "[EQ]"), r"\$[^$]+\$", "[EQ]")
    return trim_ws(collapse_ws(F.when(c.contains("$"), formulas).otherwise(out)))


def outline_line(kind: Column, clean: Column, block_id: Column, page: Column, text_level: Column) -> Column:
    """One line of a document's outline from a block's cleaned text, or null for a block that has none."""
    place = F.concat(block_id.cast("string"), F.lit("|p"), page.cast("string"))
    tag = F.when(kind == "header", "|H").when(text_level.isNotNull(), F.concat(F.lit("|T"), text_level.cast("string"))).otherwise("")
    short = F.when(F.length(clean) > LINE_LIMIT, F.concat(F.substring(clean, 1, LINE_LIMIT), F.lit("..."))).otherwise(clean)
    return (
        F.when(kind.isin("image", "figure"), F.concat(F.lit("["), place, F.lit("] [Image]")))
        .when(kind == "equation", F.concat(F.lit("["), place, F.lit("] [Equation]")))
        .when(F.coalesce(clean, F.lit("")) != "", F.concat(F.lit("["), place, tag, F.lit("] "), short))
    )


def outline_tokens(kind: Column, text: Column) -> Column:
    """Estimated tokens of a block's outline line."""
    length = F.least(F.length(F.coalesce(text, F.lit(""))), F.lit(LINE_LIMIT))
    return F.when(kind.isin("image", "figure", "equation"), 30).when(length == 0, 0).otherwise(F.ceil((length + 20) / 1.5)).cast("int")


def block_tokens(kind: Column, text: Column) -> Column:
    """Estimated tokens of a block: 1.5 for a CJK character, 0.25 for any other; 50 for an image."""
    text = F.coalesce(text, F.lit(""))
    cjk = F.when(F.octet_length(text) == F.length(text), 0).otherwise(F.length(F.regexp_replace(text, r"[^\x{4e00}-\x{9fa5}]+", "")))
    return F.when(kind == "image", 50).otherwise(F.floor(cjk * 1.5 + (F.length(text) - cjk) * 0.25)).cast("int")


def document_tokens(outline: Column) -> Column:
    return F.ceil(F.length(outline) / 1.5).cast("long")


def question_kind(label: Column | str) -> Column:
    return F.when(_col(label).rlike(r"^(?:例|示例|(?i:Example)|(?i:Ex\.))"), "example").otherwise("exercise")


def label_number(label: Column | str) -> Column:
    """The first run of digits, or -1."""
    return F.coalesce(F.regexp_extract(_col(label), r"(\d+)", 1).try_cast("int"), F.lit(-1))


def refine_title(title: Column | str, aggressive: bool = False) -> Column:
    """White space normalised; aggressive: only the first number (or Chinese numeral), if there is one."""
    t = trim_ws(F.coalesce(_col(title), F.lit("")))
    if not aggressive:
        return collapse_ws(t)
    bare = F.regexp_replace(t, f"{WS}+", "")
    number, numeral = F.regexp_extract(bare, r"(\d+(?:\.\d+)*)", 1), F.regexp_extract(bare, f"({NUMERAL}+)", 1)
    return F.when(number != "", number).when(numeral != "", numeral).otherwise(bare)


def mask_key(key: Column | str) -> Column:
    key = _col(key)
    return F.concat(F.substring(key, 1, 8), F.lit("..."), F.right(key, F.lit(4)))


def retry_name(name: Column | str, count: Column | str) -> Column:
    return F.concat(F.regexp_replace(_col(name), r" \(Retry \d+\)$", ""), F.lit(" (Retry "), _col(count).cast("string"), F.lit(")"))


def duration_ms(ms: Column | str) -> Column:
    """Minutes and seconds; two dashes for none."""
    ms = _col(ms)
    text = F.concat(F.floor(ms / 60000).cast("string"), F.lit("分"), F.floor((ms % 60000) / 1000).cast("string"), F.lit("秒"))
    return F.coalesce(text, F.lit("--"))


def progress_percent(done: Column | str, total: Column | str) -> Column:
    return F.when(_col(total) > 0, _col(done) / _col(total) * 100).otherwise(0.0)


def relative_path(path: Column | str, base: Column | str) -> Column:
    """An absolute path from a folder: up to what both share, then down; relative paths stay."""
    path, base = _col(path), _col(base)
    a, b = F.split(path, "/"), F.split(F.regexp_replace(base, "/+$", ""), "/")
    upto = F.array_max(F.transform(F.sequence(F.lit(0), F.least(F.size(a), F.size(b))), lambda n: F.when(F.slice(a, 1, n) == F.slice(b, 1, n), n).otherwise(0)))
    parts = F.concat(F.array_repeat(F.lit(".."), F.size(b) - upto), F.slice(a, upto + 1, F.size(a)))
    return F.when(path.startswith("/"), F.array_join(parts, "/")).otherwise(path)


def normal_title(title: Column | str) -> Column:
    """For comparison: lower case, spaces collapsed, only word characters, spaces and CJK."""
    return trim_ws(F.regexp_replace(collapse_ws(F.lower(trim_ws(title))), f"{NO_WORD}+", ""))


def split_digit_capital(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), "([0-9])([A-Z])", "$1 $2")


def word_jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared share of two texts' word sets; 0 where either is empty."""
    x, y = (F.array_distinct(F.split(_col(c), f"{WS}+")) for c in (a, b))
    return F.when((_col(a) == "") | (_col(b) == ""), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def storage_key(key: Column | str) -> Column:
    return F.regexp_replace(_col(key), "^/+", "")


def storage_url(base: Column | str, key: Column | str) -> Column:
    return F.concat(F.regexp_replace(_col(base), "/+$", ""), F.lit("/"), storage_key(key))


def looked_up(c: Column | str, table: dict[str, str], default: Column | str | None = None) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(pairs, _col(c)), _col(c) if default is None else F.lit(default))


def language_name(c: Column | str) -> Column:
    return looked_up(c, LANGUAGES)


def sound_ending(c: Column | str) -> Column:
    return looked_up(c, SOUND_ENDINGS, "audio")
