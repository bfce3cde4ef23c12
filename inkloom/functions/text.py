"""Scalar text functions as column expressions: words, sentences, syllables, grades, snippets, matches with their places.

Everything here stays inside the JVM. ``WORD`` is ASCII by definition: a letter outside ASCII splits a word.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens after whose point a sentence goes on.
ABBREVIATIONS = (
    "mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "vs", "etc", "e.g", "i.e", "u.s", "u.k",
    "inc", "ltd", "co", "corp", "no", "fig", "approx", "dept", "est", "vol", "al",
)

WORD = r"[A-Za-z0-9][A-Za-z0-9'’-]*"
SPACE = r"[\s\x0b\x85\p{Z}]"  # white space of all scripts, the same in Java and RE2
_CLOSE = r"""['")\]]*"""
_ABBREVIATED = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
_CUT = "\x01"

#: A sentence ends at a run of marks with white space behind it, unless an abbreviation or a single letter stands before it,
#: or the mark is one point and a small letter follows. Each boundary can be judged alone, so one pattern finds all. The look at the
#: mark comes first, as what stands before it need be looked at nowhere else.
BOUNDARY = (
    rf"(?=[.!?])(?<![.!?])(?<!(?<![\p{{L}}\p{{N}}_.])(?:(?i:{_ABBREVIATED})|\p{{L}}))"
    rf"(?:([.](?![.!?]){_CLOSE}){SPACE}++(?!\p{{Ll}})|((?![.](?![.!?]))[.!?]++{_CLOSE}){SPACE}++)"
)

# Inline markup in the order in which it is taken off, and what stays of it.
INLINE_MARKUP = (
    (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"\[([^\]]+)\]\([^)]*\)", "$1"),
    (r"\[([^\]]+)\]\[[^\]]*\]", "$1"),
    (r"`([^`]*)`", "$1"),
    (r"(\*\*|__)(.+?)\1", "$2"),
    (r"(?<![\p{L}\p{N}_])(\*|_)(?!\s)(.+?)(?<!\s)\1(?![\p{L}\p{N}_])", "$2"),
    (r"<[^>]+>", ""),
)


def strip(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD))


def sentences(c: Column) -> Column:
    """The sentences of a text, trimmed, as an array."""
    parts = F.split(F.regexp_replace(c, BOUNDARY, "$1$2" + _CUT), _CUT)
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def strip_inline(c: Column) -> Column:
    """Text without inline Markdown and tags, runs of blanks squeezed."""
    for pattern, keep in INLINE_MARKUP:
        c = F.regexp_replace(c, pattern, keep)
    return strip(F.regexp_replace(c, r"[ \t]{2,}", " "))


def estimate_tokens(c: Column) -> Column:
    return (F.floor(F.length(c) / 4) + 1).cast("bigint")


def syllables(word: Column) -> Column:
    """Vowel groups of a word after its silent ending and a leading y are dropped; at least 1, none for an empty word."""
    w = F.regexp_replace(F.lower(word), "^['’]+|['’]+$", "")
    core = F.regexp_replace(F.regexp_replace(w, "(?:[^laeiouy]es|ed|[^laeiouy]e)$", ""), "^y", "")
    return F.when(w == "", 0).otherwise(F.greatest(F.lit(1), F.regexp_count(core, F.lit("[aeiouy]+"))))


def syllable_total(ws: Column) -> Column:
    return F.aggregate(ws, F.lit(0), lambda acc, w: acc + syllables(w))


def grade(n_sentences: Column, n_words: Column, n_syllables: Column) -> Column:
    """Flesch-Kincaid grade; null below three sentences or thirty words."""
    value = F.lit(0.39) * (n_words / n_sentences) + F.lit(11.8) * (n_syllables / n_words) - F.lit(15.59)
    return F.when((n_sentences >= 3) & (n_words >= 30), value)


def occurrences(c: Column, what: str) -> Column:
    """How often a literal occurs."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))) / len(what)).cast("int")


def is_link_dump(c: Column) -> Column:
    return (occurrences(c, "·") >= 2) | (occurrences(c, "](http") >= 2)


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, rf"{SPACE}+", " ")


def first_words(c: Column, n: int) -> Column:
    """The first n words by white space, one blank between them; looks at no more of the text."""
    word = SPACE.replace("[", "[^", 1)
    return squeeze(F.regexp_extract(c, rf"^{SPACE}*+({word}++(?:{SPACE}++{word}++){{0,{n - 1}}})", 1))


def snippet(c: Column, offset: Column | None = None, width: int = 90) -> Column:
    """Up to ``width`` characters from thirty before the offset (counted from 0), squeezed, with marks where something is left out."""
    at = F.lit(0) if offset is None else offset
    s = strip(F.substring(c, F.greatest(at - 30, F.lit(0)) + 1, F.length(c)))
    s = squeeze(F.when(at > 30, F.concat(F.lit("…"), s)).otherwise(s))
    return F.when(F.length(s) <= width, s).otherwise(F.concat(F.regexp_replace(F.substring(s, 1, width - 1), rf"{SPACE}+$", ""), F.lit("…")))


def matches(c: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern as an array of (hit, at): the text of the group, and where the whole match begins, counted from 0.

    Places come from adding up the pieces between the matches, so the pattern must not match the empty text.
    """
    whole = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    hit = whole if group == 0 else F.regexp_extract_all(c, F.lit(pattern), F.lit(group))
    gaps = F.split(c, pattern, -1)
    step = F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("g"), whole.alias("m"), hit.alias("h")), lambda x: x)
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<hit:string,at:int>>").alias("out"))
    folded = F.aggregate(
        step,
        start,
        lambda acc, x: F.struct(
            (acc["end"] + F.length(x["g"]) + F.length(x["m"])).alias("end"),
            F.concat(acc["out"], F.array(F.struct(x["h"].alias("hit"), (acc["end"] + F.length(x["g"])).alias("at")))).alias("out"),
        ),
    )
    return folded["out"]


def place(c: Column, at: Column, line: Column) -> tuple[Column, Column]:
    """(line, column) of an offset in a text that begins in the given line; columns count from 1."""
    before = F.substring(c, 1, at)
    return line + occurrences(before, "\n"), F.length(F.substring_index(before, "\n", -1)) + 1


def escape(literal: str) -> str:
    return "".join("\\" + ch if not (ch.isalnum() or ch.isspace() or ch == "_") and ord(ch) < 128 else ch for ch in literal)


def phrase_pattern(phrases: Iterable[str], case_sensitive: bool = False) -> str:
    """A Java pattern for whole phrases: longest first, white space within matches any, either apostrophe matches both, hyphens and word characters bound it."""
    alternatives = [rf"{SPACE}+".join(escape(tok).replace("\\'", "['’]").replace("'", "['’]") if "['’]" not in tok else tok for tok in p.split()) for p in sorted(set(phrases), key=lambda p: (-len(p), p))]
    return ("" if case_sensitive else "(?iu)") + r"(?<![\p{L}\p{N}_-])(?:" + "|".join(alternatives) + r")(?![\p{L}\p{N}_-])"


def version_key(c: Column) -> Column:
    """Dotted numbers as an array, which compares as versions do."""
    return F.transform(F.split(c, r"\."), lambda p: p.cast("int"))


def opening_key(c: Column) -> Column:
    """First two words in small letters, without outer punctuation."""
    first = F.array_join(F.slice(F.split(strip(F.lower(c)), rf"{SPACE}+"), 1, 2), " ")
    return F.regexp_replace(first, "^[,;:.\"'()“”‘’]+|[,;:.\"'()“”‘’]+$", "")


def cv(total: Column, squares: Column, n: Column) -> Column:
    """Coefficient of variation of a population from its sums."""
    mean = total / n
    return F.sqrt(F.greatest(squares / n - mean * mean, F.lit(0.0))) / mean
