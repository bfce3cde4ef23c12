"""The 25 exact checks, each a function from a corpus to findings.

A finding row: doc_id, code, pos, line, col, label, value, message, snippet. ``value`` is the number that fired the rule, unrounded, where there is one.
Checks of a document's rates are aggregates by doc_id; checks of order are windows over (doc_id, pos); none needs Python.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkloom.functions import text as T
from inkloom.operators.corpus import HEADING_KINDS, Corpus, location, peers, slides
from inkloom.rules import lexicons as L

FINDING = ("doc_id", "code", "pos", "line", "col", "label", "value", "message", "snippet")
CHECKS: dict[str, Callable[..., DataFrame]] = {}


def rule(code: str):
    def keep(f):
        CHECKS[code] = f
        f.code = code
        return f

    return keep


def finding(df: DataFrame, code: str, message: Column | str, value: Column | None = None, snippet: Column | None = None) -> DataFrame:
    """Rows of df, which hold a block's coordinates, as findings."""
    return df.select(
        "doc_id",
        F.lit(code).alias("code"),
        "pos",
        "line",
        "col",
        "label",
        (F.lit(None).cast("double") if value is None else value.cast("double")).alias("value"),
        (F.lit(message) if isinstance(message, str) else message).alias("message"),
        (T.snippet(F.col("text")) if snippet is None else snippet).alias("snippet"),
    )


def _doc() -> Window:
    return Window.partitionBy("doc_id")


def _with_matches(blocks: DataFrame, pattern: str, group: int = 0) -> DataFrame:
    """One row per match in the raw text, with the line and column where it begins."""
    m = blocks.where(F.col("raw").rlike(pattern)).withColumn("m", F.explode(T.matches(F.col("raw"), pattern, group))).select("*", F.col("m.hit").alias("hit"), F.col("m.at").alias("at")).drop("m")
    line, col = T.place(F.col("raw"), F.col("at"), F.col("line"))
    return m.withColumn("line_", line).withColumn("col", F.when((F.col("at") == 0) & (F.col("raw") == F.col("text")), F.lit(1)).otherwise(col)).withColumn("line", F.col("line_")).drop("line_")


@rule("RIF001")
def decorative_unicode(c: Corpus, **_) -> DataFrame:
    marks = "[‘’“”]"
    b = c.blocks.where(F.col("prose") | F.col("kind").isin(*HEADING_KINDS))
    m = _with_matches(b, L.DECORATIVE)
    # marks that a layout set: the pair around a whole block, or a block of nothing but marks
    stripped = T.strip(F.col("raw"))
    only_marks = (stripped != "") & (F.regexp_replace(F.col("raw"), "[“”‘’ \n]", "") == "")
    first = F.length("raw") - F.length(F.regexp_replace("raw", rf"^{T.SPACE}+", ""))
    last = F.length(F.regexp_replace("raw", rf"{T.SPACE}+$", "")) - 1
    pulled = F.col("raw").rlike(rf"(?s)^{T.SPACE}*[“‘][^“”]*[”’]{T.SPACE}*$") & F.col("at").isin(first, last)
    is_mark = F.col("hit").rlike(marks)
    return finding(m.where(~(is_mark & (only_marks | pulled))), "RIF001", F.concat(F.lit("decorative unicode ("), F.col("hit"), F.lit(")")), snippet=T.snippet(F.col("raw"), F.col("at")))


@rule("RIF002")
def title_case(c: Corpus, **_) -> DataFrame:
    ws = T.words(F.col("text"))
    major = F.filter("ws", lambda w: ~F.lower(w).isin(*L.MINOR_WORDS) & ~((F.upper(w) == w) & w.rlike("[A-Za-z]")))
    h = c.blocks.where(F.col("kind").isin(*HEADING_KINDS)).withColumn("ws", ws).withColumn("major", major)
    return finding(h.where((F.size("ws") >= 4) & (F.size("major") >= 3) & F.forall("major", lambda w: w.rlike("^[A-Z]"))), "RIF002", "heading is Title Case; use sentence case")


@rule("RIF003")
def bold_bullets(c: Corpus, **_) -> DataFrame:
    items = c.blocks.where("kind = 'list_item'").withColumn("n", F.count("*").over(_doc())).withColumn("b", F.sum(F.col("bold").cast("int")).over(_doc()))
    hit = items.where((F.col("n") >= 3) & (F.col("b") / F.col("n") >= 0.6) & F.col("bold"))
    return finding(hit, "RIF003", F.format_string("bold lead-in on %d/%d list items", "b", "n"), F.col("b") / F.col("n"))


@rule("RIF004")
def revision_badge(c: Corpus, **_) -> DataFrame:
    m = _with_matches(c.blocks, L.REVISION_NOTE)
    return finding(m, "RIF004", F.concat(F.lit("note about an edit ('"), T.strip(F.col("hit")), F.lit("'); state the content instead")), snippet=T.snippet(F.col("raw"), F.col("at")))


def titled(c: Corpus) -> DataFrame:
    """Titled sections in order, headings and slides alike, with the coordinates of their titles."""
    fmt = c.docs.select("doc_id", "format")
    h = c.sections.join(fmt.where("format is null or format <> 'pptx'"), "doc_id", "left_semi").where("title is not null").select("doc_id", "sec_no", "level", "title", "label", "line", "col", F.col("title_pos").alias("pos"), "body", "prose_words", "bullets", "divider", "children", "parent_pos", "raw", "own_blocks")
    return h


@rule("RIF005")
def out_of_order_parts(c: Corpus, **_) -> DataFrame:
    body = F.array_join(F.slice(F.split(T.strip(F.col("body")), rf"{T.SPACE}+"), 1, 8), " ")
    where = F.concat(F.col("title"), F.lit(" "), body)
    s = titled(c).withColumn("where", where).where(F.col("where").rlike(L.PART))
    s = s.withColumn("part", F.regexp_extract("where", L.PART, 0)).withColumn("what", F.regexp_replace(F.lower(F.regexp_extract("where", L.PART, 1)), "s+$", "")).withColumn("n", F.regexp_extract("where", L.PART, 2).cast("int"))
    w = Window.partitionBy("doc_id", "what").orderBy("sec_no").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("seen", F.max(F.struct("n", (-F.col("sec_no")).alias("k"), "label")).over(w))
    hit = s.where(F.col("n") < F.col("seen.n")).withColumn("text", F.col("title"))
    return finding(hit, "RIF005", F.concat(F.col("part"), F.lit(" comes after "), F.col("what"), F.lit(" "), F.col("seen.n"), F.lit(" ("), F.col("seen.label"), F.lit(")")), F.col("n"))


@rule("RIF006")
def heading_hierarchy(c: Corpus, **_) -> DataFrame:
    h = c.blocks.where("kind = 'heading'").join(c.docs.where("format is null or format <> 'pptx'"), "doc_id", "left_semi")
    w = _doc().orderBy("pos")
    h = h.withColumn("before", F.lag("level").over(w))
    ones = h.where("level = 1").withColumn("k", F.row_number().over(w))
    skips = finding(h.where(F.col("level") > F.col("before") + 1), "RIF006", F.format_string("h%d follows h%d; do not skip levels", "level", "before"), F.col("level"))
    again = finding(ones.where("k > 1"), "RIF006", "second h1; a page has one top-level heading", F.lit(1))
    t = titled(c)
    only = t.where("children = 1 and level > 1").select("doc_id", F.col("pos").alias("parent_pos"), F.col("title").alias("parent"))
    lone = t.join(only, ["doc_id", "parent_pos"]).withColumn("text", F.col("title"))
    return skips.unionByName(again).unionByName(finding(lone, "RIF006", F.concat(F.lit("only subsection under '"), T.snippet(F.col("parent")), F.lit("'; add a sibling or fold it in")), F.lit(0)))


@rule("RIF007")
def heading_form(c: Corpus, **_) -> DataFrame:
    h = c.blocks.where("kind = 'heading'").join(c.docs.where("format is null or format <> 'pptx'"), "doc_id", "left_semi")
    form = F.when(F.col("text").rlike(L.NUMBERED), "numbered heading").when(F.col("text").rlike(L.EMOJI), "emoji at the start of a heading").when(F.contains(F.substring_index("raw", "\n", 1), F.lit("](")), "link inside a heading")
    return finding(h.withColumn("form", form).where("form is not null"), "RIF007", F.col("form"))


@rule("RIF008")
def changelog_shape(c: Corpus, **_) -> DataFrame:
    t = titled(c).withColumn("heading", T.strip(F.regexp_replace(T.strip(F.substring_index("raw", "\n", 1)), "^#+", "")))
    t = t.withColumn("version", F.when(F.col("heading").rlike(L.VERSION), F.regexp_extract("heading", L.VERSION, 1))).withColumn("dated", F.when(F.col("version").isNotNull(), F.regexp_extract("heading", L.VERSION, 2)))
    t = t.withColumn("release", F.col("version").isNotNull() | F.contains(F.lower("heading"), F.lit("unreleased"))).withColumn("versions", F.count("version").over(_doc())).where("versions >= 2").withColumn("text", F.col("title"))
    w = _doc().orderBy("sec_no")
    r = t.where("release").withColumn("k", F.row_number().over(w))
    v = r.where("version is not null").withColumn("key", T.version_key(F.col("version"))).withColumn("before", F.lag("key").over(w))
    groups = t.join(r.select("doc_id", F.col("pos").alias("parent_pos")), ["doc_id", "parent_pos"])
    name = T.strip(F.lower("title"))
    clean = F.regexp_replace("dated", "^[() ]+|[() ]+$", "")
    return reduce(
        DataFrame.unionByName,
        [
            finding(r.where("version is null and k > 1"), "RIF008", "Unreleased belongs at the top", F.lit(1)),
            finding(v.where(F.col("key") > F.col("before")), "RIF008", "versions should run newest first", F.lit(2)),
            finding(v.where((F.col("dated") != "") & ~clean.rlike(r"^\d{4}-\d{2}-\d{2}$")), "RIF008", F.concat(F.lit("date '"), T.strip(F.col("dated")), F.lit("' is not ISO 8601 (YYYY-MM-DD)")), F.lit(3)),
            finding(groups.where(~name.isin(*L.CHANGE_GROUPS)), "RIF008", "group is not one of Added, Changed, Deprecated, Removed, Fixed, Security", F.lit(4)),
            finding(groups.where(name.isin(*L.CHANGE_GROUPS) & (F.col("own_blocks") == 0)), "RIF008", "empty group; omit it", F.lit(5)),
        ],
    )


@rule("RIF009")
def single_item_list(c: Corpus, **_) -> DataFrame:
    w = _doc().orderBy("pos")
    b = c.blocks.withColumn("before", F.lag("kind").over(w)).withColumn("after", F.lead("kind").over(w))
    return finding(b.where("kind = 'list_item' and coalesce(before, '') <> 'list_item' and coalesce(after, '') <> 'list_item'"), "RIF009", "list has a single item")


@rule("RIF010")
def predicate_hyphen(c: Corpus, **_) -> DataFrame:
    m = _with_matches(c.prose, L.PREDICATE_HYPHEN, 1).where(~F.col("hit").rlike(L.KEEPS_HYPHEN)).withColumn("n", F.count("*").over(_doc()))
    return finding(m.where("n >= 2"), "RIF010", F.concat(F.lit("'"), F.col("hit"), F.lit("' after a linking verb; drop the hyphen ('"), F.translate("hit", "-", " "), F.lit("')")), F.col("n"), T.snippet(F.col("raw"), F.col("at")))


@rule("CLR001")
def long_sentence(c: Corpus, max_sentence_words: int = 45, **_) -> DataFrame:
    s = c.sentences.where(~F.col("dump") & (F.col("n") > max_sentence_words)).withColumn("text", F.col("sentence"))
    return finding(s, "CLR001", F.format_string(f"sentence is %d words (limit {max_sentence_words})", "n"), F.col("n"))


@rule("CLR002")
def hard_to_read(c: Corpus, max_reading_grade: float = 14.0, **_) -> DataFrame:
    b = c.prose.where((F.col("words") >= 40) & (T.occurrences(F.col("text"), "·") < 2))
    g = T.grade(F.size(T.sentences(F.col("text"))), F.col("words"), T.syllable_total(T.words(F.col("text"))))
    return finding(b.withColumn("g", g).where(F.col("g") > max_reading_grade), "CLR002", F.format_string(f"reading grade %.0f (limit {max_reading_grade:.0f})", F.bround("g", 0)), F.col("g"))


@rule("CLR003")
def duplicate_paragraph(c: Corpus, **_) -> DataFrame:
    key = F.array_join(F.transform(T.words(F.col("text")), F.lower), " ")
    w = Window.partitionBy("doc_id", "key").orderBy("pos")
    b = c.prose.where("words >= 8").withColumn("key", key).withColumn("k", F.row_number().over(w)).withColumn("where", F.first(location()).over(w)).withColumn("first_pos", F.first("pos").over(w))
    return finding(b.where("k > 1"), "CLR003", F.concat(F.lit("duplicates the paragraph at "), F.col("where")), F.col("first_pos"))


@rule("CLR004")
def repeated_contrast_frame(c: Corpus, **_) -> DataFrame:
    b = c.prose.where(~F.col("dump")).withColumn("total", F.sum("words").over(_doc())).withColumn("hits", F.size(F.regexp_extract_all("text", F.lit(L.CONTRAST), F.lit(0))))
    b = b.withColumn("n", F.sum("hits").over(_doc())).where((F.col("n") >= 3) & (F.col("n") * 1000 / F.col("total") > 2.5))
    m = b.select("*", F.posexplode(T.matches(F.col("text"), L.CONTRAST)).alias("k", "m")).withColumn("i", F.row_number().over(_doc().orderBy("pos", "k")))
    at, size = F.col("m.at"), F.length("m.hit")
    cut = F.substring("text", F.greatest(at - 30, F.lit(0)) + 1, at + size + 30 - F.greatest(at - 30, F.lit(0)))
    return finding(m, "CLR004", F.format_string("contrast frame #%d of %d", "i", "n"), F.col("n") * 1000 / F.col("total"), T.snippet(cut))


def _first(blocks: DataFrame) -> Column:
    return F.min_by(F.struct("pos", "line", "col", "label", "text"), "pos")


@rule("CLR005")
def uniform_sentence_length(c: Corpus, **_) -> DataFrame:
    first = c.prose.groupBy("doc_id").agg(_first(c.prose).alias("b"))
    s = c.sentences.where("not dump and n > 0").groupBy("doc_id").agg(F.count("*").alias("k"), (F.stddev_pop("n") / F.avg("n")).alias("cv")).where("k >= 25 and cv < 0.45")
    return finding(s.join(first, "doc_id").select("doc_id", "k", "cv", "b.*"), "CLR005", F.format_string("sentence-length variation %.2f over %d sentences", "cv", "k"), F.col("cv"))


@rule("CLR006")
def uniform_paragraph_length(c: Corpus, **_) -> DataFrame:
    b = c.prose.where("words >= 15 and not dump")
    p = b.groupBy("doc_id").agg(F.count("*").alias("k"), (F.stddev_pop("words") / F.avg("words")).alias("cv"), _first(b).alias("b")).where("k >= 8 and cv < 0.40")
    return finding(p.select("doc_id", "k", "cv", "b.*"), "CLR006", F.format_string("paragraph-length variation %.2f over %d paragraphs", "cv", "k"), F.col("cv"))


@rule("CLR007")
def conclusion_closers(c: Corpus, **_) -> DataFrame:
    p = c.prose.where("words >= 40 and not dump").withColumn("s", T.sentences(F.col("text"))).where(F.size("s") >= 3).withColumn("last", F.element_at("s", -1))
    p = p.withColumn("hit", F.col("last").rlike(L.CLOSER)).withColumn("n", F.count("*").over(_doc())).withColumn("hits", F.sum(F.col("hit").cast("int")).over(_doc()))
    return finding(p.where("hit and n >= 6 and hits >= 3 and hits / n >= 0.15"), "CLR007", F.format_string("closing sentence is a takeaway (%d of %d paragraphs)", "hits", "n"), F.col("hits") / F.col("n"), T.snippet(F.col("last")))


@rule("CLR008")
def uniform_section_size(c: Corpus, **_) -> DataFrame:
    p = peers(titled(c).withColumn("title_pos", F.col("pos")))
    s = p.groupBy("doc_id").agg(F.count("*").alias("k"), F.sum("prose_words").alias("total"), F.min("prose_words").alias("lo"), F.max("prose_words").alias("hi"), F.try_divide(F.stddev_pop("prose_words"), F.avg("prose_words")).alias("cv"), F.min_by(F.struct("pos", "line", "col", "label", F.col("title").alias("text")), "pos").alias("b"))
    return finding(s.where("total >= 500 and lo > 0 and cv < 0.30").select("doc_id", "k", "lo", "hi", "cv", "b.*"), "CLR008", F.format_string("%d sections of %d-%d words (variation %.2f)", "k", "lo", "hi", "cv"), F.col("cv"))


@rule("CLR009")
def paragraph_too_long(c: Corpus, **_) -> DataFrame:
    b = c.blocks.where("kind = 'paragraph'").withColumn("n", F.size(T.sentences(F.col("text"))))
    return finding(b.where("n > 8"), "CLR009", F.format_string("paragraph is %d sentences (limit 8)", "n"), F.col("n"))


@rule("CLR010")
def bold_density(c: Corpus, **_) -> DataFrame:
    b = c.prose.join(c.docs.where("format = 'md'"), "doc_id", "left_semi").withColumn("bolded", F.regexp_extract_all(F.translate("raw", "\n", " "), F.lit(r"(\*\*|__)(.+?)\1"), F.lit(2)))
    b = b.withColumn("bold_words", F.aggregate("bolded", F.lit(0), lambda a, x: a + T.word_count(x)))
    s = b.groupBy("doc_id").agg(F.sum("bold_words").alias("bw"), F.sum("words").alias("total"), _first(b).alias("b")).where("total >= 500 and bw / total > 0.30")
    return finding(s.select("doc_id", "bw", "total", "b.*"), "CLR010", F.format_string("%d of %d words of the prose are bold (limit 30%%)", "bw", "total"), F.col("bw") / F.col("total"))


@rule("CLR011")
def wall_of_text(c: Corpus, **_) -> DataFrame:
    s = c.blocks.groupBy("doc_id").agg(F.sum("words").alias("total"), F.max(F.col("kind").isin("heading", "list_item")).alias("scannable"), _first(c.blocks).alias("b")).where("total >= 400 and not scannable")
    return finding(s.select("doc_id", "total", "b.*"), "CLR011", F.format_string("%d words with no heading or list to scan", "total"), F.col("total"))


@rule("CLR012")
def slide_load(c: Corpus, **_) -> DataFrame:
    decks = slides(c.blocks.join(c.docs.where("format = 'pptx'"), "doc_id", "left_semi"))
    heads = titled(c)
    top = heads.where("parent_pos is null").select("doc_id", "pos", "line", "col", "label", F.col("title").alias("text"), "prose_words", "bullets")
    s = decks.where("title is not null").select("doc_id", F.col("title_pos").alias("pos"), "line", F.lit(1).alias("col"), "label", F.col("title").alias("text"), "prose_words", "bullets").unionByName(top).withColumn("tw", T.word_count("text"))
    load = F.when(F.col("prose_words") > 40, F.format_string("%d words on one slide (limit 40)", "prose_words")).when(F.col("bullets") > 5, F.format_string("%d bullets on one slide (limit 5)", "bullets"))
    heavy = finding(s.withColumn("m", load).where("m is not null"), "CLR012", F.col("m"), F.when(F.col("prose_words") > 40, F.col("prose_words")).otherwise(F.col("bullets")))
    return heavy.unionByName(finding(s.where("tw > 0 and not tw between 3 and 20"), "CLR012", F.format_string("slide title is %d words (aim for a one-line sentence)", "tw"), F.col("tw")))


def _running(c: Corpus) -> DataFrame:
    return c.blocks.where("kind = 'paragraph' and not dump")


@rule("CLR013")
def flat_certainty_register(c: Corpus, **_) -> DataFrame:
    b = _running(c)
    tokens = b.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(L.REGISTER_WORD), F.lit(0))).alias("w"))
    hit = F.col("w").isin(*L.REGISTER)
    per_word = tokens.groupBy("doc_id", F.when(hit, F.col("w")).alias("w")).agg(F.count("*").alias("n"))
    s = per_word.groupBy("doc_id").agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("w").isNotNull(), F.col("n"))), F.lit(0)).alias("hits"), F.slice(F.array_sort(F.collect_list(F.when(F.col("w").isNotNull(), F.struct((-F.col("n")).alias("k"), "w")))), 1, 5).alias("top"))
    s = s.where("total >= 150 and 100 * hits / total > 1.0").join(b.groupBy("doc_id").agg(_first(b).alias("b")), "doc_id").select("doc_id", "total", "hits", "top", "b.*")
    top = F.array_join(F.transform("top", lambda x: F.concat(x["w"], F.lit(" x"), -x["k"])), ", ")
    return finding(s, "CLR013", F.concat(F.format_string("%.2f flat-certainty words per 100 (%d of %d; ", 100 * F.col("hits") / F.col("total"), "hits", "total"), top, F.lit(")")), 100 * F.col("hits") / F.col("total"))


@rule("CLR014")
def echoed_skeleton(c: Corpus, **_) -> DataFrame:
    """Longest common runs of neighbouring sentences: positions of equal words lie on diagonals, and a run is an unbroken stretch of one."""
    s = c.sentences.where("kind = 'paragraph' and not dump").withColumn("toks", F.regexp_extract_all(F.lower("sentence"), F.lit(L.ECHO_WORD), F.lit(0)))
    w = Window.partitionBy("doc_id", "pos").orderBy("sent_no")
    pairs = s.withColumn("a", F.lag("toks").over(w)).where(F.col("a").isNotNull()).withColumn("short", F.least(F.size("a"), F.size("toks"))).where("short >= 6")
    # only words that both have can meet, so the pairs are of few words each
    left = pairs.select("doc_id", "pos", "sent_no", "short", "toks", F.posexplode("a").alias("i", "x"))
    met = left.select("doc_id", "pos", "sent_no", "short", "i", "x", F.posexplode("toks").alias("j", "y")).where("x = y").withColumn("d", F.col("i") - F.col("j"))
    g = met.withColumn("g", F.col("i") - F.row_number().over(Window.partitionBy("doc_id", "pos", "sent_no", "d").orderBy("i")))
    runs = g.groupBy("doc_id", "pos", "sent_no", "short", "d", "g").agg(F.count("*").alias("run"), F.min("i").alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda t: t["x"]), " ").alias("words"))
    # the first longest: least end in the earlier sentence, then in the later
    best = runs.groupBy("doc_id", "pos", "sent_no", "short").agg(F.min_by(F.struct("run", "words"), F.struct(-F.col("run"), F.col("at") + F.col("run"), F.col("at") - F.col("d"))).alias("r")).select("doc_id", "pos", "sent_no", "short", "r.*")
    hit = best.where((F.col("run") >= 5) & (F.col("run") * 2 >= F.col("short"))).groupBy("doc_id", "pos").agg(F.min_by(F.struct("sent_no", "run", "short", "words"), "sent_no").alias("h")).select("doc_id", "pos", "h.*")
    j = hit.join(s.select("doc_id", "pos", "sent_no", "line", "col", "label", F.col("sentence").alias("text")), ["doc_id", "pos", "sent_no"])
    return finding(j, "CLR014", F.concat(F.lit("two sentences share '"), F.col("words"), F.lit("'; say the second thing differently or merge them")), F.col("run") / F.col("short"))


def first_run(units: Column) -> Column:
    """0-based index of the unit that completes the first run of three openings on the same two words, else null. The first unit of a run may merely contain them."""
    start = F.struct(F.lit("").alias("unit"), F.lit("").alias("key"), F.lit(1).alias("run"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("hit"))

    def step(acc: Column, unit: Column) -> Column:
        key = T.opening_key(unit)
        run = F.when((acc["i"] > 0) & (key != "") & (key == acc["key"]), acc["run"] + 1).when((acc["i"] > 0) & (key != "") & F.contains(F.concat(F.lit(" "), F.lower(acc["unit"]), F.lit(" ")), F.concat(F.lit(" "), key, F.lit(" "))), 2).otherwise(1)
        return F.struct(unit.alias("unit"), key.alias("key"), run.alias("run"), (acc["i"] + 1).alias("i"), F.coalesce(acc["hit"], F.when(run == 3, acc["i"])).alias("hit"))

    return F.aggregate(units, start, step)["hit"]


@rule("CLR015")
def anaphora_run(c: Corpus, **_) -> DataFrame:
    b = _running(c).withColumn("s", T.sentences(F.col("text"))).where(F.size("s") > 0)
    whole = b.withColumn("units", F.array(F.struct(F.lit(0).alias("k"), F.col("s").alias("u"))))
    clauses = F.transform("s", lambda x, i: F.struct((i + 1).alias("k"), F.filter(F.transform(F.split(x, r"[,;]\s+"), T.strip), lambda y: y != "").alias("u")))
    u = whole.withColumn("units", F.concat("units", clauses)).select("doc_id", "pos", "line", "col", "label", F.explode("units").alias("x")).select("doc_id", "pos", "line", "col", "label", "x.k", "x.u").where(F.size("u") >= 3)
    u = u.withColumn("i", first_run(F.col("u"))).where("i is not null")
    f = u.groupBy("doc_id", "pos", "line", "col", "label").agg(F.min_by(F.struct("k", "i", "u"), "k").alias("h")).select("doc_id", "pos", "line", "col", "label", "h.*")
    what = F.when(F.col("k") == 0, "sentences").otherwise("clauses")
    return finding(f.withColumn("text", F.get("u", F.col("i") - 2)), "CLR015", F.concat(F.lit("three "), what, F.lit(" in a row open with '"), T.opening_key(F.get("u", F.col("i"))), F.lit("'")), F.col("k"))
