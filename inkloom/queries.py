"""Queries over the test tables: every operator of the engine, applied to whole tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.functions import text as T
from inkloom.operators import scoring, units
from inkloom.operators.compare import compare, features
from inkloom.operators.corpus import Corpus, peers, slides
from inkloom.operators.custom import custom_findings, custom_rule
from inkloom.operators.gate import applicable, resolve_types
from inkloom.plans import report
from inkloom.plans.lint import lint, static_findings
from inkloom.rules.catalog import TYPES, active, catalog, rules_df
from inkloom.rules.static import CHECKS, titled
from inkloom.settings import Settings
from inkloom.sources.documents import blocks_of, corpus_of
from inkloom.streaming.stream import drain, lint_stream, long_sentences, windowed_counts

QUERIES = {}
#: How the rules without hits on the tables are exercised as well: a marker sentence in every n-th paragraph. The SQL does the same.
DECORATION = (
    (7, "We opened one valve instead of two. It is not large, but loud. She chose this rather than that."),
    (11, "Portfolio overview (+2 companies added) as requested."),
    (13, "The team is cross-functional and the report is data-driven."),
    (17, "The guard plainly refuses; nothing else reaches it, and the fix survived a re-derived check."),
    (19, "It was a message. It was a permission slip. It was an out."),
    (23, "A shopping cart is an object in the system. A chat room is an object in the system."),
    (29, "Input → output, as “smart quotes” show."),
)


def query(f):
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def corpus(spark: SparkSession, d: str) -> Corpus:
    return Corpus.of_tables(read(spark, d, "files"), read(spark, d, "blocks"))


def decorated(spark: SparkSession, d: str) -> Corpus:
    """The corpus with marker sentences behind paragraphs by (file_id + pos)."""
    b = read(spark, d, "blocks")
    extra = reduce(lambda acc, x: F.when((F.col("file_id") + F.col("pos")) % x[0] == 0, x[1]).otherwise(acc), reversed(DECORATION), F.lit(""))
    return Corpus.of_tables(read(spark, d, "files"), b.withColumn("text", F.when((F.col("kind") == "paragraph") & (extra != ""), F.concat("text", F.lit(" "), extra)).otherwise(F.col("text"))))


def _retexted(spark: SparkSession, d: str, text: Column) -> Corpus:
    return Corpus.of_tables(read(spark, d, "files"), read(spark, d, "blocks").withColumn("text", F.coalesce(text, F.col("text"))))


def closing(spark: SparkSession, d: str) -> Corpus:
    """The corpus with a takeaway behind every third paragraph."""
    return _retexted(spark, d, F.when((F.col("kind") == "paragraph") & ((F.col("file_id") + F.col("pos")) % 3 == 0), F.concat("text", F.lit(" So it holds for all of them."))))


def numbered(spark: SparkSession, d: str) -> Corpus:
    """The corpus with numbered headings."""
    return _retexted(spark, d, F.when(F.col("kind") == "heading", F.concat(F.lit("Step "), ((F.col("pos") * 7 + F.col("file_id")) % 9 + 1).cast("string"), F.lit(": "), "text")))


def versioned(spark: SparkSession, d: str) -> Corpus:
    """The corpus with version headings and groups of changes."""
    k, i = F.col("pos") % 3, F.col("file_id")
    version = F.concat(F.lit("1."), (i % 5).cast("string"), F.lit("."), (F.col("pos") % 7).cast("string"), F.lit(" - 2026-01-0"), (F.col("pos") % 9 + 1).cast("string"))
    return _retexted(spark, d, F.when(F.col("kind") == "heading", F.when(k == 0, version).when(k == 1, "Added").otherwise("Other")))


def bolded(spark: SparkSession, d: str) -> Corpus:
    """The corpus with every other block bold."""
    return _retexted(spark, d, F.when(F.col("pos") % 2 == 0, F.concat(F.lit("**"), "text", F.lit("**"))))


def even(spark: SparkSession, d: str) -> Corpus:
    """The corpus with sections of much the same size: all paragraphs are nearly as long."""
    return _retexted(spark, d, F.when(F.col("kind") == "paragraph", F.concat(F.repeat(F.lit("even words "), 100 + F.col("pos") % 5), F.lit("end."))))


def capitalised(spark: SparkSession, d: str) -> Corpus:
    """The corpus with every fifth heading in title case."""
    return _retexted(spark, d, F.when((F.col("kind") == "heading") & ((F.col("file_id") + F.col("pos")) % 5 == 0), "Understanding The Impact Of Modern Technology"))


SOURCES = {"RIF002": capitalised, "CLR007": closing, "CLR008": even, "CLR010": bolded, "RIF005": numbered, "RIF008": versioned, **dict.fromkeys(("CLR004", "CLR013", "CLR014", "CLR015", "RIF001", "RIF004", "RIF010"), decorated)}


def _six(c: Column | str) -> Column:
    return F.round(c, 6)


# ---- scalar functions


@query
def word_stats(spark, d):
    c = corpus(spark, d)
    return c.blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.sum("words").alias("words"), F.sum(T.estimate_tokens(F.col("text"))).alias("tokens"), F.sum(F.when(F.col("prose"), F.col("words")).otherwise(0)).alias("prose_words"))


@query
def sentence_split(spark, d):
    """All sentences of the documents, line by line."""
    t = read(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    s = t.select("doc_id", "line_no", T.sentences(F.col("line")).alias("s")).where(F.size("s") > 0)
    return s.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.size("s").cast("bigint").alias("n"), F.array_join("s", "|").alias("joined"))


@query
def readability(spark, d):
    c = corpus(spark, d)
    g = T.grade(F.size(T.sentences(F.col("text"))), F.col("words"), T.syllable_total(T.words(F.col("text"))))
    return c.prose.where("words >= 30").withColumn("g", g).where("g is not null").select("doc_id", F.col("pos").cast("bigint").alias("pos"), _six("g").alias("grade"))


@query
def strip_markup(spark, d):
    t = read(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    s = t.select("doc_id", "line", T.strip_inline(F.col("line")).alias("plain"))
    return s.groupBy("doc_id").agg(F.sum(F.length("line")).alias("raw_chars"), F.sum(F.length("plain")).alias("plain_chars"), F.sum(T.word_count("plain")).alias("words"))


@query
def snippets(spark, d):
    c = corpus(spark, d)
    return c.blocks.select("doc_id", F.col("pos").cast("bigint").alias("pos"), T.snippet(F.col("text")).alias("head"), T.snippet(F.col("text"), F.lit(50)).alias("tail"))


@query
def link_dumps(spark, d):
    c = corpus(spark, d)
    return c.blocks.where("dump").select("doc_id", F.col("pos").cast("bigint").alias("pos"))


# ---- exact rules


def _rule(code: str, source, extra=lambda f: [], **options):
    def run(spark, d):
        f = CHECKS[code](source(spark, d), **options)
        return f.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("line").cast("bigint").alias("line"), F.col("col").cast("bigint").alias("col"), _six("value").alias("value"))

    run.__name__ = code.lower()
    run.__doc__ = CHECKS[code].__name__.replace("_", " ")
    QUERIES[run.__name__] = run


for _code in sorted(CHECKS):
    _rule(_code, SOURCES.get(_code, corpus), **({"max_sentence_words": 30} if _code == "CLR001" else {"max_reading_grade": 12.0} if _code == "CLR002" else {}))


@query
def sentence_rhythm(spark, d):
    """The statistics behind the rule on sentence lengths, for every document with enough sentences."""
    s = corpus(spark, d).sentences.where("not dump and n > 0").groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum("n").alias("words"), _six(F.stddev_pop("n") / F.avg("n")).alias("variation"))
    return s.where("sentences >= 25")


@query
def paragraph_rhythm(spark, d):
    p = corpus(spark, d).prose.where("words >= 15 and not dump").groupBy("doc_id").agg(F.count("*").alias("paragraphs"), _six(F.stddev_pop("words") / F.avg("words")).alias("variation"))
    return p.where("paragraphs >= 4")


# ---- hierarchy


@query
def sections(spark, d):
    s = corpus(spark, d).sections
    return s.select("doc_id", *(F.col(c).cast("bigint").alias(c) for c in ("sec_no", "level", "own_start", "own_end", "sub_end", "prose_words", "children")), F.coalesce("title", F.lit("")).alias("title"), F.coalesce(F.col("parent_pos").cast("bigint"), F.lit(-1)).alias("parent_pos"))


@query
def dividers(spark, d):
    return corpus(spark, d).sections.where("title is not null and divider").select("doc_id", F.col("sec_no").cast("bigint").alias("sec_no"), "title")


@query
def peer_sections(spark, d):
    return peers(corpus(spark, d).sections, 2).groupBy("doc_id").agg(F.max("peer_level").cast("bigint").alias("peer_level"), F.count("*").alias("sections"), F.sum("prose_words").alias("words"))


@query
def section_rhythm(spark, d):
    p = peers(corpus(spark, d).sections, 2).groupBy("doc_id").agg(F.count("*").alias("sections"), F.sum("prose_words").alias("total"), _six(F.stddev_pop("prose_words") / F.avg("prose_words")).alias("variation"))
    return p.where("total > 0").drop("total")


@query
def outline(spark, d):
    c = corpus(spark, d)
    return report.outline_lines(c.sections, c.docs).select("doc_id", F.col("k").cast("bigint").alias("k"), "line_text")


@query
def slide_sections(spark, d):
    c = corpus(spark, d)
    s = slides(c.blocks.join(c.docs.where("format = 'pptx'"), "doc_id", "left_semi"))
    return s.select("doc_id", F.col("sec_no").cast("bigint").alias("sec_no"), "label", F.coalesce("title", F.lit("")).alias("title"), F.col("prose_words").cast("bigint").alias("prose_words"), F.col("bullets").cast("bigint").alias("bullets"))


# ---- gating and custom rules


@query
def rules_catalog(spark, d):
    return rules_df(spark).groupBy("kind", "scope", "is_default").agg(F.count("*").alias("rules"))


@query
def rule_applies(spark, d):
    """How many documents of each type each gated rule applies to."""
    docs = corpus(spark, d).docs
    gated = [r for r in catalog() if r.applies_to or r.skip_for]
    return applicable(docs, gated).groupBy("code", F.coalesce("doc_type", F.lit("")).alias("doc_type")).agg(F.count("*").alias("documents"))


@query
def doc_types(spark, d):
    return resolve_types(corpus(spark, d).docs, Settings(semantic=False)).groupBy(F.coalesce("doc_type", F.lit("")).alias("doc_type"), "doc_type_source").agg(F.count("*").alias("documents"))


@query
def custom_phrase(spark, d):
    r = custom_rule({"code": "ORG001", "phrases": ["near the gate", "side room", "don't"], "summary": "house style"}, catalog())
    return custom_findings(corpus(spark, d), r).groupBy("doc_id").agg(F.count("*").alias("hits"), F.min("pos").cast("bigint").alias("first_pos"))


@query
def custom_regex(spark, d):
    spark.range(1)  # a session is active
    r = custom_rule({"code": "ORG002", "type": "regex", "pattern": "[0-9]+ (months|minutes)", "summary": "durations", "blocks": "all"}, catalog())
    return custom_findings(corpus(spark, d), r).select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("col").cast("bigint").alias("col"))


# ---- planner and decisions


@query
def plan_units(spark, d):
    """Units by scope and view, with default rules."""
    u = units.plan(corpus(spark, d), active(catalog()))
    return u.groupBy("doc_id", "unit_scope", "view").agg(F.count("*").alias("n"), F.sum(F.size("codes")).cast("bigint").alias("asked"))


@query
def plan_block_units(spark, d):
    u = units.plan(corpus(spark, d), active(catalog())).where("unit_scope = 'block'")
    return u.select("doc_id", F.col("anchor_pos").cast("bigint").alias("pos"), "tokens", F.size("codes").cast("bigint").alias("asked"))


@query
def plan_sections(spark, d):
    u = units.plan(corpus(spark, d), active(catalog())).where("unit_scope in ('section', 'title')")
    return u.select("doc_id", "unit_scope", F.col("sec_no").cast("bigint").alias("sec_no"), "state", F.array_join("codes", ",").alias("codes"))


def length_scorer(state: str, questions) -> dict[str, float]:
    """A stand-in that SQL can follow: hundredths from the length of the state and the number of the rule."""
    return {code: (len(state) * 31 + 7 * int(code[3:]) + 13) % 100 / 100 for code in questions}


@query
def score_findings(spark, d):
    """Paragraphs and list entries asked by all default rules of blocks, with a stand-in for the model: findings by rule."""
    c = corpus(spark, d).persist()
    rules = [r for r in active(catalog()) if r.scope == "block"]
    got = scoring.decide(units.plan(c, rules), rules, length_scorer)
    return scoring.findings(got, c.blocks, rules, Settings()).groupBy("code").agg(F.count("*").alias("findings"))


@query
def model_answers(spark, d):
    """Every answer of the stand-in, as a debug view shows them."""
    c = corpus(spark, d)
    rules = [r for r in active(catalog()) if r.scope == "block"]
    a = scoring.answers(scoring.decide(units.plan(c, rules), rules, length_scorer))
    return a.select("doc_id", F.col("anchor_pos").cast("bigint").alias("pos"), "code", F.round("probability", 2).alias("probability"))


@query
def run_stats(spark, d):
    """Calls and tokens of each document."""
    c = corpus(spark, d)
    rules = [r for r in active(catalog()) if r.scope == "block"]
    s = scoring.run_stats(scoring.decide(units.plan(c, rules), rules, length_scorer))
    return s.select("doc_id", "calls", "input_tokens", "skipped", "context_exceeded", "errors")


@query
def share_below(spark, d):
    """Documents few of whose paragraphs show the trait of the rule that is about shares, with a stand-in for the model."""
    c = corpus(spark, d).persist()
    rules = [r for r in catalog() if r.share_below is not None]
    s = Settings(thresholds={r.code: 0.95 for r in rules})
    return scoring.findings(scoring.decide(units.plan(c, rules), rules, length_scorer), c.blocks, rules, s).select("doc_id", "code", F.col("pos").cast("bigint").alias("pos"))


@query
def classified_types(spark, d):
    """Types that a stand-in chooses for the documents without one, and which source each document's type has."""
    c = corpus(spark, d)
    text = c.prose.groupBy("doc_id").agg(F.sum("words").alias("words"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    names = list(TYPES)
    chosen = scoring.classify(text.join(c.docs.where("doc_type is null"), "doc_id", "left_semi"), lambda n, t: (names[(len(t) + n) % len(names)], 0.5))
    return resolve_types(c.docs, Settings(), chosen).groupBy(F.coalesce("doc_type", F.lit("")).alias("doc_type"), "doc_type_source").agg(F.count("*").alias("documents"))


# ---- compare


def _pairs(spark, d) -> DataFrame:
    """Each document as the rewrite of the one with the id before its own."""
    t = read(spark, d, "documents").where("text is not null")
    before = t.select((F.col("doc_id") + 1).alias("pair_id"), F.col("text").alias("source"))
    return before.join(t.select(F.col("doc_id").alias("pair_id"), F.col("text").alias("rewrite")), "pair_id")


@query
def compare_features(spark, d):
    """Claims of both sides by kind."""
    p = _pairs(spark, d)
    each = reduce(DataFrame.unionByName, [features(p, side).withColumn("side", F.lit(side)) for side in ("source", "rewrite")])
    return each.groupBy("pair_id", "side", "kind").agg(F.sum("n").alias("n"), F.count("*").alias("distinct_tokens"))


@query
def compare_changes(spark, d):
    c = compare(_pairs(spark, d), waive=("friday",))
    return c.groupBy("pair_id", "direction", "kind").agg(F.count("*").alias("changes"), F.sum("source_n").alias("source_n"), F.sum("rewrite_n").alias("rewrite_n"))


# ---- sources


def _documents(spark, d, fmt: str) -> DataFrame:
    return read(spark, d, "documents").where("text is not null").select("doc_id", F.lit(fmt).alias("format"), F.encode("text", "UTF-8").alias("content"))


@query
def md_blocks(spark, d):
    return blocks_of(_documents(spark, d, "md")).groupBy("doc_id", "kind").agg(F.count("*").alias("blocks"), F.sum(T.word_count("text")).alias("words"))


@query
def txt_blocks(spark, d):
    return blocks_of(_documents(spark, d, "txt")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("line").cast("bigint").alias("line"), T.word_count("text").cast("bigint").alias("words"))


def _pages(spark, d) -> DataFrame:
    """Pages written from the blocks of the html files."""
    b = read(spark, d, "blocks").where("text is not null").dropDuplicates(["file_id", "block_id"])
    tag = F.when(F.col("head_level") > 0, F.concat(F.lit("h"), F.col("head_level"))).when(F.col("kind") == "list_item", "li").when(F.col("kind") == "table_cell", "td").when(F.col("kind") == "title", "title").otherwise("p")
    safe = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    row = F.struct("pos", F.concat(F.lit("<"), tag, F.lit(">"), safe, F.lit("</"), tag, F.lit(">")).alias("h"))
    pages = b.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["h"]), "\n").alias("h"))
    files = read(spark, d, "files").where("lower(trim(file_format)) = 'html'").select("file_id", "path", "doc_type")
    return pages.join(files, "file_id").select(F.col("file_id").alias("doc_id"), "path", "doc_type", F.lit("html").alias("format"), F.encode(F.concat(F.lit("<html><body>"), "h", F.lit("</body></html>")), "UTF-8").alias("content"))


@query
def html_blocks(spark, d):
    return blocks_of(_pages(spark, d)).groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count_if(F.col("kind") == "heading").alias("headings"), F.count_if(F.col("kind") == "list_item").alias("items"))


@query
def html_article(spark, d):
    return blocks_of(_pages(spark, d), main_content=True).groupBy("doc_id").agg(F.count("*").alias("blocks"), F.sum(T.word_count("text")).alias("words"))


@query
def lint_pages(spark, d):
    """The whole way from HTML to findings of the default exact rules."""
    c, errors = corpus_of(_pages(spark, d))
    return lint(c, Settings(semantic=False), errors=errors).findings.groupBy("code").agg(F.count("*").alias("findings"))


# ---- reports


def _default_findings(spark, d) -> DataFrame:
    return static_findings(corpus(spark, d).persist(), active(catalog(), semantic=False), Settings())


@query
def summary_top_codes(spark, d):
    return report.top_codes(_default_findings(spark, d)).select("code", "n", F.col("rank").cast("bigint").alias("rank"))


@query
def bench_by_label(spark, d):
    labels = read(spark, d, "labels").where("nature is not null").select(F.col("file_id").alias("doc_id"), F.col("nature").alias("label")).distinct()
    return report.by_label(_default_findings(spark, d), labels)


@query
def gated_findings(spark, d):
    """The whole way from the tables to the findings of the default exact rules that apply to their documents."""
    return lint(corpus(spark, d), Settings(semantic=False)).findings.groupBy("code").agg(F.count("*").alias("findings"), F.countDistinct("doc_id").alias("documents"))


@query
def report_json(spark, d):
    run = lint(corpus(spark, d), Settings(semantic=False))
    return report.json_report(run)


# ---- streaming


def _arriving(spark, d) -> DataFrame:
    """The documents as a stream of files."""
    return spark.readStream.schema(read(spark, d, "documents").schema).option("maxFilesPerTrigger", 4).parquet(f"{d}/documents.parque[t]")


def _folder(spark) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}" if root else tempfile.mkdtemp()  # unset only in local tests


@query
def stream_long_sentences(spark, d):
    """Sentences over 30 words, by a stream that keeps no state."""
    s = long_sentences(_arriving(spark, d).where("text is not null"), 30)
    return drain(s.select("doc_id", F.col("sent_no").cast("bigint").alias("sent_no"), F.col("words").cast("bigint").alias("words")), _folder(spark))


@query
def stream_windows(spark, d):
    """Documents and words by day of arrival and source, by a stream that keeps its windows until they are past the watermark."""
    t = _arriving(spark, d).where("text is not null and added_at is not null")
    w = windowed_counts(t).select(F.date_format("window_start", "yyyy-MM-dd").alias("window_day"), F.coalesce("source", F.lit("")).alias("source"), "documents", "words")
    return drain(w, _folder(spark), "complete")


__all__ = ["QUERIES", "lint_stream", "titled"]
