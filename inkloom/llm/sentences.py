"""Problem 3: sentence boundaries across languages and scripts, learned without labels.

Over all blocks, and for each language, words are counted: as such, at the start of a block (a certain sentence start), and
in pairs of a word that ends in a mark with the word behind it. From these, by log-likelihood ratios (G2):

* sentence starters: words that stand at block starts more often than chance, and where the script has cases hardly ever within a
  sentence with a capital;
* abbreviations: words that carry a mark more often than chance and are followed by something other than a starter more often than
  words with a mark usually are. Short words need less evidence than long ones. Names with a mark inside
  ("Yahoo! Ltd.") and ordinal numbers ("9. Mai") are found the same way, as words whose mark doesn't end a sentence;
* collocations: pairs of a word that ends in a mark and a word that isn't a starter, which stands behind this word more often than behind the marks of all
  others. They decide where the word alone doesn't, as "9. Mai" where most numbers end sentences. Behind other words than numbers the second word
  must also be seen within sentences, since fixed notices repeat the same two sentences;
* openers: words that stand behind the marks of ordinary words and hardly ever within a sentence. Behind a number they begin a sentence, even
  where most numbers go on, unless the pair is a collocation.

Each mark is then classified by these statistics; quotations, brackets and unspaced scripts have rules of their own.
Counts are summed in each batch before they are shuffled by (language, words); only the four learned lists are broadcast. An entry must make up
at least LEAST_SHARE of what is counted for its list in its language (of block starts, of words with a mark), so a list holds at most 1 / LEAST_SHARE
entries a language, whatever the corpus, and no language takes another's place.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.llm.common import language, table

LEAST_SHARE = 1e-5  # of the block starts, or the words with a mark, of a language
NEAR = 64  # characters in front of a mark that can belong to its word
LEAST_PAIRS = 5  # times that a collocation must occur
G2 = 7.88  # 99.5 % point of chi square with one degree of freedom
_MARKED = re.compile(r"([^\s.!?\"'“”‘’«»„()\[\]]+(?:\.[^\s.!?\"'“”‘’«»„()\[\]]+)*)([.!?]+)(?=\s|$)")
_WORD = re.compile(r"[^\W\d_]+(?:[ऀ-ॿ]|['’-](?=\w))*[^\W\d_]*")
_NEXT = re.compile(r"[\s\"'“”‘’«»„()\[\]¿¡—–-]*([^\s.,;:!?\"'“”‘’«»„()\[\]¿¡]*)")
CLOSERS = "\"'”’»›)]」』）】〉》"
_QUOTES = "\"'”’»›」』〉》“"
_MARK = re.compile(r"[.!?。！？।؟…｡]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_THAI = re.compile(r"[฀-๿]")
_CAPITALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTERS_END = re.compile(r"[^\W_]+\Z")
_TOKEN_END = re.compile(r"[^\s\"'“”‘’«»„()\[\]]+\Z")
_THAI_SPACE = re.compile(r"\s+")


def shape(word: str) -> str:
    """Type of a word in front of a mark: small letters, numbers alike, initials alike."""
    if word.isdigit():
        return "0"
    if len(word) == 1 and word.isupper():
        return "@"
    return word.lower()


def _count(texts: list[str]) -> Counter:
    n: Counter = Counter()
    for text in texts:
        lang = language(text)
        if lang in ("zh", "ja", "th", ""):
            continue
        words = _WORD.findall(text)
        if not words:
            continue
        for w, k in Counter(words).items():
            n[lang, "w", w, ""] += k
        if text[:1] in words[0][:1] or not text[:1].isalnum():
            n[lang, "s", words[0], ""] += 1
        for m in _MARKED.finditer(text):
            after = _NEXT.match(text, m.end()).group(1) if m.end() < len(text) else ""
            if after[:1].isdigit():
                after = "0"
            marks = m.group(2)
            n[lang, "p", shape(m.group(1)) + ("" if marks[0] == "." else marks[0]), after] += 1
    return n


def g2(k: Column, n: Column, p: Column) -> Column:
    """Log-likelihood ratio of k hits in n trials against the rate p."""
    own = F.least(F.greatest(k / n, F.lit(1e-9)), F.lit(1 - 1e-9))
    rate = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return 2 * (k * F.log(own / rate) + (n - k) * F.log((1 - own) / (1 - rate)))


class Model:
    def __init__(self, starters: set[tuple[str, str]], abbreviations: set[tuple[str, str]], silent: set[str] = frozenset(), collocations: set[tuple[str, str, str]] = frozenset(), openers: set[tuple[str, str]] = frozenset()):
        self.starters, self.abbreviations, self.silent, self.collocations, self.openers = starters, abbreviations, silent, collocations, openers


def counts(blocks: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = _count([t for t in batch.column("text").to_pylist() if t])
            keys = list(zip(*n)) or [[]] * 4
            yield pa.record_batch([*(pa.array(k, pa.string()) for k in keys), pa.array(list(n.values()), pa.int64())], ["lang", "what", "word", "after", "n"])

    return blocks.where("text is not null").select("text").mapInArrow(run, "lang string, what string, word string, after string, n bigint").groupBy("lang", "what", "word", "after").agg(F.sum("n").alias("n"))


def learn(blocks: DataFrame) -> Model:
    """Sentence starters, abbreviations and collocations of every language of the corpus."""
    spark = blocks.sparkSession
    c = counts(blocks).persist()
    try:
        low = F.lower("word")
        forms = c.where("what <> 'p'").groupBy("lang", F.col("word")).agg(F.sum(F.when(F.col("what") == "w", F.col("n")).otherwise(0)).alias("total"), F.sum(F.when(F.col("what") == "s", F.col("n")).otherwise(0)).alias("first"))
        small = forms.groupBy("lang", low.alias("small")).agg(F.sum(F.when(F.col("word") == low, F.col("total")).otherwise(0)).alias("small_total"), F.sum("total").alias("any_total"))
        base = forms.groupBy("lang").agg((F.sum("first") / F.sum("total")).alias("p"), F.sum("total").alias("words"), F.sum("first").alias("begun"))
        caseless = F.col("lang").isin("ar", "hi")
        behind = c.where("what = 'p' and after <> ''").groupBy("lang", F.col("after").alias("word")).agg(F.sum("n").alias("behind"))
        within = F.col("total") - F.col("first") - F.coalesce("behind", F.lit(0))
        starters = (
            forms.where("first >= 3")
            .join(base, "lang")
            .join(behind, ["lang", "word"], "left")
            .where((F.col("first") / F.col("total") > F.col("p")) & (g2(F.col("first"), F.col("total"), F.col("p")) >= G2))
            .where(caseless | (F.col("word") != low) & (within <= 0.1 * F.col("total")))
            .where(F.col("first") >= LEAST_SHARE * F.col("begun"))
        )
        top = sorted(tuple(r) for r in starters.select("lang", "word").collect())  # bounded by LEAST_SHARE, like all lists below
        known = spark.createDataFrame(top or [("", "")], "lang string, after string").withColumn("starts", F.lit(1))
        pairs = c.where("what = 'p'").join(F.broadcast(known), ["lang", "after"], "left")
        types = pairs.groupBy("lang", "word").agg(F.sum("n").alias("marked"), F.sum(F.when(F.col("after") != "", F.col("n")).otherwise(0)).alias("followed"), F.sum(F.when((F.col("after") != "") & F.col("starts").isNull(), F.col("n")).otherwise(0)).alias("going_on"))
        stops = F.when(~F.col("word").rlike("[!?]$"), F.col("followed")).otherwise(0)
        rates = types.groupBy("lang").agg((F.sum("going_on") / F.greatest(F.sum("followed"), F.lit(1))).alias("q"), F.sum("marked").alias("marks"), F.sum(stops).alias("stops"))
        # where a point is never followed by a starter, points only abbreviate
        silent = {r[0] for r in rates.where((F.col("q") >= 0.98) & (F.col("stops") >= 5)).select("lang").collect()}
        bare = F.regexp_replace("word", "[!?]$", "")
        abbreviations = (
            types.where("followed >= 3")
            .withColumn("small", bare)
            .join(small.select("lang", "small", "any_total"), ["lang", "small"], "left")
            .join(rates, "lang")
            .join(base.select("lang", "words"), "lang")
            .withColumn("any_total", F.greatest(F.coalesce("any_total", F.lit(0)), F.col("marked")))
            .where((F.col("going_on") / F.col("followed") >= 0.6) & (F.col("going_on") / F.col("followed") > F.col("q")))
            .where(g2(F.col("going_on"), F.col("followed"), F.col("q")) >= G2 * F.greatest(F.lit(1), F.length("word") - 3))
            .where((F.col("marked") / F.col("any_total") > F.col("marks") / F.col("words")) & (g2(F.col("marked"), F.col("any_total"), F.col("marks") / F.col("words")) >= G2))
            .where(F.col("marked") >= LEAST_SHARE * F.col("marks"))
        )
        found = {tuple(r) for r in abbreviations.select("lang", "word").collect()}
        heard = forms.withColumn("after", F.col("word")).join(behind, ["lang", "word"], "left").select("lang", "after", "first", "total", within.alias("within"))
        behind_all = behind.withColumnRenamed("word", "after")
        marks_of = rates.select("lang", "marks")
        ends_of = types.join(behind.groupBy("lang").agg(F.sum("behind").alias("all_followed")), "lang").select("lang", "word", "followed", "all_followed")
        others = F.greatest(F.col("behind") - F.col("n"), F.lit(0.5)) / F.greatest(F.col("all_followed") - F.col("followed"), F.lit(1))
        collocations = (
            pairs.where((F.col("n") >= LEAST_PAIRS) & F.col("starts").isNull() & ~F.col("after").isin("", "0") & ~F.col("word").rlike("[!?]$"))
            .join(ends_of, ["lang", "word"])
            .join(behind_all, ["lang", "after"])
            .join(heard, ["lang", "after"])
            .where((F.col("first") <= 0.05 * F.col("total")) & ((F.col("word") == "0") | (F.col("within") >= 0.1 * F.col("total"))))
            .where((F.col("n") / F.col("followed") > others) & (g2(F.col("n"), F.col("followed"), others) >= G2))
            .join(marks_of, "lang")
            .where(F.col("n") >= LEAST_SHARE * F.col("marks"))
        )
        # words behind the marks of ordinary words, hardly ever within a sentence: behind a number they begin a sentence too
        shortened = spark.createDataFrame(sorted(found) or [("", "")], "lang string, word string")
        ordinary = c.where("what = 'p' and after not in ('', '0') and word not in ('0', '@') and word not like '%.%'").join(F.broadcast(shortened), ["lang", "word"], "left_anti").groupBy("lang", "after").agg(F.sum("n").alias("ordinary"))
        openers = ordinary.join(heard, ["lang", "after"]).where((F.col("ordinary") >= LEAST_PAIRS) & (F.col("within") <= 0.1 * F.col("total")) & (F.col("after") != F.lower("after"))).join(marks_of, "lang").where(F.col("ordinary") >= LEAST_SHARE * F.col("marks"))
        opening = {tuple(r) for r in openers.select("lang", "after").collect()}
        together = {tuple(r) for r in collocations.select("lang", "word", "after").collect()}
    finally:
        c.unpersist()
    return Model(set(top), found, silent, together, opening)


def ends(text: str, lang: str, model: Model) -> list[int]:
    """Places behind which a new sentence begins."""
    if lang == "th":
        out = []
        for m in _THAI_SPACE.finditer(text):
            before, after = text[max(0, m.start() - 1) : m.start()], text[m.end() : m.end() + 1]
            if before and after and _beside(before) and _beside(after):
                out.append(m.end())
        return out
    out = []
    size = len(text)
    lead = size - len(text.lstrip())
    open_quotes = seen = 0  # French quotes that are open at ``seen``
    for m in _MARK.finditer(text):
        i, marks = m.end(), m.group()
        j = i
        while j < size and text[j] in CLOSERS:
            j += 1
        # French sets its marks and quotes apart
        k = j
        while k < size and text[k].isspace():
            k += 1
        if k > j and k < size and text[k] in "»›":
            open_quotes += sum(text.count(x, seen, k) for x in "«‹") - sum(text.count(x, seen, k) for x in "»›")
            seen = k
        if k > j and k < size and text[k] in "»›" and open_quotes > 0:
            j = k + 1
            k = j
            while k < size and text[k].isspace():
                k += 1
        if k >= size:
            continue
        closed = text[i:j]
        nxt, wide = text[k], any(x in "。！？।؟｡" for x in marks)
        spaced = k > j
        word = _NEXT.match(text, k).group(1)
        quoted = any(x in _QUOTES for x in closed)
        if nxt in ",;:、，；：،؛)":
            continue
        if lang in ("zh", "ja") or wide and _CJK.match(nxt):
            if marks.strip(".") == "" and not _CJK.match(nxt) and not spaced:
                continue  # a decimal or a name
            if not quoted or spaced and not _CJK.match(nxt):
                if marks == "…" or marks == "……":
                    continue
                out.append(k)
            continue
        if nxt in "—–-" and k + 1 < size:
            if quoted or not spaced:
                continue  # a reporting clause
            rest = text[k + 1 : k + 1 + NEAR].lstrip()
            if rest[:1].islower():
                continue
        opening = nxt in "\"'“‘«„(¿¡「『（[" or not (nxt.isalnum())
        starts = (lang, word) in model.starters
        if (nxt.islower() or word[:1].islower()) and word[1:2] not in _CAPITALS:
            continue  # a name like iPage may begin a sentence
        if not spaced and not wide:
            # nothing between two sentences: only a known starter tells
            before = _LETTERS_END.search(text[max(0, m.start() - NEAR) : m.start()])
            if not (starts and (closed or before and len(before.group()) > 1)) and not (marks[-1] in "!?" and word[:1].isupper() and starts):
                continue
            out.append(k)
            continue
        if lang in ("ar", "hi") and quoted and not (opening and nxt in "\"'“‘«„"):
            continue  # who spoke follows
        if marks == "." or marks[0] in "!?" and len(marks) == 1:
            before = _TOKEN_END.search(text[max(0, m.start() - NEAR) : m.start()])
            token = before.group() if before else ""
            if marks == "." and not closed or marks != ".":
                kind = shape(token) + ("" if marks == "." else marks)
                if token.isdigit() and m.start() - len(token) == lead:
                    continue  # the number of a list entry
                if marks == "." and lang in model.silent:
                    continue
                together = (lang, kind, word) in model.collocations
                opens = kind == "0" and not together and (lang, word) in model.openers
                doubtful = together or (lang, kind) in model.abbreviations and not opens or len(kind) == 1 and kind != "0" or marks == "." and "." in token and len(token) <= 6 and not token[0].isdigit()
                if doubtful and not starts and not (opening and not nxt.isdigit() and nxt in "“«„\"¿¡"):
                    continue
        if marks[0] in ".…" and set(marks) <= {".", "…"} and len(marks) > 1 and word[:1].islower():
            continue
        out.append(k)
    return out


def _beside(c: str) -> bool:
    return not (c.isdigit() or c == "ๆ" or c.isascii() and c.isalpha() or "À" <= c <= "ɏ")


def _is_one(text: str) -> bool:
    """Whether no mark but at the very end could end a sentence."""
    if not text.isascii() and _THAI.search(text):
        return False
    m = _MARK.search(text)
    if m is None:
        return True
    j = m.end()
    while j < len(text) and text[j] in CLOSERS:
        j += 1
    return j == len(text) or len(text) - j < NEAR and text[j:].isspace()


def split(text: str, model: Model, lang: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of the sentences, end exclusive, without outer white space."""
    if lang is None:
        if _is_one(text):  # whatever its language
            a, b = len(text) - len(text.lstrip()), len(text.rstrip())
            return [(a, b)] if a < b else []
        lang = language(text) or "en"
    out, start = [], 0
    for at in [*ends(text, lang, model), len(text)]:
        a, b = start, at
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))
        start = at
    return out


OUT = "block_id bigint, sent_no int, text string, start_off int, end_off int"


def sentences(blocks: DataFrame, model: Model) -> DataFrame:
    """(block_id, sent_no, text, start_off, end_off) of every block. Null ids and texts and blank texts give no rows; repeated rows of a block give its sentences once.

    Offsets count code points. Blocks are independent: one narrow pass.
    """
    sent = blocks.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, text in zip(batch.column("block_id").to_pylist(), batch.column("text").to_pylist()):
                for n, (a, b) in enumerate(split(text, sent.value)):
                    for col, x in zip(out, (i, n, text[a:b], a, b)):
                        col.append(x)
            yield pa.record_batch([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32()))], ["block_id", "sent_no", "text", "start_off", "end_off"])

    return blocks.where("block_id is not null and text is not null").select("block_id", "text").mapInArrow(run, OUT).dropDuplicates(["block_id", "start_off", "end_off"])


def p3_found(spark, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "blocks").select("block_id", "text")
    wanted = table(spark, sf_dir, "sentences").select("block_id").distinct()
    return sentences(blocks.join(wanted, "block_id", "left_semi"), learn(blocks)).select("block_id", "start_off", "end_off")


def p3_sentences(spark, sf_dir: str) -> DataFrame:
    """The sentences of all blocks of the corpus."""
    blocks = table(spark, sf_dir, "blocks").select("block_id", "text")
    return sentences(blocks, learn(blocks))
