"""Problem 1: reading grade of English files, by a familiar-word formula.

Familiar words are those of high document frequency in plain prose: a word is on the list if it stands in at least a share exp(RARE) of the files that raters
find easiest (a median level of at most EASY). Document frequency over all files would not do, because in a corpus of few subjects hard words are as frequent
as plain ones; it only enters as a prior worth PRIOR_EASY files, so that the list is defined for any number of labels, and follows all files where there are none. As every
file has few distinct words, no more than (mean distinct words) / exp(RARE) words can pass, whatever the corpus: the list is small enough to send.

grade = a * (share of words outside the list, in percent) + b * (words per sentence) + c. The three coefficients put the formula on the scale of school
years: they are the least-squares fit to the Flesch-Kincaid grade over all graded files of the corpus (with DEFAULT as a weak prior).

Blocks are shuffled once, by file; what is kept of each file (its words and counts) is written to the shared folder.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.llm import boilerplate as bp
from inkloom.llm import common
from inkloom.llm.common import files_with_blocks, has_long_files, language, listed, own, table, unnest
from inkloom.llm.mixing import durable
from inkloom.llm.quality import cells_of, kind_of

RARE, EASY, PRIOR_EASY = -3.25, 1.5, 3
DEFAULT = (0.39, 0.39, -4.0)
DEFAULT_LIMIT = 14.0
MIN_SENTENCES, MIN_WORDS = 3, 30
PRIOR, USUAL = 20, (15.0, 16.0)  # files that DEFAULT counts as; their share of unfamiliar words, and words a sentence

_WORD = re.compile(r"[A-Za-z][A-Za-z'’-]*")
_STOP = re.compile(r"([.!?]+)[\"'”’»)\]]*(?:\s+[\"'“‘«(\[]*(?=(\S))|\s*$)")
_LAST = re.compile(r"(?s).*[.!?]+[\"'”’»)\]]*(?=\s|$)")
_ODD = re.compile(r"[{}\[\]<>|^~=_\\Ââ�]")
_ODD_BYTES = bytes(i for i in range(128) if _ODD.match(chr(i)))
_WORD_BYTES = bytes(i if _WORD.match("a" + chr(i)).end() == 2 else 32 for i in range(128)) + bytes(i if i == 0x92 else 32 for i in range(128, 256))  # 0x92: ’ in cp1252
# Abbreviations of English after which a sentence goes on.
ABBREVIATIONS = frozenset("mr mrs ms dr prof sr jr st vs e.g i.e u.s u.k inc ltd co corp no fig approx dept est vol al p pp cf sept rd".split())


def sentence_count(text: str) -> int:
    n = 0
    for m in _STOP.finditer(text):
        marks, after = m.groups()
        if after is not None:
            if after.islower():
                continue
            if marks == ".":
                before = text[max(0, m.start() - 12) : m.start()].removesuffix("\n")
                token = before.split()[-1].lower().lstrip("\"'“‘«([") if before and not before[-1].isspace() else ""
                if token in ABBREVIATIONS or len(token) == 1 and token.isalpha():
                    continue
        n += 1
    return n


def is_running(text: str) -> bool:
    """Sentences, and not a row of cells or a dump."""
    whole = text.strip()
    if " " not in whole:
        return False
    if len(whole) * 2 < len(text) or not whole.rstrip("\"'”’»)]").endswith((".", "!", "?")):  # else it ends as a sentence
        m = _LAST.match(text)
        if m is None or m.end() < 0.5 * len(text):
            return False
    odd = len(text) - len(text.encode().translate(None, _ODD_BYTES)) if text.isascii() else len(_ODD.findall(text))
    return odd <= 0.05 * len(text) and cells_of(text) == 1


def word_counts(text: str) -> Counter:
    """Occurrences of what _WORD matches in the lower-cased text, found on bytes: letters, apostrophes and hyphens, from the first letter on."""
    plain = text.isascii()
    raw = (text if plain else text.lower()).encode("ascii" if plain else "cp1252", "replace").translate(_WORD_BYTES).lower()
    counts = Counter(raw.decode("cp1252").split())
    for w in [w for w in counts if not w[0].isalpha()]:
        n, bare = counts.pop(w), w.lstrip("'’-")
        if bare:
            counts[bare] += n
    return counts


def syllables(word: str) -> int:
    w = re.sub(r"(?:[^laeiouy]es|ed|[^laeiouy]e)$", "", word.strip("'’"))
    return max(1, len(re.findall(r"[aeiouy]+", w[1:] if w[:1] == "y" else w)))


PROSE = "file_id bigint, settings_id int, segments int, english boolean, sentences bigint, words bigint, word array<string>, times array<int>"


def prose(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """The English prose of each segment of a file, as words with counts. Of a file in several segments the language that most of its words are in decides."""
    long = has_long_files(blocks)
    model = blocks.sparkSession.sparkContext.broadcast(bp.fit(files, blocks, long))  # at most bp.MAX_FEATURES of either kind
    pages, size = files_with_blocks(files, blocks, ("settings_id",), long), common.SEGMENT
    names = [x.split()[0] for x in PROSE.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cols, groups = unnest(batch)
            formats, settings, segments, many, headings = (batch.column(c).to_pylist() for c in ("file_format", "settings_id", "segment", "segments", "heading"))
            rows = []
            for file_id, fmt, setting, part, parts_, heading, at in zip(ids, formats, settings, segments, many, headings, groups):
                positions = cols["pos"][at]
                page = list(zip(cols["text"][at], cols["kind"][at], cols["head_level"][at]))
                mine = [True] * len(page) if parts_ == 1 else own(part, positions, size)
                kept = [i for i, (t, kind, lv) in enumerate(page) if mine[i] and not lv and kind_of(kind) != "heading" and is_running(t)]
                if not kept:
                    continue
                english = language(" ".join([page[i][0] for i in kept])) in ("en", "")
                if not english and parts_ == 1:
                    continue
                if fmt == "html":
                    out = bp.label(model.value, page, bp.heading_in(page, positions, heading))
                    kept = [i for i in kept if not out[i]]
                texts = [page[i][0] for i in kept]
                counts = word_counts("\n".join(texts))
                words, sentences = sum(counts.values()), sum(map(sentence_count, texts))
                if words:
                    rows.append((file_id, setting, parts_, english, sentences, words, list(counts), list(counts.values())))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names)

    rows = durable(pages.mapInArrow(run, PROSE), "prose")
    if not long:
        return rows
    english = rows.groupBy("file_id").agg((2 * F.sum(F.when(F.col("english"), F.col("words")).otherwise(0)) >= F.sum("words")).alias("is_english")).where("is_english")
    return rows.join(english, "file_id", "left_semi")


def _frequencies(rows: DataFrame) -> tuple[DataFrame, int]:
    """((w, df), number of files) of English prose; a file in several segments counts once."""
    total = rows.where("segments = 1").count() + rows.where("segments > 1").select("file_id").distinct().count()
    held = rows.select("file_id", "segments", F.explode("word").alias("w"))
    return held.where("segments = 1").select("w").unionByName(held.where("segments > 1").select("file_id", "w").distinct().select("w")).groupBy("w").agg(F.count("*").alias("df")), total


def familiar(rows: DataFrame, labels: DataFrame | None = None) -> set[str]:
    """The list. labels: (file_id, read_level) from 1, the easiest, of some files, perhaps several for one; nulls don't count."""
    df, total = _frequencies(rows)
    share = F.col("df") / max(1, total)
    if labels is not None:
        easy = labels.where("file_id is not null and read_level is not null").groupBy("file_id").agg(F.median("read_level").alias("level")).where(F.col("level") <= EASY)
        plain, n = _frequencies(rows.join(easy, "file_id", "left_semi"))
        df = df.join(plain.withColumnRenamed("df", "easy"), "w", "left")
        share = (F.coalesce("easy", F.lit(0)) + PRIOR_EASY * share) / (n + PRIOR_EASY)
    return {r[0] for r in df.where(F.log(share) >= RARE).select("w").collect()}  # bounded, see the module's text


MEASURES = "file_id bigint, settings_id int, sentences bigint, words bigint, unknown double, syllables double"


def measures(rows: DataFrame, known: set[str]) -> DataFrame:
    """unfamiliar (share of words outside the list, in percent), sentence_words and school_years (Flesch-Kincaid) of each file with enough prose."""
    sent = rows.sparkSession.sparkContext.broadcast(known)
    names = [x.split()[0] for x in MEASURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spoken: dict[str, int] = {}
        for batch in batches:
            lists, times = batch.column("word"), np.asarray(batch.column("times").flatten())
            offsets = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            coded = lists.flatten().dictionary_encode()
            words, code = listed(coded.dictionary), np.asarray(coded.indices)
            for w in set(words) - spoken.keys():
                if len(spoken) > 200_000:
                    spoken.clear()
                spoken[w] = syllables(w)
            new = np.array([w not in sent.value for w in words], np.float64)[code]
            syl = np.array([spoken.get(w) or syllables(w) for w in words], np.float64)[code]
            add = lambda v: np.add.reduceat(v * times, offsets[:-1]) if len(v) else np.zeros(0)
            yield pa.record_batch([*(batch.column(c) for c in ("file_id", "settings_id", "sentences", "words")), pa.array(add(new)), pa.array(add(syl))], names)

    m = rows.mapInArrow(run, MEASURES).groupBy("file_id").agg(F.max("settings_id").alias("settings_id"), *(F.sum(c).alias(c) for c in ("sentences", "words", "unknown", "syllables")))
    m = m.where((F.col("words") >= MIN_WORDS) & (F.col("sentences") >= MIN_SENTENCES))
    length = F.col("words") / F.col("sentences")
    years = 0.39 * length + 11.8 * F.col("syllables") / F.col("words") - 15.59
    return m.select("file_id", "settings_id", "sentences", "words", (100 * F.col("unknown") / F.col("words")).alias("unfamiliar"), length.alias("sentence_words"), years.alias("school_years"))


def calibrated(m: DataFrame) -> tuple[float, float, float]:
    """Coefficients of the formula: least squares over all files, from nine sums, with DEFAULT as a prior worth PRIOR files, so that it works alike for any number of files."""
    u, a, y = "unfamiliar", "sentence_words", "school_years"
    r = m.agg(F.count("*"), F.sum(u), F.sum(a), F.sum(F.col(u) * F.col(u)), F.sum(F.col(u) * F.col(a)), F.sum(F.col(a) * F.col(a)), F.sum(F.col(u) * F.col(y)), F.sum(F.col(a) * F.col(y)), F.sum(y)).first()
    n, su, sa, uu, ua, aa, uy, ay, sy = (float(x or 0) for x in r)
    prior = PRIOR * np.array([[u_ * v for v in (*USUAL, 1.0)] for u_ in (*USUAL, 1.0)]) + PRIOR * np.diag([*(x * x / 4 for x in USUAL), 0.0])
    gram = np.array([[uu, ua, su], [ua, aa, sa], [su, sa, n]]) + prior
    return tuple(map(float, np.linalg.solve(gram, np.array([uy, ay, sy]) + prior @ np.array(DEFAULT))))


def grades(files: DataFrame, blocks: DataFrame, settings: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(file_id, grade, reading_limit, over, unfamiliar, sentence_words, sentences, words) of the English files with at least three sentences and thirty words of prose.

    Null texts and blocks without a file are left out, a block that is loaded again counts once, a repeated file once; null or missing limits are 14.0. Without a single
    file to grade the result is empty; without labels all files say which words are familiar. Other columns are ignored.
    """
    rows = prose(files, blocks)
    m = durable(measures(rows, familiar(rows, labels)), "grades")  # read by the fit and the result
    a, b, c = calibrated(m)
    limits = settings.where("settings_id is not null").groupBy("settings_id").agg(F.max("max_reading_grade").alias("reading_limit"))
    g = m.join(limits, "settings_id", "left").withColumn("reading_limit", F.coalesce("reading_limit", F.lit(DEFAULT_LIMIT)))
    grade = F.lit(a) * F.col("unfamiliar") + F.lit(b) * F.col("sentence_words") + F.lit(c)
    return g.select("file_id", grade.alias("grade"), "reading_limit", (grade > F.col("reading_limit")).alias("over"), "unfamiliar", "sentence_words", "sentences", "words", "school_years")


def _grades(spark, sf_dir: str) -> DataFrame:
    return grades(*(table(spark, sf_dir, t) for t in ("files", "blocks", "settings", "labels")))


def p1_found(spark, sf_dir: str) -> DataFrame:
    return _grades(spark, sf_dir).where("over").select("file_id").distinct()


def p1_levels(spark, sf_dir: str) -> DataFrame:
    """Files by whole school years: the profile of the corpus."""
    return _grades(spark, sf_dir).groupBy(F.floor("grade").cast("bigint").alias("school_year")).agg(F.count("*").alias("files"), F.sum("words").alias("words"))
