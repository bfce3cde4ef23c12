"""Problem 4: text quality statistics and what tells prose from lists, tables and junk, by robust Mahalanobis distance.

Each block gets a vector of statistics. Language by language, mean and covariance of prose are estimated robustly: from blocks that are plainly prose, then
STEPS times from the core of all blocks whose distance to the last estimate is small (concentration steps, so that disguised tables and junk
don't widen it). The squared distance of a block splits into one contribution per statistic, d_i * (S^-1 d)_i. Blocks within CUTOFF are prose; what a block
beyond it is, the contributions say: junk, if too many symbols, too few vowels and too long words contribute JUNK or more; a table, if
cells contribute that or its kind says so; else a list. A file has the nature that holds more than half of its characters, headings aside.

Common words are those that stand in many blocks of a language. Texts are read once; the statistics (some twenty numbers a block, and its words as hashes) are written
to the shared folder, and all else works on them. Counts and sums of products are pre-aggregated in each task; only the common words and
(languages x STATS^2) numbers reach the driver.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.llm.common import BREAK, LANGUAGES, language_votes, numbered, table, tokens
from inkloom.llm.mixing import durable

STATS = ("size", "word_length", "longest", "symbols", "digits", "vowels", "ended", "common", "cells", "kind_odds")
CUTOFF = 29.59  # 99.9 % point of chi square with ten degrees of freedom
JUNK = 12.0  # sum of the contributions of four statistics; their 98 % point in prose
STEPS = 3  # concentration steps; on the test tables the second changes the nature of no block
COMMON = 0.04  # share of a language's blocks that a common word stands in: no more than (mean distinct words of a block) / COMMON words a language can
PRIOR = 30  # blocks of all languages that each language's estimate is mixed with
_BAD = np.array([{"word_length": 1, "longest": 1, "symbols": 1, "vowels": -1}.get(s, 0) for s in STATS])  # the side of prose on which junk lies
_FLOOR = (0.3, 0.4, 0.15, 0.02, 0.04, 0.05, 0.15, 0.08, 0.1, 0.3)  # least standard deviation of each statistic: a constant one must not decide alone
_LAST_END = re.compile(r"(?s).*(?:[.!?…]+[\"'”’»)\]]*(?=\s|$)|[。！？।؟۔]+[”’」』）»]*)")
_LETTERS = re.compile(r"[^\W\d_]")
_SYMBOLS = re.compile(r"[^\w\s.,;:!?'\"()\-–—%/|“”‘’«»„¿¡…。、，！？；：「」『』（）।؟،؛*•·#&+°§$€£ๆ̀-ͯऀ-ःऺ-ॏ॑-ॗั-๎ً-ْ]")
_MOJIBAKE = re.compile(r"[ÂÃ].|â€|ï¿½|å¤|Ñ€|Ð°|ã€|â[^\sa-zà-ÿ]|�")  # UTF-8 read as another encoding
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]")
_VOWELS = re.compile(r"[aeiouyAEIOUYÀ-ÆÈ-ÏÒ-ÖØ-Ýà-æè-ïò-öø-ýÿŒœ]")
_CELLS = re.compile(r"\s*(?:\t+|\||;|\s{2,})\s*")
_SEPARATORS = re.compile(r"[|;,]")
_COMMA_CELLS = re.compile(r"\s*,\s*")
_VALUE = re.compile(r"[-+]?[\d.,]+%?|n/a|-|–|")
_MARKER = re.compile(r"\s*(?:[-*+•▪◦·]|\d{1,3}[.)]|\(?[a-z]\))\s+")
_UNSPACED = re.compile(r"[぀-ヿ一-鿿฀-๿]")
_DIGITS = re.compile(r"\d")
_ASCII = bytes(range(128))
_NO_LETTERS, _NO_VOWELS, _NO_DIGITS, _NO_SYMBOLS = (bytes(c for c in _ASCII if not p.match(chr(c))) for p in (_LATIN, _VOWELS, _DIGITS, _SYMBOLS))


@lru_cache(4096)
def kind_of(kind: str | None) -> str:
    """Heading, list, table or text, from the kinds as they are written."""
    k = re.sub(r"[\W_]+", "", (kind or "").lower())
    if k in ("heading", "title") or re.fullmatch(r"h\d", k):
        return "heading"
    if k in ("listitem", "li", "list"):
        return "list"
    if k in ("tablecell", "td", "th", "cell", "table", "tr"):
        return "table"
    return "text"


def cells_of(text: str) -> int:
    """Number of cells of a table row; 1 for other text."""
    if "\t" in text or "|" in text or ";" in text or "  " in text:
        cells = _CELLS.split(text.strip().strip("|"))
        if len(cells) >= 3 and sum(map(len, cells)) / len(cells) <= 24 and max(map(len, cells)) <= 60:
            return len(cells)
    if text.count(",") >= 2:
        cells = _COMMA_CELLS.split(text.strip())
        if len(cells) >= 3 and sum(bool(_VALUE.fullmatch(c)) for c in cells) * 2 >= len(cells) - 1:
            return len(cells)
    return 1


def measure(text: str, kind: str, lang: str) -> tuple[list[float], int]:
    """(STATS but for common words, whether it starts with a list mark) of a block."""
    n = max(1, len(text))
    plain = text.isascii()
    unspaced = 0 if plain else len(_UNSPACED.findall(text))
    cells = cells_of(text)
    words = (text if cells == 1 else _SEPARATORS.sub(" ", text)).split()
    count = max(1, len(words)) if unspaced * 2 < n else max(1, unspaced // 2)
    latin = lang in ("en", "de", "fr", "es")
    if plain:
        raw = text.encode()
        letters, n_vowels = len(raw.translate(None, _NO_LETTERS)) if latin else 0, len(raw.translate(None, _NO_VOWELS))
        symbols, digits = len(raw.translate(None, _NO_SYMBOLS)) / n, len(raw.translate(None, _NO_DIGITS)) / n
    else:
        letters, n_vowels = len(_LATIN.findall(text)) if latin else 0, len(_VOWELS.findall(text)) if latin else 0
        symbols = (len(_SYMBOLS.findall(text)) + 2 * len(_MOJIBAKE.findall(text))) / n
        digits = len(_DIGITS.findall(text)) / n
    vowels = n_vowels / letters if letters >= 4 else 0.4
    m = _LAST_END.match(text)
    ended = m.end() / n if m else 0.0
    length = (n - len(words) + 1) / count if not unspaced else 2.0
    longest = max(map(len, words), default=0) if not unspaced else 8
    return [math.log1p(count), min(length, 60.0), math.log1p(longest), symbols, digits, vowels, ended, 0.0, math.log(cells), 1.0 if kind in ("list", "table") else 0.0], int(bool(_MARKER.match(text)))


MEASURED = "file_id bigint, block_id bigint, kind string, chars bigint, lang string, marker int, words bigint, word_count int, held array<int>, " + ", ".join(f"{s} double" for s in STATS)


def measured(blocks: DataFrame) -> DataFrame:
    """STATS of every block but for common words, and ``held``, its words as hashes; ``words`` counts words, ``word_count`` is what the table says."""
    names = [x.split()[0] for x in MEASURED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            kinds = [kind_of(k) if not level else "heading" for k, level in zip(batch.column("kind").to_pylist(), batch.column("head_level").to_pylist())]
            vocabulary, code, block = numbered([tokens(t) for t in texts])
            word = np.array([w not in (".", BREAK) for w in vocabulary], bool)[code]
            code, block = code[word], block[word]
            langs = [LANGUAGES[i] for i in language_votes(vocabulary, code, block, len(texts))]
            hashes = pd.util.hash_array(np.array(vocabulary, object), categorize=False).astype(np.uint32).view(np.int32)
            held = pa.ListArray.from_arrays(pa.array(np.searchsorted(block, np.arange(len(texts) + 1)), pa.int32()), pa.array(hashes[code]))
            rows = [measure(t, k, lang) for t, k, lang in zip(texts, kinds, langs)]
            x = np.array([r[0] for r in rows], np.float64).reshape(-1, len(STATS))
            yield pa.record_batch(
                [batch.column("file_id"), batch.column("block_id"), pa.array(kinds, pa.string()), pa.array([len(t.strip()) for t in texts], pa.int64()), pa.array(langs, pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array(np.rint(np.expm1(x[:, 0])).astype(np.int64)), batch.column("word_count"), held, *(pa.array(x[:, i]) for i in range(len(STATS)))],
                names,
            )

    b = blocks.where("file_id is not null and block_id is not null and text is not null").select("file_id", "block_id", "text", "kind", F.col("head_level").cast("int").alias("head_level"), F.col("word_count").cast("int").alias("word_count"))
    return b.mapInArrow(run, MEASURED).dropDuplicates(["file_id", "block_id"])


def _held(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of the row that holds it)."""
    lists = batch.column("held")
    return np.asarray(lists.flatten()), np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))


def common_words(rows: DataFrame) -> dict[str, np.ndarray]:
    """Language -> hashes of the words that stand in at least COMMON of its blocks, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, lang = np.unique(np.array(batch.column("lang").to_pylist(), object), return_inverse=True)
            word, row = _held(batch)
            _, one = np.unique(row << 32 | word.view(np.uint32), return_index=True)
            seen, n = np.unique(lang[row[one]] << 32 | word.view(np.uint32)[one], return_counts=True)
            of = np.concatenate([seen >> 32, np.arange(len(langs))])
            hashes = np.concatenate([(seen & 0xFFFFFFFF).astype(np.uint32).view(np.int32).astype(np.int64), np.full(len(langs), ALL)])
            yield pa.record_batch([pa.array(langs[of], pa.string()), pa.array(hashes), pa.array(np.concatenate([n, np.bincount(lang, minlength=len(langs))]))], ["lang", "word", "n"])

    n = rows.select("lang", "held").mapInArrow(run, "lang string, word bigint, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    total = n.where(F.col("word") == ALL).select("lang", F.col("n").alias("total"))
    out: dict[str, list[int]] = {}
    for r in n.where(F.col("word") != ALL).join(F.broadcast(total), "lang").where(F.col("n") >= COMMON * F.col("total")).select("lang", "word").collect():  # bounded by COMMON; one row a language is sent
        out.setdefault(r["lang"], []).append(r["word"])
    return {lang: np.array(sorted(ws), np.int32) for lang, ws in out.items()}


ALL = 1 << 40  # stands for the blocks themselves among the words


def with_common(rows: DataFrame, known: dict[str, np.ndarray]) -> DataFrame:
    """``common`` filled in: the share of common words in each block; the words are dropped. The lists are bounded, see COMMON."""
    names = [c for c in rows.columns if c != "held"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            word, row = _held(batch)
            hit = np.zeros(len(word), bool)
            for lang in set(langs) & known.keys():
                at = (langs == lang)[row]
                place = np.minimum(np.searchsorted(known[lang], word[at]), len(known[lang]) - 1)
                hit[at] = known[lang][place] == word[at]
            share = np.bincount(row, hit, len(langs)) / np.maximum(1, np.bincount(row, minlength=len(langs)))
            yield pa.record_batch([pa.array(share) if n == "common" else batch.column(n) for n in names], names)

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "held"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([np.asarray(batch.column(s)) for s in STATS], axis=1) if batch.num_rows else np.zeros((0, len(STATS)))


Model = dict[str, tuple[np.ndarray, np.ndarray]]  # language -> mean and inverse covariance; "" stands for languages that weren't seen


def _contributions(x: np.ndarray, langs: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(differences from the mean of prose, contributions to the squared distance) of each row."""
    d, parts_ = np.zeros_like(x), np.zeros_like(x)
    default = model.get("", (np.zeros(len(STATS)), np.eye(len(STATS))))
    for lang in set(langs):
        at = langs == lang
        mean, inv = model.get(lang, default)
        d[at] = x[at] - mean
        parts_[at] = d[at] * (d[at] @ inv)
    return d, parts_


def moments(rows: DataFrame, model: Model | None = None) -> dict[str, tuple[int, np.ndarray, np.ndarray]]:
    """Language -> (n, mean, covariance) of STATS, of the rows within CUTOFF of the model if there is one."""
    size = len(STATS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, x = np.array(batch.column("lang").to_pylist(), object), _matrix(batch)
            if model is not None:
                core = _contributions(x, langs, model)[1].sum(1) <= CUTOFF
                langs, x = langs[core], x[core]
            for lang in set(langs):
                y = x[langs == lang]
                sums[lang] = sums.get(lang, 0.0) + np.concatenate([[len(y)], y.sum(0), (y.T @ y).ravel()])
        for lang, v in sums.items():
            yield pa.record_batch([pa.array([lang] * len(v)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], ["lang", "k", "v"])

    out: dict[str, np.ndarray] = {}
    for r in rows.select("lang", *STATS).mapInArrow(run, "lang string, k int, v double").groupBy("lang", "k").agg(F.sum("v").alias("v")).collect():  # (1 + size + size^2) numbers a language
        out.setdefault(r["lang"], np.zeros(1 + size + size * size))[r["k"]] = r["v"]
    return {lang: (int(v[0]), v[1 : 1 + size] / v[0], v[1 + size :].reshape(size, size) / v[0] - np.outer(v[1 : 1 + size], v[1 : 1 + size]) / v[0] ** 2) for lang, v in out.items()}


def inverses(found: dict[str, tuple[int, np.ndarray, np.ndarray]]) -> Model:
    """The model of these moments, each language's mixed with PRIOR blocks of all languages."""
    floor = np.diag(np.square(_FLOOR))
    if not found:
        return {}
    total = sum(n for n, _, _ in found.values())
    mean_all = sum(n * m for n, m, _ in found.values()) / total
    cov_all = sum(n * (c + np.outer(m - mean_all, m - mean_all)) for n, m, c in found.values()) / total
    out = {"": (mean_all, np.linalg.inv(cov_all + floor))}
    for lang, (n, m, c) in found.items():
        w = n / (n + PRIOR)
        mean = w * m + (1 - w) * mean_all
        cov = w * (c + np.outer(m - mean, m - mean)) + (1 - w) * (cov_all + np.outer(mean_all - mean, mean_all - mean))
        out[lang] = (mean, np.linalg.inv(cov + floor))
    return out


def distances(rows: DataFrame, model: Model) -> DataFrame:
    """Adds ``contributions`` (one per statistic), their sum ``distance``, and ``garbled``, what statistics contribute that lie on the side of junk. The model has one entry per language and is sent along."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, x = np.array(batch.column("lang").to_pylist(), object), _matrix(batch)
            d, parts_ = _contributions(x, langs, model)
            garbled = (np.maximum(parts_, 0) * (d * _BAD > 0)).sum(1)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(parts_.ravel()), len(STATS)).cast(pa.list_(pa.float64()))
            yield pa.record_batch([*(batch.column(n) for n in names), lists, pa.array(parts_.sum(1)), pa.array(garbled)], [*names, "contributions", "distance", "garbled"])

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", contributions array<double>, distance double, garbled double")


def natures(blocks: DataFrame) -> DataFrame:
    """Every block with its statistics, distance, contributions and nature (heading, prose, list, table, junk).

    Null texts, files or ids give no row; a block that is loaded again counts once; null kinds are text; null or false word counts don't matter, words are counted.
    Empty texts are lists of no length. Other columns are ignored.
    """
    raw = durable(measured(blocks), "quality")
    rows = durable(with_common(raw, common_words(raw)), "quality-statistics")
    body = rows.where("kind <> 'heading'").select("lang", *STATS)
    # plainly prose: sentences, or a longer text of a script that doesn't mark them
    model = inverses(moments(rows.where("kind <> 'heading'").where("(ended >= 0.8 and words >= 6 and cells = 0 and symbols < 0.05 and vowels > 0.25) or (lang = 'th' and words >= 20 and kind = 'text')")))
    for _ in range(STEPS):
        model = inverses(moments(body, model)) or model
    nature = F.when(F.col("kind") == "heading", "heading").when(F.col("distance") <= CUTOFF, "prose").when(F.col("garbled") >= JUNK, "junk").when((F.col("contributions")[STATS.index("cells")] >= JUNK) | (F.col("kind") == "table"), "table").otherwise("list")
    return distances(rows, model).withColumn("nature", nature).drop("garbled")


def file_natures(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """(file_id, nature, share) of the files not in html: the nature that holds more than half of the characters, headings aside, else prose."""
    kinds = ("list", "table", "junk")
    sums = natures(blocks).where("nature <> 'heading'").groupBy("file_id").agg(F.sum("chars").alias("chars"), *(F.sum(F.when(F.col("nature") == k, F.col("chars")).otherwise(0)).alias(k) for k in kinds))
    f = files.where("file_id is not null").groupBy("file_id").agg(F.max(F.lower(F.trim("file_format"))).alias("fmt")).where("fmt is null or fmt <> 'html'")
    nature = F.lit("prose")
    for k in kinds:
        nature = F.when(F.col(k) * 2 > F.col("chars"), k).otherwise(nature)
    return sums.join(f, "file_id").select("file_id", nature.alias("nature"), F.round(F.greatest(*(F.col(k) for k in kinds)) / F.greatest("chars", F.lit(1)), 6).alias("share"))


def p4_found(spark, sf_dir: str) -> DataFrame:
    return file_natures(table(spark, sf_dir, "files"), table(spark, sf_dir, "blocks")).where("nature <> 'prose'").select("file_id", "nature").distinct()


def p4_blocks(spark, sf_dir: str) -> DataFrame:
    """Nature and distance of every block, with the three statistics that contribute most."""
    top = F.slice(F.sort_array(F.transform(F.arrays_zip(F.array(*(F.lit(s) for s in STATS)).alias("stat"), F.col("contributions")), lambda x: F.struct(x["contributions"].alias("by"), x["stat"].alias("stat"))), asc=False), 1, 3)
    return natures(table(spark, sf_dir, "blocks")).select("file_id", "block_id", "nature", F.round("distance", 4).alias("distance"), F.array_join(F.transform(top, lambda x: x["stat"]), ",").alias("why"))
