"""Helpers shared by the training-data operators: tables, files with their blocks, languages, scripts."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(texts: list, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Cuts a batch into runs of rows whose texts hold about ``most`` characters, so that memory follows bytes, not rows."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


BLOCK_FIELDS = ("pos", "block_id", "text", "kind", "head_level")


SEGMENT, CONTEXT = 4096, 200  # blocks of a file that are handled together, and more of them on either side that are only looked at
LAST = 2**31 - 1  # stands for a null position


def has_long_files(blocks: DataFrame) -> bool:
    """Whether any file has more than a segment."""
    return (blocks.agg(F.max("pos")).first()[0] or 0) >= SEGMENT


def files_with_blocks(files: DataFrame, blocks: DataFrame, extra: tuple[str, ...] = (), long: bool = True) -> DataFrame:
    """One row per segment of a file that has blocks: its format, the named extra columns of ``files``, its number, how many segments the file has, the position of
    the file's heading (the first block of level 1 that isn't the title element), and the blocks as a list of structs.

    A segment is a run of SEGMENT positions with CONTEXT more before and behind, so that no task collects more, however large a file is; nearly every file is one segment. What is
    decided from a block's surroundings looks no further than CONTEXT, so segments give what whole files would. Segments, not files, are
    spread over the tasks. One shuffle of the blocks; repeated loads of a block are left in (``unnest`` drops them).
    A repeated file_id in ``files`` counts once; blocks without a file are dropped, as nothing is known of them; null positions belong to the first segment.
    long: what ``has_long_files`` says; if there are none, the same comes out of a shorter plan.
    """
    there = blocks.where(F.col("file_id").isNotNull() & F.col("text").isNotNull())
    f = files.where(F.col("file_id").isNotNull()).groupBy("file_id").agg(F.max(F.lower(F.trim("file_format"))).alias("file_format"), *(F.max(c).alias(c) for c in extra))
    heading = F.min(F.when((F.col("head_level") == 1) & (F.coalesce(F.lower("kind"), F.lit("")) != "title"), F.coalesce("pos", F.lit(LAST)))).alias("heading")
    gathered = F.collect_list("b").alias("blocks")
    if not long:  # every file is one segment: the same with one key less
        b = there.select("file_id", "head_level", "kind", "pos", F.struct(*BLOCK_FIELDS).alias("b")).groupBy("file_id").agg(gathered, heading)
        return b.join(f, "file_id").withColumn("segment", F.lit(0)).withColumn("segments", F.lit(1))
    at = lambda shift: F.coalesce(F.floor((F.col("pos") + shift) / SEGMENT), F.lit(0)).cast("int")
    spans = there.groupBy("file_id").agg(F.max(at(0)).alias("z"), heading)
    f = f.join(spans, "file_id").select("*", F.explode(F.sequence(F.lit(0), "z")).alias("segment"), (F.col("z") + 1).alias("segments")).drop("z")
    seen = F.array_distinct(F.array(at(-CONTEXT), at(0), at(CONTEXT)))
    b = there.select("file_id", F.explode(seen).alias("segment"), F.struct(*BLOCK_FIELDS).alias("b")).groupBy("file_id", "segment").agg(gathered)
    return b.join(f, ["file_id", "segment"])


def own(segment: int, positions: list[int | None], size: int) -> list[bool]:
    """Which blocks of a segment of ``size`` are its own, not context."""
    return [(p or 0) // size == segment for p in positions]


def listed(column: pa.Array) -> list:
    """to_pylist, which makes a scalar of each value, in one step where nothing is null."""
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


def unnest(batch: pa.RecordBatch, fields: tuple[str, ...] = ("pos", "text", "kind", "head_level")) -> tuple[list[int], dict[str, list], list[slice]]:
    """File ids, the named columns of the distinct blocks, file by file and by position, and where each file's blocks stand in them."""
    lists = batch.column("blocks")
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    offsets = np.asarray(lists.offsets) - lists.offsets[0].as_py()
    flat = lists.flatten()
    cols = {n: flat.field(n) for n in {"pos", "block_id", *fields}}
    owner = np.repeat(np.arange(len(lists)), np.diff(offsets))
    ids = cols["block_id"].fill_null(-1).to_numpy(zero_copy_only=False)
    pos = cols["pos"].fill_null(2**31 - 1).to_numpy(zero_copy_only=False)
    order = np.lexsort((ids, pos, owner))
    if len(order):
        o, i = owner[order], ids[order]
        order = order[np.concatenate([[True], (o[1:] != o[:-1]) | (i[1:] != i[:-1]) | (i[1:] == -1)])]
    bounds = np.searchsorted(owner[order], np.arange(len(lists) + 1))
    taken = pa.array(order)
    return batch.column("file_id").to_pylist(), {n: listed(cols[n].take(taken)) for n in fields}, list(map(slice, bounds[:-1].tolist(), bounds[1:].tolist()))


# Frequent function words that tell the Latin-script languages of the corpus apart.
FUNCTION_WORDS = {
    "en": "the of and to in is was were that for it with as on by from at this be are not an or had has but they we you she he his her their which who our your my its all if so".split(),
    "de": "der die das und ist nicht ein eine einen den dem mit von zu für im auf des wurde wird sich er sie es am bei seit trotz ohne nach laut wie zum zur hat kam war noch fehlt".split(),
    "fr": "le la les et un une des du est dans pour que qui sur avec pas au aux ce cette il elle sont par plus nous vous depuis sans selon comme malgré notre près".split(),
    "es": "el los las y un una unos del es en para que con por no se al lo su como más este esta desde según sin nuestro sigue cada cerca durante hasta".split(),
}
_LATIN = {w: lang for lang, ws in FUNCTION_WORDS.items() for w in ws if sum(w in v for v in FUNCTION_WORDS.values()) == 1}
# Code points of the scripts, first and last.
_RANGES = (("ja", 0x3040, 0x30FF), ("zh", 0x4E00, 0x9FFF), ("th", 0x0E00, 0x0E7F), ("hi", 0x0900, 0x097F), ("ar", 0x0600, 0x06FF), ("ru", 0x0400, 0x04FF))
_WORDS = re.compile(r"[^\W\d_]+")


def language(text: str) -> str:
    """ISO code of the language of a text by script, and by function words within Latin script; '' where neither tells."""
    words = western_words(text)
    if words is None:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        points = points[points > 0xFF]
        if len(points):
            n = {lang: int(np.count_nonzero((points >= a) & (points <= b))) for lang, a, b in _RANGES}
            total = sum(n.values())
            # names in Latin letters are common within other scripts
            if total and total >= 0.3 * len(_ASCII_LETTERS.findall(text)):
                top = max(n, key=n.get)
                return "ja" if top == "zh" and n["ja"] * 20 >= n["zh"] else top
        words = _WORDS.findall(text.lower())
    votes: dict[str, int] = {}
    for lang in [_LATIN[w] for w in _LATIN.keys() & set(words)]:
        votes[lang] = votes.get(lang, 0) + 1
    return max(sorted(votes), key=votes.get) if votes else ""


_LETTERS_ONLY = bytes(ord(chr(i).lower()) if i < 128 and chr(i).isalpha() else 32 for i in range(256))
_CP1252_ONLY = bytes(i if _WORDS.match(bytes([i]).decode("cp1252", "replace")) else 32 for i in range(256))


def western_words(text: str) -> list[str] | None:
    """Lower-cased runs of letters, found on bytes, of a text that is ASCII but for the accents and quotes of western languages; None for others."""
    if text.isascii():
        return text.encode().translate(_LETTERS_ONLY).decode().split()
    try:
        return text.lower().encode("cp1252").translate(_CP1252_ONLY).decode("cp1252").split()
    except UnicodeEncodeError:
        return None


def letter_words(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    words = western_words(text)
    return _WORDS.findall(text.lower()) if words is None else words


_ASCII_LETTERS = re.compile(r"[A-Za-z]")
UNSPACED = re.compile(r"[぀-ヿ一-鿿฀-๿]")
_SPREAD = re.compile(r"([぀-ヿ一-鿿฀-๿])")


_ASCII_WORDS = re.compile("[a-z0-9]+")


def words_of(text: str) -> list[str]:
    """Lower-cased words; in scripts that don't write spaces each character counts as a word."""
    text = text.lower()
    if text.isascii():
        return _ASCII_WORDS.findall(text)
    text = unicodedata.normalize("NFKC", text).replace("­", "")
    if UNSPACED.search(text):
        text = _SPREAD.sub(r" \1 ", text)
    return re.findall(r"[^\W_]+[ऀ-ॿัิ-ฺ็-๎]*", text)


LANGUAGES = ("", *FUNCTION_WORDS, *(lang for lang, _, _ in _RANGES))


def language_votes(vocabulary: list[str], code: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Number in LANGUAGES of the language of each document, by the scripts and function words of its words (numbers in ``vocabulary``); English where neither tells."""
    first = np.array([ord(w[0]) for w in vocabulary], np.int64)
    kind = np.array([LANGUAGES.index(_LATIN[w]) if w in _LATIN else 0 for w in vocabulary], np.int64)
    size = np.array([len(w) for w in vocabulary], np.int64)
    letters = np.where((first >= 97) & (first <= 122), size, 0)
    for lang, a, b in _RANGES:
        kind[(first >= a) & (first <= b)] = LANGUAGES.index(lang)
    script = kind >= len(FUNCTION_WORDS) + 1
    votes = np.bincount(doc * len(LANGUAGES) + kind[code], np.where(script, size, 1)[code], docs * len(LANGUAGES)).reshape(docs, -1).astype(np.int64)
    votes[:, 0] = 0
    cut = len(FUNCTION_WORDS) + 1
    scripts, total = votes[:, cut:], votes[:, cut:].sum(1)
    foreign = (total > 0) & (total >= 0.3 * np.bincount(doc, letters[code], docs))
    top = cut + scripts.argmax(1)
    ja, zh = LANGUAGES.index("ja"), LANGUAGES.index("zh")
    top = np.where((top == zh) & (votes[:, ja] * 20 >= votes[:, zh]), ja, top)
    latin = np.where(votes[:, :cut].any(1), votes[:, :cut].argmax(1), LANGUAGES.index("en"))
    return np.where(foreign, top, latin).astype(np.int8)


ENDS = frozenset(".!?。！？।؟…")
_URL = re.compile(r"(?:https?://|www\.)[^\s)\"'>\]]+|<a\s[^>\n]{0,2000}>|</a>", re.I)
BREAK = "\x02"  # the token of a line's end; "." is that of all end marks
_ASCII_TOKENS = bytes(10 if i == 10 else 46 if chr(i) in ".!?" else ord(chr(i).lower()) if i < 128 and chr(i).isalnum() else 32 for i in range(256))
_TOKENS = re.compile(r"[぀-ヿ一-鿿]|[ก-ะาำเ-ๆ๐-๙][ัิ-ฺ็-๎]*|[^\W_぀-ヿ一-鿿฀-๿]+[ऀ-ॏ]*(?:[^\W_฀-๿]+[ऀ-ॏ]*)*|[.!?。！？।؟…]+|\n")


def tokens(text: str) -> list[str]:
    """Lower-cased words, "." for runs of end marks, and a token for the end of each line; in unspaced scripts each character is a word."""
    if "://" in text or "www." in text or "<a " in text:
        text = _URL.sub(" ", text)
    if text.isascii():
        return text.encode().replace(b"\x02", b" ").translate(_ASCII_TOKENS).replace(b".", b" . ").replace(b"\n", b" \x02 ").decode().split()
    text = unicodedata.normalize("NFKC", text.lower()).replace("­", "")
    return [BREAK if w == "\n" else "." if w[0] in ENDS else w for w in _TOKENS.findall(text)]


def numbered(each: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(vocabulary, number in it of each word, number of the text that each word stands in) of texts that are cut into words."""
    flat = [w for x in each for w in x]
    number = dict.fromkeys(flat)
    for i, w in enumerate(number):
        number[w] = i
    return list(number), np.fromiter(map(number.__getitem__, flat), np.int64, len(flat)), np.repeat(np.arange(len(each)), [len(x) for x in each])
