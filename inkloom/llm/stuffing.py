"""Problem 8: pages of repeated keywords, links or tags, by pointwise mutual information of neighbouring words.

Every page is cut into windows of some thirty words, whatever its lines look like, and every window is judged by statistics of the
whole corpus, counted language by language:

* repeated collocations: a word (in unspaced scripts a pair of characters) that recurs within ``REACH`` words of itself, that the page holds at least
  ``MENTIONS`` times (``SENTENCES`` times apart from repeated sentences), and that isn't common in the language's documents. A window of which such words make up ``STUFFED`` or more is
  stuffed. Repeated sentences count once when recurrences are sought, so that a refrain makes no keyword;
* mean PMI of neighbouring words: pages half of whose text lies ``SALAD`` standard deviations under the pages of their language are word salad;
* lines of captions, links and tags are told by their form; they hold no sentences at all. Other lines without an end mark are honest only
  if the language's common words stand in them.

A page is flagged if more than half of its characters, headings aside, is such matter.

Texts are read and cut into words once. What is kept of them, a row per chunk of some CHUNK characters (words as numbers, and the chunk's distinct words and
pairs with their counts), is written to the shared folder; the counts of all chunks are summed by key and brought back to the chunks that hold the
key. So only distinct words and pairs of a chunk are shuffled, never those of single documents; no key is hotter than there are chunks.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.llm.common import BREAK, ENDS, LANGUAGES, UNSPACED, language_votes, numbered, parts, table, tokens
from inkloom.llm.mixing import durable

CHUNK = 4_000_000  # characters of the texts that are counted together
REACH, REACH_UNSPACED = 10, 20  # words, characters
MENTIONS, SENTENCES = 5, 3  # times that a page must hold a keyword, and its different sentences
COMMON = 0.2  # share of a language's documents from which on a word is common
STUFFED = 0.34  # share of a window in recurring keywords
PLAIN = 0.12  # share of common words that makes prose of a line without marks
SALAD = 4.0  # standard deviations of the pages' mean PMI in their language
LEAST_SD = 0.5  # of that standard deviation, natural logarithm
WINDOW = 30  # words
LEAST_PAIRS = 8  # of a window whose mean PMI is judged
MIN_SHARE = 0.5  # of the page's text, headings aside
NO_ID = -(1 << 63)  # of documents without one, which count in the corpus
RUN = 5  # lines of titles or keywords in a row that are more than a heading or a signature

LINK = re.compile(r"!?\[[^\]\n]{0,1000}\]\([^)\n]{0,2000}\)|<a\s[^>]{0,2000}>.*?(?:</a>|$)|(?:https?://|www\.)\S+", re.I)  # bounded, so that time is linear in a line
_SENTENCE = re.compile(r"[^.!?。！？।؟…]*[.!?。！？।؟…]+[\"'”’»」』)\]]*(?=\s|$|[^\x00-\xff])")
_SAID = re.compile(r"(?s).*[.!?。！？।؟…]+[\"'”’»」』)\]]*(?=\s|$|[^\x00-\xff])")
_HEADING = re.compile(r"\s*#{1,6}\s+\S")
_LIST = re.compile(r"\s*(?:[-*+]|\d{1,3}[.)])\s+")
_BULLET = re.compile(r"\s*[★☆»>•·▪►✓✔|]")
_TAGS = re.compile(r"(?:^|[\s,])(?:#[^\s#,]+|tag/[^\s,]+)")
_TAG_LINE = re.compile(r"\s*(?:tags?|keywords?|labels?)\s*:", re.I)
_SEPARATOR = re.compile(r"[,，、/|·»;•]|\s[-–—>]\s")
_THAI = re.compile(r"[฀-๿]")

# forms of lines; of the matter of the first two and the last statistics decide alone
SAID, ENTRY, LISTED, LINKED, LOOSE, HEADING = range(6)


def forms(text: str) -> tuple[list[int], list[int]]:
    """(form, characters) of every line of a text."""
    form: list[int] = []
    size: list[int] = []
    run: list[int] = []

    def flush() -> None:
        if len(run) >= RUN:
            for i in run:
                form[i] = LISTED
        run.clear()

    for line in text.split("\n"):
        line = line.strip()
        n = len(line)
        size.append(n)
        if not n:
            form.append(HEADING)
            continue
        if line[0] == "#" and _HEADING.match(line):
            kind = HEADING
        elif "://" in line or "www." in line or "<a " in line:
            rest = LINK.sub(" ", line)
            last = _SAID.match(rest)
            said = sum(len(m.group().split()) for m in _SENTENCE.finditer(rest, 0, last.end())) if last else 0
            kind = SAID if said >= 6 or said >= 2 and len(rest) > 0.5 * n else LINKED
        elif ("#" in line or "tag/" in line or ":" in line) and (_TAG_LINE.match(line) or len(_TAGS.findall(line)) >= max(1, 0.6 * len(line.split()))):
            kind = LINKED
        elif line[-1] in ENDS or (m := _SAID.match(line)) and m.end() >= 0.5 * n:
            kind = SAID
        elif _BULLET.match(line):
            kind = LOOSE if line.count(" ") >= 6 or len(line) > 40 and UNSPACED.search(line) else LISTED
        elif len(_SEPARATOR.findall(line)) >= 4:
            kind = LISTED
        elif _LIST.match(line) or len(_THAI.findall(line)) > 0.5 * n:
            kind = ENTRY
        elif line.count(" ") >= 14 or len(line) > 60 and UNSPACED.search(line):
            kind = LOOSE
        else:
            run.append(len(form))
            form.append(ENTRY)
            continue
        flush()
        form.append(kind)
    flush()
    return form, size


def _key(hashes: np.ndarray, after: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = hashes * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + after
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _ids(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, values = pd.factorize(x)
    return codes, np.asarray(values)


def _starts(x: np.ndarray) -> np.ndarray:
    """Places at which a new value begins."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]]))


PAYLOAD = (("docs", np.int64), ("langs", np.int8), ("lines", np.int64), ("linked", np.int64), ("words", np.int32), ("doc_words", np.int64), ("window_words", np.int64), ("window_doc", np.int32), ("window_form", np.int8), ("window_chars", np.float64), ("hits", np.uint8), ("pair_hits", np.uint8))


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    raw = b"".join(np.ascontiguousarray(arrays[n], t).tobytes() for n, t in PAYLOAD)
    return struct.pack(f"<{len(PAYLOAD) + 1}q", *(len(arrays[n]) for n, _ in PAYLOAD), len(raw)) + pa.compress(raw, "zstd", asbytes=True)


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    head = 8 * (len(PAYLOAD) + 1)
    *sizes, raw = struct.unpack(f"<{len(PAYLOAD) + 1}q", data[:head])
    buf = pa.decompress(data[head:], raw, "zstd", asbytes=True)
    out, at = {}, 0
    for (n, t), k in zip(PAYLOAD, sizes):
        out[n] = np.frombuffer(buf, t, k, at)
        at += k * np.dtype(t).itemsize
    return out


def study(ids: list[int], texts: list[str]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(what is kept of a chunk of texts, its keys, their counts, the documents that hold them). Words are numbers of keys; pairs follow them, in the order in which they occur."""
    each = [[*tokens(t), BREAK] for t in texts]
    shape = [forms(t) for t in texts]
    vocabulary, codes, doc = numbered(each)
    number = {w: vocabulary.index(w) for w in (BREAK, ".") if w in vocabulary}
    is_break, is_mark = (np.zeros(len(vocabulary), bool) for _ in range(2))
    is_break[number[BREAK]] = True
    if "." in number:
        is_mark[number["."]] = True
    ends = is_break[codes]
    line = np.cumsum(ends) - ends
    gap = ends | is_mark[codes]
    line_form, line_size = (np.array([x for s in shape for x in s[k]], np.int64) for k in (0, 1))
    line_doc = np.repeat(np.arange(len(texts)), [len(s[0]) for s in shape])
    words = ~gap
    piece = np.cumsum(gap)[words]
    code, doc, line = codes[words], doc[words], line[words]
    lang_of = language_votes(vocabulary, code, doc, len(texts))
    wide = np.array([UNSPACED.match(v) is not None for v in vocabulary])[code]

    # (language, word) and pairs of neighbours
    word, distinct = _ids(lang_of[doc].astype(np.int64) * len(vocabulary) + code)
    hashes = pd.util.hash_array(np.array(vocabulary, object), categorize=False)
    key = _key(hashes[distinct % len(vocabulary)], (distinct // len(vocabulary)).astype(np.uint64))
    first = np.flatnonzero(doc[1:] == doc[:-1])
    pair, pairs = _ids(word[first] * len(key) + word[first + 1])
    pair_key = _key(key[pairs // max(1, len(key))].view(np.uint64), key[pairs % max(1, len(key))].view(np.uint64))
    spread = wide[first] & wide[first + 1]
    langs = np.unique(lang_of)
    lang_key = _key(np.zeros(len(langs), np.uint64), langs.astype(np.uint64) + np.uint64(1))
    keys = np.concatenate([key, pair_key, lang_key])
    n = np.concatenate([np.bincount(word, minlength=len(key)), np.bincount(pair, minlength=len(pairs)), np.bincount(lang_of[doc], minlength=len(LANGUAGES))[langs]])
    df = np.concatenate([_holders(doc, word, len(key)), _holders(doc[first[spread]], pair[spread], len(pairs)), np.bincount(lang_of, minlength=len(LANGUAGES))[langs]])

    # recurrences, repeated sentences counted once
    start = _starts(piece)
    length = np.diff(np.append(start, len(piece)))
    place = np.arange(len(piece)) - np.repeat(start, length)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(hashes[code] * (2 * place.astype(np.uint64) + np.uint64(1)), start) if len(start) else np.zeros(0, np.uint64)
        same, _ = _ids((h * np.uint64(0x9E3779B97F4A7C15)) ^ doc[start].astype(np.uint64))
    origin = _starts_of(same)[same] if len(same) else same
    once = np.repeat(origin == np.arange(len(start)), length) & (line_form[line] != HEADING)
    unit = word.astype(np.int64)
    both = np.zeros(len(unit), bool)
    both[first] = spread
    of_pair = np.zeros(len(unit), np.int64)
    of_pair[first] = pair
    unit[both] = len(key) + of_pair[both]
    at = np.flatnonzero(once)
    every, _ = _ids(doc * (len(key) + len(pairs)) + unit)
    often = (np.bincount(every) >= MENTIONS)[every] if len(every) else np.zeros(0, bool)
    k = every[at]
    order = np.argsort(k, kind="stable")
    step = np.diff(order)
    step[k[order][1:] != k[order][:-1]] = len(unit) + REACH_UNSPACED
    near = np.full(len(at), len(unit) + REACH_UNSPACED)
    near[order[1:]] = step
    near[order[:-1]] = np.minimum(near[order[:-1]], step)
    hit = np.zeros(len(unit), bool)
    hit[at] = (near <= np.where(wide[at], REACH_UNSPACED, REACH)) & often[at] & (np.bincount(k)[k] >= SENTENCES if len(k) else False)
    hit = hit[np.repeat(start[origin], length) + place] if len(start) else hit

    # windows: runs of sentences of one form
    piece_form, piece_doc, piece_line = line_form[line[start]], doc[start], line[start]
    share = line_size[piece_line] * length / np.maximum(1, np.bincount(line, minlength=len(line_form)))[piece_line]
    run = np.cumsum(np.isin(np.arange(len(start)), _starts(piece_doc * 8 + piece_form))) - 1
    before = np.cumsum(length) - length
    before = before - before[_starts(run)][run] if len(run) else before
    window = _starts(run * (len(unit) + 1) + before // WINDOW)
    inside = np.zeros(len(start), np.int64)
    inside[window] = 1
    inside = np.cumsum(inside) - 1
    kept = {
        "docs": np.array(ids, np.int64),
        "langs": lang_of,
        "lines": np.bincount(line_doc, line_size * (line_form != HEADING), len(texts)),
        "linked": np.bincount(line_doc, line_size * (line_form == LINKED), len(texts)),
        "words": word,
        "doc_words": np.bincount(doc, minlength=len(texts)),
        "window_words": np.bincount(inside, length, len(window)),
        "window_doc": piece_doc[window],
        "window_form": piece_form[window],
        "window_chars": np.bincount(inside, share, len(window)),
        "hits": np.packbits(hit & ~both),
        "pair_hits": np.packbits(hit & both),
    }
    return kept, keys, n, df


def _holders(doc: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """Number of documents that hold each code."""
    return np.bincount(_ids(doc * n + code)[1] % max(1, n), minlength=n) if len(code) else np.zeros(n, np.int64)


def _starts_of(codes: np.ndarray) -> np.ndarray:
    """First place of each code 0, 1, 2, ..."""
    out = np.zeros(codes.max(initial=-1) + 1, np.int64)
    out[codes[::-1]] = np.arange(len(codes))[::-1]
    return out


def judged(kept: dict[str, np.ndarray], n: np.ndarray, df: np.ndarray) -> dict[str, np.ndarray]:
    """Shares of stuffed text and mean PMI of the documents of a chunk, from the counts of the whole corpus for the chunk's keys."""
    word, doc_words, lang = kept["words"].astype(np.int64), kept["doc_words"], kept["langs"].astype(np.int64)
    docs = len(doc_words)
    doc = np.repeat(np.arange(docs), doc_words)
    langs = np.unique(lang)
    of_lang = len(n) - len(langs) + np.searchsorted(langs, lang)
    n_lang, docs_lang = n[of_lang], df[of_lang]
    n_words = int(word.max(initial=-1)) + 1
    first = np.flatnonzero(doc[1:] == doc[:-1])
    pair, _ = _ids(word[first] * n_words + word[first + 1])
    pair = pair + n_words
    logs = np.log(np.maximum(n, 1))
    pmi = logs[pair] + np.log(n_lang)[doc[first]] - logs[word[first]] - logs[word[first + 1]]
    common = _surely(df[word], docs_lang[doc])
    common_pair = np.zeros(len(word), bool)
    common_pair[first] = _surely(df[pair], docs_lang[doc[first]])
    hit = _bits(kept["hits"], len(word)) & ~common | _bits(kept["pair_hits"], len(word)) & ~common_pair

    # the words of headings stand in no window
    sizes, window_doc, form, chars = kept["window_words"], kept["window_doc"], kept["window_form"], kept["window_chars"]
    window = np.repeat(np.arange(len(sizes)), sizes)
    total = np.maximum(1, sizes)
    sum_of = lambda x: np.bincount(window, x, len(sizes))
    crammed = sum_of(hit) >= STUFFED * total
    plain = sum_of(common) >= PLAIN * total
    stuffed_ = (form != HEADING) & (form != LINKED) & (crammed | (form == LISTED) | (form == LOOSE) & ~plain)
    second = window[first + 1]
    pairs = np.bincount(second, minlength=len(sizes))
    mean = np.bincount(second, pmi, len(sizes)) / np.maximum(1, pairs)
    body = (form != HEADING) & (form != LINKED)
    text = np.maximum(1, np.bincount(window_doc[body], chars[body], docs) + kept["linked"])
    of_doc = lambda x: np.bincount(window_doc, chars * x, docs) / text
    # the PMI under which half of the text lies, stuffed windows and links foremost
    rank = np.where(stuffed_, -np.inf, np.where(pairs >= LEAST_PAIRS, mean, np.inf))
    order = np.lexsort((rank, window_doc))
    order = order[body[order]]
    d = window_doc[order]
    summed = np.cumsum(chars[order])
    start = _starts(d)
    summed = summed - np.repeat((summed - chars[order])[start], np.diff(np.append(start, len(d)))) + kept["linked"][d]
    past = np.flatnonzero(summed > MIN_SHARE * text[d])
    middle = np.full(docs, np.inf)
    at = _starts(d[past])
    middle[d[past][at]] = rank[order][past][at]
    links = kept["linked"] / text
    n_pairs = np.bincount(doc[first + 1], minlength=docs)
    return {
        "doc_id": kept["docs"],
        "lang": lang,
        "odd_share": of_doc(stuffed_) + links,
        "link_share": of_doc((form == LISTED) & ~crammed) + links,
        "repeated": of_doc(crammed & body),
        "pairs": n_pairs,
        "mean_pmi": np.bincount(doc[first + 1], pmi, docs) / np.maximum(1, n_pairs),
        "middle_pmi": np.clip(middle, -1e9, 1e9),
    }


def _surely(df: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Whether a word is common: the lower bound (Wilson, 99 %) of its share of the documents, so that few documents prove little."""
    z = 2.58
    p = df / docs
    return (p + z * z / (2 * docs) - z * np.sqrt(p * (1 - p) / docs + (z / docs / 2) ** 2)) / (1 + z * z / docs) >= COMMON


def _bits(x: np.ndarray, size: int) -> np.ndarray:
    return np.unpackbits(x, count=size).astype(bool)


STUDY = "chunk string, payload binary, keys array<bigint>, n array<bigint>, df array<bigint>"
JUDGED = "doc_id bigint, lang bigint, odd_share double, link_share double, repeated double, pairs bigint, mean_pmi double, middle_pmi double"


def scores(documents: DataFrame) -> DataFrame:
    """JUDGED of every document that has a text: shares of stuffed matter and of links, tags and captions, share of windows of recurring keywords, mean PMI, and the PMI under which half of the page lies."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in parts(texts, CHUNK):
                kept, keys, n, df = study([NO_ID if i is None else i for i in ids[a:b]], texts[a:b])
                lists = (pa.array([x], pa.list_(pa.int64())) for x in (keys, n, df))
                yield pa.record_batch([pa.array([uuid.uuid4().hex]), pa.array([packed(kept)], pa.binary()), *lists], ["chunk", "payload", "keys", "n", "df"])

    chunks = durable(documents.where("text is not null").select("doc_id", "text").mapInArrow(read, STUDY), "stuffing")
    long = chunks.select("chunk", F.posexplode(F.arrays_zip("keys", "n", "df")).alias("k", "x")).select("chunk", "k", F.col("x.keys").alias("key"), F.col("x.n").alias("n"), F.col("x.df").alias("df"))
    totals = long.groupBy("key").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    counts = long.select("chunk", "k", "key").join(totals, "key").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("k", "n", "df"))).alias("counts"))  # as many as a chunk of CHUNK characters has

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("counts")
            for i in range(batch.num_rows):
                x = lists[i].values
                out = judged(unpacked(batch.column("payload")[i].as_py()), np.asarray(x.field("n")), np.asarray(x.field("df")))
                yield pa.record_batch([pa.array(v) for v in out.values()], list(out))

    return chunks.select("chunk", "payload").join(counts, "chunk").mapInArrow(judge, JUDGED)


def stuffed(documents: DataFrame) -> DataFrame:
    """(doc_id, odd_share, link_share, repeated, mean_pmi, reason) of pages made of keywords, links or tags.

    reason: `links` (links with at most captions, tags, and captions alone are most of the page), `repeated` (stuffed with recurring keywords), `salad` (its neighbours are as
    unlikely as no page of its language has them), `words` (a mixture, and words without marks).
    Null ids and null or empty texts give no row; a repeated row of a document counts again in the corpus counts and gives one row; other columns are ignored.
    """
    s = durable(scores(documents), "stuffing-scores")
    usual = s.where("pairs >= 20").groupBy("lang").agg((F.avg("mean_pmi") - SALAD * F.greatest(F.coalesce(F.stddev_pop("mean_pmi"), F.lit(0.0)), F.lit(LEAST_SD))).alias("least"))
    salad = F.coalesce(F.col("middle_pmi") < F.col("least"), F.lit(False))
    reason = F.when(F.col("link_share") > MIN_SHARE, "links").when(F.col("repeated") > MIN_SHARE, "repeated").when(F.col("odd_share") > MIN_SHARE, "words").when(salad, "salad")
    found = s.where(F.col("doc_id") != NO_ID).join(F.broadcast(usual), "lang", "left")  # one row a language
    return found.select("doc_id", "odd_share", "link_share", "repeated", F.when(F.col("pairs") > 0, F.col("mean_pmi")).alias("mean_pmi"), reason.alias("reason")).where("reason is not null").dropDuplicates(["doc_id"])


def p8_found(spark, sf_dir: str) -> DataFrame:
    return stuffed(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p8_reasons(spark, sf_dir: str) -> DataFrame:
    """Stuffed pages by reason, with their mean PMI."""
    return stuffed(table(spark, sf_dir, "documents")).groupBy("reason").agg(F.count("*").alias("documents"), F.round(F.avg("mean_pmi"), 6).alias("mean_pmi"), F.round(F.avg("repeated"), 6).alias("repeated"))
