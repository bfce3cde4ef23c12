"""Problem 6: passages of held-out evaluation items inside a corpus, by Wu-Manber multi-pattern search.

Every passage is cut into overlapping windows of a few normalised words; these windows are the patterns. A document is
scanned with a table of block shifts that skips positions at which no pattern can end, a hash of the window's last bytes
selects the patterns to test, and a direct comparison confirms each occurrence. Occurrences vote for (document, item);
for a pair whose occurrences could cover enough of the passage, the longest chain in passage order decides.

The corpus is scanned once and never shuffled; only the patterns travel. They are broadcast in blocks of a checked size
(``MAX_PATTERN_BYTES``), one scan per block, so a large evaluation set costs more scans, not more memory.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.llm.common import UNSPACED, parts, table
from inkloom.llm.mixing import durable

MAX_PATTERN_BYTES = 16_000_000
WINDOW_WORDS, WINDOW_CHARS = 4, 6  # words of a pattern; characters of one in unspaced scripts
M, B = 14, 6  # bytes of the scanned window, and of a block
TABLE = 1 << 20
_MUL = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = re.compile(r"([぀-ヿ一-鿿฀-๿])")
_GAPS = re.compile(r"[\W_]+")
_ASCII_GAPS = re.compile(rb"[^a-z0-9]+")


def normalised(text: str) -> bytes:
    """Lower-cased words between single spaces, with one before and one behind; characters of unspaced scripts are words."""
    if text.isascii():
        return b" " + _ASCII_GAPS.sub(b" ", text.lower().encode()).strip(b" ") + b" "
    text = unicodedata.normalize("NFKC", text).lower().replace("­", "")
    if UNSPACED.search(text):
        text = _SPREAD.sub(r" \1 ", text)
    return b" " + _GAPS.sub(" ", text).strip().encode() + b" "


def windows(words: list[bytes]) -> Iterator[tuple[int, int]]:
    """(first word, number of words) of the patterns of a passage; a passage without room for one is one as a whole."""
    found = False
    for i in range(len(words)):
        k = WINDOW_CHARS if len(words[i]) > 1 and words[i][0] >= 0xE0 and len(words[i]) <= 3 else WINDOW_WORDS
        while i + k <= len(words) and len(b" ".join(words[i : i + k])) + 2 < M:
            k += 1
        if i + k <= len(words):
            found = True
            yield i, k
    if words and not found:
        yield 0, len(words)


class Patterns:
    """The tables of the search: block shifts, buckets by window hash, the patterns' bytes, and the passage places of each pattern."""

    def __init__(self, places: dict[bytes, list[tuple[int, int, int]]], m: int = M, b: int = B):
        """places: pattern -> [(passage, first word, words)]; m: bytes of the scanned window, at most the shortest pattern's; b: bytes of a block."""
        self.m, self.b = m, b
        self.patterns = sorted(places)
        lengths = np.array([len(p) for p in self.patterns], np.int64)
        self.lengths, self.longest = lengths, int(lengths.max(initial=m))
        self.matrix = np.zeros((len(self.patterns), self.longest), np.uint8)
        for k, p in enumerate(self.patterns):
            self.matrix[k, : len(p)] = np.frombuffer(p, np.uint8)
        # shifts: how far a window may move if the block at its end is this one
        self.shift = np.full(TABLE, m - b + 1, np.uint8)
        heads = self.matrix[:, :m]
        for end in range(b - 1, m):
            np.minimum.at(self.shift, block_hash(heads, end, b), np.uint8(m - 1 - end))
        keys = window_key(heads, m)
        order = np.argsort(keys, kind="stable")
        self.keys, self.bucket_first, self.bucket_size = np.unique(keys[order], return_index=True, return_counts=True)
        self.bucket = order
        flat = [(k, *x) for k, p in enumerate(self.patterns) for x in places[p]]
        at = np.array(flat, np.int64).reshape(-1, 4)
        self.place_first = np.searchsorted(at[:, 0], np.arange(len(self.patterns) + 1))
        self.place_item, self.place_word, self.place_len = at[:, 1], at[:, 2], at[:, 3]

    def occurrences(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start in buf, pattern) of every occurrence of every pattern."""
        if len(buf) < self.m or not self.patterns:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends = self._candidates(buf)
        starts = ends - (self.m - 1)
        keys = window_key(buf, self.m, starts)
        slot = np.searchsorted(self.keys, keys)
        slot[slot == len(self.keys)] = 0
        ok = self.keys[slot] == keys
        starts, slot = starts[ok], slot[ok]
        size = self.bucket_size[slot]
        at = np.repeat(starts, size)
        pattern = self.bucket[np.repeat(self.bucket_first[slot], size) + ranges(size)]
        fits = at + self.lengths[pattern] <= len(buf)
        at, pattern = at[fits], pattern[fits]
        same = np.ones(len(at), bool)
        alive = np.arange(len(at))
        for j in range(self.longest):  # direct comparison, byte by byte, of those that still agree
            alive = alive[self.lengths[pattern[alive]] > j]
            if not len(alive):
                break
            bad = buf[at[alive] + j] != self.matrix[pattern[alive], j]
            same[alive[bad]] = False
            alive = alive[~bad]
        return at[same], pattern[same]

    def _candidates(self, buf: np.ndarray, lane: int = 1024) -> np.ndarray:
        """Window ends with shift 0. Many places of the buffer are scanned side by side, each skipping by its own shifts."""
        hashes = block_hashes(buf, self.b)  # of the block that ends at i
        pos = np.arange(self.m - 1, len(buf), lane)
        stop = np.minimum(pos + lane, len(buf))
        out = []
        while len(pos):
            s = self.shift[hashes[pos]]
            zero = s == 0
            out.append(pos[zero])
            pos = pos + np.where(zero, 1, s)
            live = pos < stop
            if not live.all():
                pos, stop = pos[live], stop[live]
        return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


class Items:
    """Passages and their patterns: those of at least M bytes in one search table, shorter ones (of passages of a few short words) in another."""

    def __init__(self, passages: Iterable[tuple[int, str]]):
        self.ids: list[int] = []
        self.words: list[int] = []
        long: dict[bytes, list[tuple[int, int, int]]] = defaultdict(list)
        short: dict[bytes, list[tuple[int, int, int]]] = defaultdict(list)
        for item_id, passage in passages:
            ws = normalised(passage).split()
            for i, k in windows(ws):
                pattern = b" " + b" ".join(ws[i : i + k]) + b" "
                (long if len(pattern) >= M else short)[pattern].append((len(self.ids), i, k))
            if ws:
                self.ids.append(item_id)
                self.words.append(len(ws))
        self.tables = [Patterns(long)] if long else []
        if short:
            self.tables.append(Patterns(short, min(map(len, short)), 2))

    def hits(self, buf: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start in buf, passage, first word, words) of every place of every pattern that occurs."""
        out = [np.zeros((4, 0), np.int64)]
        for t in self.tables:
            at, pattern = t.occurrences(buf)
            n = t.place_first[pattern + 1] - t.place_first[pattern]
            place = np.repeat(t.place_first[pattern], n) + ranges(n)
            out.append(np.stack([np.repeat(at, n), t.place_item[place], t.place_word[place], t.place_len[place]]))
        return tuple(np.concatenate(out, axis=1))


def ranges(sizes: np.ndarray) -> np.ndarray:
    total = int(sizes.sum())
    return np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def block_hash(rows: np.ndarray, end: int, b: int) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for j in range(end - b + 1, end + 1):
        h = h * np.uint64(257) + rows[:, j]
    return (h * _MUL) >> np.uint64(44)


def block_hashes(buf: np.ndarray, b: int) -> np.ndarray:
    h = np.zeros(len(buf), np.uint64)
    n = len(buf) - b + 1
    for j in range(b):
        h[b - 1 :] = h[b - 1 :] * np.uint64(257) + buf[j : j + n]
    return ((h * _MUL) >> np.uint64(44)).astype(np.uint32)


def window_key(rows: np.ndarray, m: int, starts: np.ndarray | None = None) -> np.ndarray:
    h = np.zeros(len(rows) if starts is None else len(starts), np.uint64)
    for j in range(m):
        h = h * np.uint64(0x100000001B3) + (rows[:, j] if starts is None else rows[starts + j])
    return h


def chain(hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The longest run of (text place, passage word, words) that advances in both."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(hits)
    hits = sorted(set(hits), key=lambda x: (x[0], -x[1]))
    for i, (_, w, _k) in enumerate(hits):
        j = bisect.bisect_left(tails, w)
        if j == len(tails):
            tails.append(w)
            at.append(i)
        else:
            tails[j], at[j] = w, i
        back[i] = at[j - 1] if j else -1
    out, i = [], at[-1]
    while i >= 0:
        out.append(hits[i])
        i = back[i]
    return out[::-1]


def covered(run: list[tuple[int, int, int]], bridge: int = 4) -> int:
    """Words of the passage in the run; a gap of at most ``bridge`` words that lies as close in the text is a light change, half of it counts."""
    total, end, last = 0, 0, None
    for p, w, k in run:
        gap = w - end
        if last is not None and 0 < gap <= bridge and p - last < 12 * (gap + 3):
            total += gap / 2
        total += max(0, w + k - max(end, w))
        end, last = max(end, w + k), p
    return total


def leaks(documents: DataFrame, items: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, item_id, share): items of which a document carries at least ``least`` of the passage, in its order.

    Null or empty texts and passages match nothing; a passage that is shorter than a pattern is one pattern as a whole, and is found where it stands whole; repeated
    rows of documents give repeated rows, repeated items one row; equal and nearly equal passages are all reported. Other columns are ignored.
    """
    items = items.select("item_id", "passage").where(F.col("item_id").isNotNull() & F.col("passage").isNotNull()).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("passage")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size * 30 / MAX_PATTERN_BYTES / 4))
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text").where(F.col("text").isNotNull())

    def scan(k: int) -> DataFrame:
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()  # bounded by MAX_PATTERN_BYTES
        sent = spark.sparkContext.broadcast(sorted((r[0], r[1]) for r in rows))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = None
            for batch in batches:
                known = known or Items(sent.value)
                ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
                for a, b in parts(texts):
                    doc, item, share = search(known, texts[a:b], least)
                    yield pa.record_batch([ids.slice(a, b - a).take(pa.array(doc, pa.int64())), pa.array(item, pa.int64()), pa.array(share, pa.float64())], ["doc_id", "item_id", "share"])

        found = docs.mapInArrow(run, "doc_id bigint, item_id bigint, share double")
        if blocks > 1:  # one block of patterns at a time is held by the driver and the tasks
            found = durable(found, "leaks")
            sent.destroy()
        return found

    return reduce(DataFrame.unionByName, [scan(k) for k in range(blocks)])


def search(known: Items, texts: list[str], least: float) -> tuple[list[int], list[int], list[float]]:
    norm = [normalised(t) for t in texts]
    size = np.array([len(x) + 1 for x in norm], np.int64)
    first = np.cumsum(size) - size
    at, item, word, k = known.hits(np.frombuffer(b"\n".join(norm), np.uint8))
    if not len(at):
        return [], [], []
    doc = np.searchsorted(first, at, "right") - 1
    # an upper bound of what each pair covers, before any order is looked at: the union of its patterns, and half as much again, as a gap
    # that ``covered`` bridges counts two words at most and follows a pattern of four at least
    pair = doc * len(known.ids) + item
    longest = int(max(known.words)) + 1
    key, one = np.unique(pair * longest + word, return_index=True)
    pairs, start, reach = key // longest, key % longest, k[one]
    step = np.append(np.where(pairs[1:] == pairs[:-1], start[1:] - start[:-1], longest), longest)[: len(key)]
    ids, begin = np.unique(pairs, return_index=True)
    most = np.add.reduceat(np.minimum(step, reach), begin)
    need = np.array(known.words)[ids % len(known.ids)]
    keep = np.isin(pair, ids[1.5 * most >= least * need])
    groups: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for p, t, w, kk in zip(pair[keep].tolist(), at[keep].tolist(), word[keep].tolist(), k[keep].tolist()):
        groups[p].append((t, w, kk))
    out: tuple[list[int], list[int], list[float]] = ([], [], [])
    for p, hits in groups.items():
        d, i = divmod(p, len(known.ids))
        share = covered(chain(hits)) / known.words[i]
        if share >= least:
            out[0].append(d)
            out[1].append(known.ids[i])
            out[2].append(min(1.0, share))
    return out


def p6_found(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


def p6_items(spark, sf_dir: str) -> DataFrame:
    """How many documents each leaked item is found in, and the largest share of its passage."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.round(F.max("share"), 6).alias("largest_share"))
