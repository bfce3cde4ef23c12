"""Problem 2: the main body of web pages, by minimum-cut labelling.

A classifier gives each block two costs, which become the capacities to the terminals; neighbouring blocks and blocks
that stand under the same section opener are joined by smoothness edges; the maximum flow, hence the minimum cut,
separates main body from boilerplate. Nodes whose own costs outweigh all their edges are settled first (they lie on that
side of every minimum cut); augmenting paths run on what is left of each page.

The classifier needs no labelled pages: files that aren't web pages hold no boilerplate, so wordings that recur in pages
but not in other files are boilerplate. Features are counted over all files. Wordings whose odds can't
reach BIAS are left out, as costs below BIAS all act alike; so the model holds at most MAX_FEATURES words and MAX_FEATURES wordings. Every page of the corpus is then labelled on its own; blocks are shuffled once, by file.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.llm import common
from inkloom.llm.common import CONTEXT, UNSPACED, files_with_blocks, has_long_files, letter_words, own, table, unnest
from inkloom.llm.mixing import durable

MAX_FEATURES = 500_000  # of either kind; bounds the memory of the driver and the tasks
BIAS = 1.0  # log-odds that subject words gain from teasers to other pages
LEAST_FILES = 4  # files that a feature must occur in
REACH = CONTEXT // 2  # blocks that can belong to the section of an opener

_NAME = re.compile(r"[A-ZÀ-ÞА-Я](?<=\S .)[\w'-]+")  # behind a word and a blank; the letter is looked for first
_LATIN = re.compile(r"[A-Za-z][\w'-]*")
_DIGIT = re.compile(r"\d")
_WORD = re.compile(r"[^\W\d_]+[ऀ-ॿ]*")
_MARKED = re.compile(r"[ऀ-ॿ]")
_CLOSING, _ENDS, _DOTS = "\"'”’»」』)]", tuple(".!?。！？।؟"), ("…", "...")
_BLANKS = bytes(32 if chr(i).isspace() else 46 for i in range(256))
_NAV = re.compile(r"\S(?:\s[·|>»]\s|\s{2,})\S")

Block = tuple  # (text, kind, head_level)


def is_unspaced(text: str) -> bool:
    return not text.isascii() and UNSPACED.search(text) is not None


def is_ended(text: str) -> bool:
    """It ends as a sentence, and isn't cut off."""
    text = text.rstrip()
    return text.rstrip(_CLOSING).endswith(_ENDS) and not text.endswith(_DOTS)


def is_prose(text: str) -> bool:
    """Whether a block reads as a sentence or more: it ends as one and is long enough."""
    return len(text) >= 12 and is_ended(text) and (len(text) >= 40 or is_unspaced(text))


def is_long(text: str) -> bool:
    """Prose of a length that teasers and notices don't have."""
    return len(text) >= 45 and is_ended(text) and (len(text) >= 150 or is_unspaced(text))


def wording_of(text: str) -> str:
    """A short block with names and digits blanked; '' for others."""
    if len(text) > 80:
        return ""
    return "=" + _DIGIT.sub("0", _LATIN.sub("N", text) if is_unspaced(text) else _NAME.sub("N", text).lower())


def words_in(texts: list[str]) -> set[str]:
    """The words of blocks; pairs of characters of those in scripts that don't write spaces."""
    out: set[str] = set()
    for text in texts:
        if is_unspaced(text):
            run = "".join(_WORD.findall(_LATIN.sub("", text.lower())))
            out.update(map("".join, zip(run, run[1:])))
        elif not text.isascii():
            out.update(_WORD.findall(text.lower()) if _MARKED.search(text) else letter_words(text))
    out.update(letter_words("\n".join([t for t in texts if t.isascii()])))
    return out


def is_navigation(text: str) -> bool:
    """Marks or gaps between its parts, and not prose."""
    if text.isascii() and "|" not in text and ">" not in text and b"  " not in text.encode().translate(_BLANKS):
        return False
    return _NAV.search(text) is not None and not is_prose(text)


def marks_of(text: str, level: int) -> list[str]:
    """What the classifier sees besides words: the heading level, and navigation marks."""
    return [*([f"#{level}"] if level else []), *(["#nav"] if is_navigation(text) else [])]


class Model:
    """Log-odds of features between web pages and other files, and how much prose follows a wording."""

    def __init__(self, rows: list[tuple], pages: int, others: int):
        self.odds = {f: math.log((h + 2) / (pages + 2)) - math.log((n + 2) / (others + 2)) for f, h, n, *_ in rows}
        self.openers = {f for f, _, _, k, prose in rows if f[0] == "=" and k >= LEAST_FILES and prose <= 0.45 * k and self.odds[f] > 2.0}

    def cost(self, words: set[str], marks: list[str]) -> float:
        """Positive: speaks for boilerplate. marks: the wording, and what ``marks_of`` gives."""
        odds = self.odds
        known = sorted([odds[w] for w in words if w in odds], reverse=True)
        # notices are short: in a long text the odd word proves nothing
        top = known[: max(2, len(known) // 3)] if len(known) <= 14 else known
        return max([sum(top) / len(top) - 0.3 if top else 0.0, *(odds[m] for m in marks if m in odds)])


def minimum_cut(unary: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """True for nodes on the source side of a minimum cut. unary > 0 is capacity from the source, < 0 to the sink; edges are undirected."""
    n = len(unary)
    u = list(unary)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), w in edges.items():
        if w > 0 and a != b:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    side: list[bool | None] = [None] * n
    todo = list(range(n))
    while todo:  # nodes that no edge can turn
        i = todo.pop()
        if side[i] is not None or abs(u[i]) < sum(near[i].values()) or u[i] == 0 and near[i]:
            continue
        side[i] = u[i] > 0
        for j, w in near[i].items():
            del near[j][i]
            u[j] += w if side[i] else -w
            todo.append(j)
        near[i] = {}
    rest = [i for i in range(n) if side[i] is None]
    if not rest:
        return [bool(x) for x in side]
    # augmenting paths on what is left; -1 source, -2 sink
    cap: dict[int, dict[int, float]] = {i: dict(near[i]) for i in rest}
    cap[-1], cap[-2] = {}, {}
    for i in rest:
        if u[i] > 0:
            cap[-1][i], cap[i][-1] = u[i], 0.0
        elif u[i] < 0:
            cap[i][-2], cap[-2][i] = -u[i], 0.0
    while True:
        back = {-1: -1}
        queue = deque([-1])
        while queue and -2 not in back:
            i = queue.popleft()
            for j, c in cap[i].items():
                if c > 1e-9 and j not in back:
                    back[j] = i
                    queue.append(j)
        if -2 not in back:
            break
        path, j = [], -2
        while j != -1:
            path.append((back[j], j))
            j = back[j]
        f = min(cap[i][j] for i, j in path)
        for i, j in path:
            cap[i][j] -= f
            cap[j][i] = cap[j].get(i, 0.0) + f
    for i in rest:
        side[i] = i in back
    return [bool(x) for x in side]


def heading_of(page: list[Block]) -> int | None:
    """The first block of level 1 that isn't the title element."""
    return next((i for i, (_, kind, lv) in enumerate(page) if lv == 1 and (kind or "").lower() != "title"), None)


def heading_in(page: list[Block], positions: list[int | None], heading: int | None) -> int | None:
    """Where the file's heading, at position ``heading``, stands in a segment: its place, -1 before it, or its length behind it."""
    if heading is None:
        return None
    if positions[0] is not None and positions[0] > heading:
        return -1
    here = heading_of(page)
    return len(page) if here is None else here


def label(model: Model, page: list[Block], main: int | None) -> list[bool]:
    """True for the blocks of a page, in reading order, that are boilerplate. main: the place of the page's heading, as ``heading_of`` or ``heading_in`` gives it."""
    wordings = [wording_of(t) for t, _, _ in page]
    odds_of = [model.cost(words_in([t]), [w, *marks_of(t, lv)]) for (t, _, lv), w in zip(page, wordings)]
    prose = [is_prose(t) or odds < BIAS and len(t) >= 12 and is_ended(t) for (t, _, _), odds in zip(page, odds_of)]
    unary, edges = [], {}
    reach: int | None = None
    for i, (text, kind, level) in enumerate(page):
        kind = (kind or "").lower()
        odds = odds_of[i]
        u = 2.2 * min(max(odds - BIAS, 0.0), 3.5) - 0.4
        if main is not None and i < main:
            u += 5.0
        if kind == "title":
            u += 8.0
        if i == main:
            u -= 12.0
        elif prose[i] and odds < 1.2:
            u -= 2.0
        elif level == 2 and odds < 2.5:
            u = min(u, 0.0) - 2.5
        elif odds < BIAS:
            u -= 0.5
        opens = main is not None and i > main and wordings[i] in model.openers
        if opens:
            u += 6.0
        # blocks under the opener of a section stand near it in the page's tree
        if level in (1, 2):
            reach = None
        if reach is not None and i - reach <= REACH and not opens and odds < 1.5:
            edges[reach, i] = edges.get((reach, i), 0.0) + 4.0
            u *= 0.6
        if opens:
            reach = i
        unary.append(u)
        if i:
            last = (page[i - 1][1] or "").lower()
            edges[i - 1, i] = edges.get((i - 1, i), 0.0) + (0.7 if prose[i] != prose[i - 1] or main in (i, i - 1) else 1.5 if kind == last else 1.0)
    return minimum_cut(unary, edges)


COUNTS = ("html", "other", "follow", "after")


def fit(files: DataFrame, blocks: DataFrame, long: bool) -> Model:
    """The classifier, from all files; the counts are summed within each batch before they are shuffled by feature, those of files in several segments by file first."""
    pages, size = files_with_blocks(files, blocks, long=long), common.SEGMENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[int | None, tuple[Counter, Counter, Counter, Counter]] = {}
            formats, segments, many, headings = (batch.column(c).to_pylist() for c in ("file_format", "segment", "segments", "heading"))
            ids, cols, groups = unnest(batch)
            for file_id, fmt, part, parts_, heading, at in zip(ids, formats, segments, many, headings, groups):
                html, other, follow, after = counts.setdefault(file_id if parts_ > 1 else None, (Counter(), Counter(), Counter(), Counter()))
                texts, levels, positions = cols["text"][at], cols["head_level"][at], cols["pos"][at]
                mine = [True] * len(texts) if parts_ == 1 else own(part, positions, size)
                wordings = [wording_of(t) if m else "" for t, m in zip(texts, mine)]
                seen = words_in(texts if parts_ == 1 else [t for t, m in zip(texts, mine) if m])
                seen.update(wordings, [f"#{lv}" for lv, m in zip(levels, mine) if m and lv], [""])
                if any(m and is_navigation(t) for t, m in zip(texts, mine)):
                    seen.add("#nav")
                (html if fmt == "html" else other).update(seen)
                if fmt == "html":
                    # whether an article's prose still follows, for blocks behind the page's heading
                    main = heading_in(list(zip(texts, cols["kind"][at], levels)), positions, heading)
                    prose = [i for i, t in enumerate(texts) if is_long(t)]
                    for i, w in enumerate(wordings):
                        if w and main is not None and i > main:
                            k = bisect.bisect_right(prose, i)
                            follow[w] += 1
                            after[w] += k < len(prose) and prose[k] <= i + CONTEXT
            for file_id, each in counts.items():
                keys = list(each[0].keys() | each[1].keys())
                yield pa.record_batch([pa.array([file_id] * len(keys), pa.int64()), pa.array(keys, pa.string()), *(pa.array([c.get(k, 0) for k in keys], pa.int64()) for c in each)], ["file_id", "feature", *COUNTS])

    each = pages.mapInArrow(run, "file_id bigint, feature string, html bigint, other bigint, follow bigint, after bigint")
    sums = [F.sum(c).alias(c) for c in COUNTS]
    if long:  # a feature counts once in a file, however many segments hold it
        each = each.groupBy("file_id", "feature").agg(*sums).select("feature", *(F.when(F.col("file_id").isNull(), F.col(c)).otherwise(F.least(c, F.lit(1))).alias(c) for c in COUNTS[:2]), *COUNTS[2:])
    counted = durable(each.groupBy("feature").agg(*sums).where(F.col("html") + F.col("other") >= LEAST_FILES), "features")
    total = counted.where("feature = ''").first()
    html, other = (total["html"], total["other"]) if total else (0, 0)
    odds = F.log((F.col("html") + 2) / F.lit(html + 2)) - F.log((F.col("other") + 2) / F.lit(other + 2))
    wording = F.col("feature").startswith("=")
    first = [F.desc(F.col("html") + F.col("other")), F.col("feature")]
    kept = counted.where("feature <> ''")
    rows = kept.where(wording & (odds >= BIAS - 1e-9)).orderBy(*first).limit(MAX_FEATURES).collect() + kept.where(~wording).orderBy(*first).limit(MAX_FEATURES).collect()
    return Model([tuple(r) for r in rows], html, other)


def boilerplate(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """(file_id, block_id, pos, removed) for every block of the html files: removed is true outside the main body.

    Repeated loads of a block count once; blocks with null text, null file or of an unknown file give no row; of blocks with null pos the order is by block id, at the
    end; null kinds and levels are taken as unknown. Without files that aren't pages the classifier is blind and only structure decides. Very long pages are labelled in
    segments (``files_with_blocks``) that know the page's heading and overlap. Other columns are ignored.
    """
    long = has_long_files(blocks)
    model = blocks.sparkSession.sparkContext.broadcast(fit(files, blocks, long))  # at most twice MAX_FEATURES
    pages = files_with_blocks(files.where(F.lower(F.trim("file_format")) == "html"), blocks, long=long)
    size = common.SEGMENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cols, groups = unnest(batch, ("pos", "block_id", "text", "kind", "head_level"))
            out: tuple[list, list, list, list] = ([], [], [], [])
            for file_id, part, heading, at in zip(ids, batch.column("segment").to_pylist(), batch.column("heading").to_pylist(), groups):
                positions = cols["pos"][at]
                page = list(zip(cols["text"][at], cols["kind"][at], cols["head_level"][at]))
                for block_id, pos, removed, mine in zip(cols["block_id"][at], positions, label(model.value, page, heading_in(page, positions, heading)), own(part, positions, size)):
                    if mine:
                        for col, x in zip(out, (file_id, block_id, pos, removed)):
                            col.append(x)
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.bool_())], ["file_id", "block_id", "pos", "removed"])

    return pages.mapInArrow(run, "file_id bigint, block_id bigint, pos int, removed boolean")


def p2_found(spark, sf_dir: str) -> DataFrame:
    return boilerplate(table(spark, sf_dir, "files"), table(spark, sf_dir, "blocks")).where("removed and block_id is not null").select("block_id").distinct()


def p2_pages(spark, sf_dir: str) -> DataFrame:
    """Blocks of each page kept and removed."""
    return boilerplate(table(spark, sf_dir, "files"), table(spark, sf_dir, "blocks")).groupBy("file_id").agg(F.count_if(~F.col("removed")).alias("kept"), F.count_if("removed").alias("removed"))
