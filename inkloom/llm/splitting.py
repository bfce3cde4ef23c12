"""Problem 5: cutting oversized texts at natural boundaries, by balanced targets.

The least number of pieces is computed, targets of equal length are placed, and each is moved to the strongest boundary
in its reach (paragraph, line, sentence, clause, white space); where any piece would exceed the limit, a piece is added.
Texts are independent of each other: one narrow pass, no shuffle but the one that brings each text its limits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkloom.llm.common import parts, table

DEFAULT_LIMIT, DEFAULT_OVERLAP = 24000, 0
STOPS = ".!?。！？।؟…"
_HARD = re.compile(rf"[^\s{re.escape(STOPS)}]+")
# strongest first; a cut lies behind the match. JSON states hold their line breaks escaped
_BOUNDARIES = [
    (5, re.compile(r"(?:\n\s*\n|(?:\\n){2,})\s*")),
    (4, re.compile(r"(?:\n|\\n)\s*")),
    (3, re.compile(r"[.!?।؟…]+[\"'”’»)\]]*\s+|[。！？]+[”’」』）]*\s*")),
    (2, re.compile(r"[,;:،؛]\s+|[，、；：]|\s{2,}")),
    (1, re.compile(r"\s+|[.!?…।؟]+")),
]


def tokens_of(chars: int) -> int:
    return chars // 4 + 1


def boundaries(text: str, base: int = 0) -> dict[int, int]:
    """place -> strength of the strongest boundary that ends there."""
    at: dict[int, int] = {}
    for strength, pattern in reversed(_BOUNDARIES):
        for m in pattern.finditer(text):
            at[base + m.end()] = strength
    return at


def place(text: str, start: int, target: int, low: int, high: int) -> tuple[int, int]:
    """(cut, strength) for a target: the strongest boundary in [low, high], nearest to the target among equals; (target, 0) where there is none."""
    best = None
    # marks in front of `low` are needed to see a boundary that ends within reach
    for at, strength in boundaries(text[max(start, low - 64) : high + 1], max(start, low - 64)).items():
        if low <= at <= high:
            key = (strength, -abs(at - target))
            if best is None or key > best[0]:
                best = (key, at, strength)
    return (best[1], best[2]) if best else (min(max(target, low), high), 0)


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, strength of the cut at end) of the pieces. Consecutive pieces share exactly the overlap, 4 characters a token.

    A piece holds at most 4*limit - 1 characters (limit tokens). An overlap of a whole piece or more is lowered to one character less than a piece.
    """
    cap = max(1, 4 * limit - 1)
    share = max(0, min(4 * overlap, cap - 1))
    size = len(text)
    if size <= cap:
        return [(0, size, 5)]
    count = -(-(size - share) // (cap - share))
    while True:
        out, start, ok = [], 0, True
        for i in range(count - 1):
            left = count - i
            # equal lengths for what is left; the reach keeps all later pieces possible
            target = start + share + (size - start - share) // left
            need = size - (left - 1) * (cap - share)
            high = min(start + cap, size - 1)
            low = max(start + share + 1, need, target - (cap - share) // 4)
            if low > high:
                ok = False
                break
            cut, strength = place(text, start, min(max(target, low), high), low, high)
            if strength == 0:  # nothing near the target: look over the whole piece before cutting by force
                wide = max(start + share + 1, need)
                cut, strength = place(text, start, min(max(target, wide), high), wide, high)
                if strength == 0 and need > start + share + 1 and place(text, start, target, start + share + 1, high)[1]:
                    ok = False  # a natural place exists, but leaves too much for the rest: one more piece
                    break
            out.append((start, cut, strength))
            start = cut - share
        if ok and size - start <= cap:
            return [*out, (start, size, 5)]
        count += 1


def split_units(units: DataFrame, files: DataFrame, settings: DataFrame) -> DataFrame:
    """Pieces of every unit whose state is over its limit: (unit_id, piece_no, start_off, end_off, piece, piece_tokens, cut_strength, forced_cut).

    Limits come from the settings of the unit's file; null or missing ones are 24000 tokens and no overlap. States are measured, ``tokens`` is not believed.
    forced_cut is 1 for every piece of a unit one of whose stretches without white space or sentence marks exceeds a piece. Null states and null unit ids give no
    rows, repeated rows of a unit one set of pieces; a limit under one token counts as one. Other columns are ignored.
    """
    s = settings.where("settings_id is not null").groupBy("settings_id").agg(F.max("max_unit_tokens").alias("lim"), F.max("overlap_tokens").alias("ovl"))
    f = files.where("file_id is not null").groupBy("file_id").agg(F.max("settings_id").alias("settings_id")).join(s, "settings_id", "left").select("file_id", "lim", "ovl")
    tokens = F.floor(F.length("state") / 4) + 1
    lowest = min(DEFAULT_LIMIT, *(r[0] for r in s.agg(F.min("lim")).collect() if r[0] is not None), DEFAULT_LIMIT)  # one number; smaller states aren't over any limit and don't travel
    u = units.where("unit_id is not null and state is not null").select("unit_id", "file_id", "state").where(tokens > max(lowest, 1)).join(f, "file_id", "left")
    over = u.select("unit_id", "state", F.greatest(F.coalesce("lim", F.lit(DEFAULT_LIMIT)), F.lit(1)).alias("lim"), F.greatest(F.coalesce("ovl", F.lit(DEFAULT_OVERLAP)), F.lit(0)).alias("ovl")).where(tokens > F.col("lim")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, states, lims, ovls = (batch.column(c).to_pylist() for c in ("unit_id", "state", "lim", "ovl"))
            for a, b in parts(states):
                rows = []
                for i, text, lim, ovl in zip(ids[a:b], states[a:b], lims[a:b], ovls[a:b]):
                    longest = max((m.end() - m.start() for m in _HARD.finditer(text)), default=0)
                    forced = int(longest > 4 * lim - 1)
                    rows += [(i, n, s, e, text[s:e], tokens_of(e - s), k, forced) for n, (s, e, k) in enumerate(pieces(text, lim, ovl))]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, TYPES)], NAMES)

    return over.mapInArrow(run, PIECES)


PIECES = "unit_id bigint, piece_no int, start_off bigint, end_off bigint, piece string, piece_tokens bigint, cut_strength int, forced_cut int"
NAMES = [x.split()[0] for x in PIECES.split(", ")]
TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32()]


def _split(spark, sf_dir: str) -> DataFrame:
    return split_units(table(spark, sf_dir, "units"), table(spark, sf_dir, "files"), table(spark, sf_dir, "settings"))


def p5_found(spark, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).where("piece_no = 0").select("unit_id", "forced_cut").distinct()


def p5_pieces(spark, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir)


def p5_cover(spark, sf_dir: str) -> DataFrame:
    """What the pieces of each unit are like: the characters that they cover, least and greatest overlap, whether they hold what their offsets say, keep to the limit, and are as many as are needed at least."""
    w = Window.partitionBy("unit_id").orderBy("piece_no")
    p = _split(spark, sf_dir).withColumn("shared", F.lag("end_off").over(w) - F.col("start_off"))
    each = p.groupBy("unit_id").agg(
        F.min("start_off").alias("first_char"), F.max("end_off").alias("chars"), F.min("shared").alias("least_overlap"), F.max("shared").alias("most_overlap"),
        F.bool_and(F.length("piece") == F.col("end_off") - F.col("start_off")).alias("as_said"), F.max("piece_tokens").alias("largest"), F.count("*").alias("pieces"),
    )
    files, s = table(spark, sf_dir, "files").groupBy("file_id").agg(F.max("settings_id").alias("settings_id")), table(spark, sf_dir, "settings").groupBy("settings_id").agg(F.max("max_unit_tokens").alias("lim"))
    limits = table(spark, sf_dir, "units").select("unit_id", "file_id").distinct().join(files, "file_id", "left").join(s, "settings_id", "left").groupBy("unit_id").agg(F.greatest(F.coalesce(F.max("lim"), F.lit(DEFAULT_LIMIT)), F.lit(1)).alias("lim"))
    room = 4 * F.col("lim") - 1
    needed = F.ceil((F.col("chars") - F.col("least_overlap")) / (room - F.col("least_overlap")))
    return each.join(limits, "unit_id").select("unit_id", "first_char", "chars", "least_overlap", "most_overlap", "as_said", (F.col("largest") <= F.col("lim")).alias("fits"), (F.col("pieces") >= needed).alias("enough"))
