"""What an edit lost or invented: claims of a source text against its rewrite, for many pairs at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions import text as T
from inkloom.rules import lexicons as L

MEMBERSHIP = ("number", "name", "quoted", "verbatim")
COUNTED = ("superlative", "scope", "negation", "hedge")
ADDED_NOTE = "in the rewrite and nowhere in the source"


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def numbers(body: Column) -> Column:
    digits = F.transform(_all(body, L.NUMBER), lambda x: F.regexp_replace(F.replace(x, F.lit(","), F.lit("")), r"^\++", ""))
    spelled = F.transform(_all(body, r"(?i)\b(?:" + "|".join(L.NUMBER_WORDS) + r")\b"), lambda x: (F.array_position(F.array(*map(F.lit, L.NUMBER_WORDS)), F.lower(x)) - 1).cast("string"))
    return F.concat(digits, spelled)


def names(body: Column) -> Column:
    """Capitalised words that open neither a line nor a sentence."""
    lines = F.transform(F.split(body, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda x: F.regexp_replace(x, r"^[#>\-*+ \t]+", ""))
    sents = F.flatten(F.transform(lines, T.sentences))
    rest = F.transform(sents, lambda s: _all(F.regexp_replace(s, "^" + L.CAPITALIZED, " "), L.CAPITALIZED))
    return F.filter(F.flatten(rest), lambda w: ~w.isin(*L.NOT_NAMES))


def _named(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("token"))


def features(pairs: DataFrame, side: str) -> DataFrame:
    """(pair_id, kind, token, n): the multisets of claims of one side; the text is in a column named as the side."""
    c = F.coalesce(F.col(side), F.lit(""))
    held = []
    for pattern in (L.FENCED, L.CODE_SPAN, L.URL):
        held.append(F.transform(_all(c, pattern), T.strip))
        c = F.regexp_replace(c, pattern, " ")
    d = pairs.select("pair_id", c.alias("body"), F.concat(*held).alias("held"))
    b = F.col("body")
    small = lambda p: F.transform(_all(b, p), F.lower)
    tokens = {
        "number": numbers(b),
        "name": names(b),
        "quoted": F.transform(_all(b, L.QUOTED, 1), T.strip),
        "verbatim": F.col("held"),
        "superlative": small(L.SUPERLATIVE),
        "scope": F.transform(_all(b, L.SCOPE), lambda x: T.squeeze(F.lower(x))),
        "negation": small(L.NEGATION),
        "hedge": small(L.HEDGE),
    }
    each = F.flatten(F.array(*(F.transform(t, _named(k)) for k, t in tokens.items())))
    return d.select("pair_id", F.explode(each).alias("x")).groupBy("pair_id", "x.kind", "x.token").agg(F.count("*").alias("n"))


def compare(pairs: DataFrame, waive: tuple[str, ...] = ()) -> DataFrame:
    """Changes of every pair (pair_id, source, rewrite): direction, kind, token, source_n, rewrite_n, note.

    Names, numbers, quotations and code are compared by presence; rankings, scope words, negations and hedges by their totals. Tokens that contain a waived text don't count.
    """
    ok = reduce(lambda a, w: a & ~F.contains(F.lower("token"), F.lit(w.lower())), waive, F.lit(True))
    a = features(pairs, "source").where(ok).withColumnRenamed("n", "a")
    b = features(pairs, "rewrite").where(ok).withColumnRenamed("n", "b")
    f = a.join(b, ["pair_id", "kind", "token"], "full_outer").select("pair_id", "kind", "token", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    notes = F.create_map(*(F.lit(x) for kv in L.NOTES.items() for x in kv))
    lost = F.when(F.col("b") == 0, "LOST").when(F.col("a") == 0, "ADDED")
    present = f.where(F.col("kind").isin(*MEMBERSHIP)).withColumn("direction", lost).where("direction is not null")
    present = present.select("pair_id", "direction", "kind", "token", F.col("a").alias("source_n"), F.col("b").alias("rewrite_n"), F.when(F.col("direction") == "LOST", notes[F.col("kind")]).otherwise(F.lit(ADDED_NOTE)).alias("note"))
    gone = F.slice(F.array_sort(F.collect_set(F.when((F.col("a") > 0) & (F.col("b") == 0), F.col("token")))), 1, 4)
    counted = f.where(F.col("kind").isin(*COUNTED)).groupBy("pair_id", "kind").agg(F.sum("a").alias("source_n"), F.sum("b").alias("rewrite_n"), gone.alias("gone")).where("rewrite_n < source_n")
    note = F.concat((F.col("source_n") - F.col("rewrite_n")).cast("string"), F.lit(" fewer; "), notes[F.col("kind")], F.when(F.size("gone") > 0, F.concat(F.lit(". Gone: "), F.array_join("gone", ", "))).otherwise(""))
    return present.unionByName(counted.select("pair_id", F.lit("COUNT").alias("direction"), "kind", F.concat("kind", F.lit(" total")).alias("token"), "source_n", "rewrite_n", note.alias("note")))


def ordered(changes: DataFrame) -> DataFrame:
    rank = F.when(F.col("direction") == "LOST", 0).when(F.col("direction") == "ADDED", 1).otherwise(2)
    return changes.orderBy("pair_id", rank, "kind", "token")


def rendered(changes: DataFrame) -> DataFrame:
    """(pair_id, report): a text report for each pair that has changes."""
    line = F.format_string("  [%-5s] %-11s '%s'  source %d -> rewrite %d\n          %s", "direction", "kind", F.substring("token", 1, 60), "source_n", "rewrite_n", "note")
    rank = F.when(F.col("direction") == "LOST", 0).when(F.col("direction") == "ADDED", 1).otherwise(2)
    return changes.groupBy("pair_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(rank.alias("r"), "kind", "token", line.alias("line")))).alias("x")).select("pair_id", F.concat(F.col("n").cast("string"), F.lit(" finding(s)\n\n"), F.array_join(F.transform("x", lambda x: x["line"]), "\n")).alias("report"))
