"""What a probability model is asked: units of text with the rules that are asked of them.

A unit: doc_id, unit_scope, view, anchor_pos, sec_no, state (text or JSON), codes, snippet, tokens. All rules of one scope and view share a unit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkloom.functions import text as T
from inkloom.operators.corpus import Corpus, is_divider, slides
from inkloom.rules.catalog import Rule

MAX_TOKENS = 24_000
MIN_WORDS, MIN_WORDS_DECK, FULL_WORDS, MIN_TITLES, OPENING_WORDS = 8, 4, 8, 3, 14


def floor(fmt: Column, setting: int | None) -> Column:
    return F.lit(setting) if setting is not None else F.when(fmt == "pptx", MIN_WORDS_DECK).otherwise(MIN_WORDS)


def codes(rules: list[Rule], scope: str, view: str, fragments: bool = False) -> Column:
    """The codes that are asked of a unit of this scope and view, in catalog order, given the column doc_type: one look into a table of the types that any rule names."""
    some = [r for r in rules if r.kind == "semantic" and r.scope == scope and r.view == view and (r.fragments or not fragments)]
    lists = lambda keep: F.array(*(F.lit(r.code) for r in some if keep(r))).cast("array<string>")
    named = sorted({t for r in some for t in (*r.applies_to, *r.skip_for)})
    every, others = lists(lambda r: True), lists(lambda r: not r.applies_to)
    if not named:
        return every
    by_type = F.create_map(*(x for t in named for x in (F.lit(t), lists(lambda r: t not in r.skip_for and (not r.applies_to or t in r.applies_to)))))  # noqa: B023
    return F.when(F.col("doc_type").isNull(), every).otherwise(F.coalesce(by_type[F.col("doc_type")], others))


def opening(body: Column, n: int = OPENING_WORDS) -> Column:
    ws = F.filter(F.split(T.strip(body), rf"{T.SPACE}+"), lambda w: w != "")
    return F.concat(F.array_join(F.slice(ws, 1, n), " "), F.when(F.size(ws) > n, " ...").otherwise(""))


def sections_of(c: Corpus) -> DataFrame:
    """Sections of heading documents and of decks, with what the planner needs."""
    from inkloom.rules.static import titled

    deck = c.docs.where("format = 'pptx'")
    none = F.lit(None).cast("int")
    h = titled(c).select("doc_id", "sec_no", "level", "title", "label", F.col("pos").alias("title_pos"), "body", "divider", none.alias("visuals"))
    s = slides(c.blocks.join(deck, "doc_id", "left_semi")).where("title is not null")
    s = s.withColumn("visuals", none) if c.visuals is None else s.join(c.visuals.select("doc_id", "line", F.col("visuals").cast("int").alias("visuals")), ["doc_id", "line"], "left")
    return h.unionByName(s.select("doc_id", "sec_no", "level", "title", "label", "title_pos", "body", is_divider(F.col("body"), F.col("title")).alias("divider"), "visuals"))


UNIT = ("doc_id", "unit_scope", "view", "anchor_pos", "sec_no", "state", "codes", "snippet", "tokens")


def _unit(df: DataFrame, scope: str, view: str, state: Column, snippet: Column) -> DataFrame:
    return df.where(F.size("codes") > 0).select("doc_id", F.lit(scope).alias("unit_scope"), F.lit(view).alias("view"), "anchor_pos", F.col("sec_no").cast("int").alias("sec_no"), state.alias("state"), "codes", snippet.alias("snippet"), T.estimate_tokens(state).alias("tokens"))


def plan(c: Corpus, rules: list[Rule], min_words: int | None = None) -> DataFrame:
    """Every unit of a corpus. Documents without a type are asked all rules."""
    d = c.docs.select("doc_id", "format", "doc_type")
    none = F.lit(None).cast("int")
    b = c.prose.where("not dump").join(d, "doc_id").withColumn("floor", floor(F.col("format"), min_words)).withColumn("anchor_pos", F.col("pos")).withColumn("sec_no", none)
    blocks = b.where(F.col("words") >= F.col("floor")).withColumn("codes", F.when(F.col("words") >= FULL_WORDS, codes(rules, "block", "text")).otherwise(codes(rules, "block", "text", fragments=True)))
    out = [_unit(blocks, "block", "text", F.col("text"), T.snippet(F.col("text")))]

    s = c.sentences.where("not dump").join(d, "doc_id").where(F.col("n") >= floor(F.col("format"), min_words)).withColumn("codes", codes(rules, "sentence", "text")).withColumn("anchor_pos", F.col("pos")).withColumn("sec_no", F.col("sent_no"))
    out.append(_unit(s, "sentence", "text", F.col("sentence"), T.snippet(F.col("sentence"))))

    w = Window.partitionBy("doc_id")
    t = sections_of(c).withColumn("i", F.row_number().over(w.orderBy("sec_no"))).withColumn("n", F.count("*").over(w)).join(d, "doc_id").withColumn("anchor_pos", F.col("title_pos")).withColumn("deck", F.col("format") == "pptx")
    judged = t.where("not divider")
    kind = F.when(F.col("deck"), "slide title").otherwise(F.concat(F.lit("section heading (level "), F.col("level"), F.lit(")")))
    title_state = F.to_json(F.struct(kind.alias("kind"), "title", F.concat(F.col("i"), F.lit(" of "), F.col("n")).alias("position"), T.word_count("body").alias("words_under_it"), opening(F.col("body")).alias("opening")))
    out.append(_unit(judged.where(T.word_count("title") >= 2).withColumn("codes", codes(rules, "title", "text")), "title", "text", title_state, T.snippet(F.col("title"))))
    where = F.concat(F.when(F.col("deck"), "slide ").otherwise("section "), F.col("i"), F.lit(" of "), F.col("n"))
    bodies = judged.where(T.word_count("body") >= 2 * floor(F.col("format"), min_words)).withColumn("codes", codes(rules, "section", "text"))
    out.append(_unit(bodies, "section", "text", F.to_json(F.struct(where.alias("position"), "title", "body", F.when(F.col("visuals") > 0, F.concat(F.col("visuals").cast("string"), F.lit(" (not shown; only the text is)"))).alias("charts_or_images"))), T.snippet(F.col("title"))))

    anchor = c.blocks.groupBy("doc_id").agg(F.coalesce(F.min(F.when(F.col("prose"), F.col("pos"))), F.min("pos")).alias("anchor_pos"))
    text = c.prose.where("not dump").groupBy("doc_id").agg(T.strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n\n")).alias("text"))
    doc = text.where("text <> ''").join(anchor, "doc_id").join(d, "doc_id").withColumn("codes", codes(rules, "document", "text")).withColumn("sec_no", none)
    out.append(_unit(doc, "document", "text", F.col("text"), T.snippet(F.col("text"))))
    out += [_overview(t, anchor, d, rules, view) for view in ("outline", "structure")]
    return reduce(DataFrame.unionByName, out)


def _overview(t: DataFrame, anchor: DataFrame, d: DataFrame, rules: list[Rule], view: str) -> DataFrame:
    place = F.when(F.col("deck"), F.col("label")).otherwise(F.concat(F.lit("section "), F.col("i")))
    head = F.concat(F.col("i"), F.lit(". ("), place, F.lit(") "), F.col("title"))
    if view == "outline":
        line, name = F.concat(F.repeat(F.lit("  "), F.greatest(F.col("level") - 1, F.lit(0))), head), "outline"
    else:
        first = opening(F.col("body"))
        line, name = F.concat(head, F.when(first != "", F.concat(F.lit(" -- "), first)).otherwise("")), "sections"
    o = t.groupBy("doc_id").agg(F.count("*").alias("k"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("line")))), lambda x: x["line"]), "\n").alias(name)).where(F.col("k") >= MIN_TITLES)
    o = o.join(anchor, "doc_id").join(d, "doc_id").withColumn("codes", codes(rules, "document", view)).withColumn("sec_no", F.lit(None).cast("int"))
    kind = F.when(F.col("format") == "pptx", "slide deck").otherwise("document").alias("kind")
    return _unit(o, "document", view, F.to_json(F.struct(kind, name)), F.lit("(the outline)"))
