"""A corpus as a star of DataFrames: documents, blocks, sentences, sections.

All child tables carry doc_id and are partitioned by it once; every window and aggregate per document reuses that partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkloom.functions import text as T

PROSE_KINDS = ("paragraph", "list_item", "table_cell", "notes")
HEADING_KINDS = ("heading", "title")


def canonical_kind(kind: Column) -> Column:
    """Block kinds however they are spelled; unknown and null kinds are paragraphs."""
    k = F.regexp_replace(F.lower(F.coalesce(kind, F.lit(""))), "[^a-z0-9]", "")
    return (
        F.when(k.isin("listitem", "li"), "list_item")
        .when(k.isin("tablecell", "td", "th"), "table_cell")
        .when((k == "heading") | k.rlike("^h[1-6]$"), "heading")
        .when(k == "title", "title")
        .when(k == "notes", "notes")
        .otherwise("paragraph")
    )


def location() -> Column:
    """Where a block stands: its label, else line and column."""
    return F.when(F.col("label") != "", F.concat(F.col("label"), F.lit(":"))).otherwise(F.concat(F.col("line"), F.lit(":"), F.col("col")))


@dataclass
class Corpus:
    """docs: doc_id, path, format, doc_type. blocks: doc_id, pos, text, raw, kind, line, col, label, level, bold, words, prose, dump."""

    docs: DataFrame
    blocks: DataFrame
    kept: list[DataFrame] = field(default_factory=list)
    by_document: bool = False  # whether blocks are partitioned by document already
    visuals: DataFrame | None = None  # doc_id, line (slide), visuals: pictures and charts of decks

    @staticmethod
    def of(docs: DataFrame, blocks: DataFrame) -> Corpus:
        """From tables that have at least doc_id, pos, text, kind; what else is missing gets its default. Null texts are empty, null doc_ids are dropped."""
        have = set(blocks.columns)

        def get(name: str, default, kind: str) -> Column:
            return F.coalesce(F.col(name).cast(kind), F.lit(default).cast(kind)) if name in have else F.lit(default).cast(kind)

        b = blocks.where("doc_id is not null").select(
            "doc_id",
            F.col("pos").cast("int").alias("pos"),
            F.coalesce("text", F.lit("")).alias("text"),
            (F.coalesce("raw", "text", F.lit("")) if "raw" in have else F.coalesce("text", F.lit(""))).alias("raw"),
            canonical_kind(F.col("kind")).alias("kind"),
            get("line", 0, "int").alias("line"),
            get("col", 1, "int").alias("col"),
            get("label", "", "string").alias("label"),
            get("level", 0, "int").alias("level"),
            get("bold", False, "boolean").alias("bold"),
        )
        b = b.withColumn("words", T.word_count("text")).withColumn("prose", F.col("kind").isin(*PROSE_KINDS)).withColumn("dump", T.is_link_dump(F.col("text")))
        d = docs.where("doc_id is not null").select("doc_id", F.col("path") if "path" in docs.columns else F.lit("").alias("path"), F.lower(F.trim("format")).alias("format"), F.col("doc_type"))
        return Corpus(d, b)

    @staticmethod
    def of_tables(files: DataFrame, blocks: DataFrame) -> Corpus:
        """From the tables ``files`` and ``blocks``; a block that was loaded again counts once."""
        docs = files.select(F.col("file_id").alias("doc_id"), "path", F.col("file_format").alias("format"), "doc_type")
        b = blocks.where("file_id is not null").repartition("file_id").dropDuplicates(["file_id", "block_id"])
        c = Corpus.of(docs, b.select(F.col("file_id").alias("doc_id"), "pos", "text", "kind", F.col("line_no").alias("line"), F.col("col_no").alias("col"), F.col("block_label").alias("label"), F.col("head_level").alias("level"), F.col("bold_lead").alias("bold")))
        c.by_document = True
        return c

    def persist(self) -> Corpus:
        """Keeps blocks, and sentences and sections once they are asked for: several rules read each of them."""
        self.blocks = (self.blocks if self.by_document else self.blocks.repartition("doc_id")).persist()
        self.kept = [self.blocks]
        return self

    def unpersist(self) -> None:
        for df in self.kept:
            df.unpersist()
        self.kept = []

    def _keep(self, df: DataFrame) -> DataFrame:
        if self.kept:
            self.kept.append(df.persist())
        return df

    @cached_property
    def prose(self) -> DataFrame:
        return self.blocks.where("prose")

    @cached_property
    def sentences(self) -> DataFrame:
        """doc_id, pos, sent_no (from 0), text, words, of the prose blocks."""
        return self._keep(self.prose.select("doc_id", "pos", "line", "col", "label", "kind", "dump", F.posexplode(T.sentences(F.col("text"))).alias("sent_no", "sentence")).withColumn("n", T.word_count("sentence")))

    @cached_property
    def outline(self) -> DataFrame:
        """One row per section, as intervals of block positions.

        sec_no: order; own_end and sub_end: last position of its own blocks and of its subtree; parent: sec_no of the section above, or null; children: how many it has.
        Blocks before the first heading are a section without title and of level 0. Decks are cut by ``slides`` instead.
        """
        return headings(self.blocks)

    @cached_property
    def sections(self) -> DataFrame:
        """The outline with title texts, body words, body texts, prose words and whether a section is a divider, which is told by how its body opens: who doesn't read bodies doesn't pay for them."""
        o = self.outline.withColumn("key", F.coalesce("title_pos", F.lit(-1)))
        b = within_sections(self.blocks).where(~F.col("kind").isin(*HEADING_KINDS)).select("doc_id", "pos", "text", "kind", "prose", "words", "opens", F.col("sections")[0].alias("own"), F.explode("sections").alias("key"))
        held = b.groupBy("doc_id", "key").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("pos", "text")))), lambda x: x["text"]), "\n\n").alias("body"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("opens").isNotNull(), F.struct("pos", "opens")))), lambda x: x["opens"]), " ").alias("opens"),
            F.sum(F.when(F.col("prose"), F.col("words"))).alias("prose_words"),
            F.sum((F.col("kind") == "list_item").cast("int")).alias("bullets"),
            F.sum((F.col("own") == F.col("key")).cast("int")).alias("own_blocks"),
        )
        body = o.join(held, ["doc_id", "key"], "left").drop("key").withColumn("body", F.coalesce("body", F.lit(""))).withColumn("opens", F.coalesce("opens", F.lit("")))
        for c in ("prose_words", "bullets", "own_blocks"):
            body = body.withColumn(c, F.coalesce(c, F.lit(0)))
        return self._keep(body.withColumn("divider", is_divider(F.col("opens"), F.col("title"))).drop("opens"))


def is_divider(body: Column, title: Column) -> Column:
    """No body, or one that only numbers a part."""
    first = F.array_join(F.slice(F.split(T.strip(body), rf"{T.SPACE}+"), 1, 3), " ")
    return (T.strip(body) == "") | first.rlike(r"(?i)^(?:part|section|chapter|module|act|unit)\s+(?:\d{1,3}|[ivxlc]{1,6})\b")


LEVELS = 10  # levels of headings that are told apart


def rank(level: str = "level") -> Column:
    return F.least(F.greatest(F.coalesce(level, F.lit(0)), F.lit(0)), F.lit(LEVELS - 1))


def within_sections(blocks: DataFrame) -> DataFrame:
    """Adds ``sections``: positions of the headings over each block, innermost first, or -1 before the first heading. At most LEVELS a block, from running windows.

    Adds ``opens`` as well: the first three words of the first three blocks with any behind each heading, null for other blocks. They hold the first three words of every section.
    """
    so_far = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.array(*(F.last(F.when((F.col("kind") == "heading") & (rank() == k), F.col("pos")), ignorenulls=True).over(so_far) for k in range(LEVELS)))
    first = F.when(~F.col("kind").isin(*HEADING_KINDS), T.first_words(F.col("text"), 3))
    b = blocks.withColumn("opens", F.when(first != "", first)).withColumn("last", last).withColumn("seen", F.count("opens").over(so_far))
    before = F.coalesce(F.last(F.when(F.col("kind") == "heading", F.col("seen")), ignorenulls=True).over(so_far), F.lit(0))
    b = b.withColumn("before", before).withColumn("opens", F.when(F.col("seen") - F.col("before") <= 3, F.col("opens"))).drop("seen", "before")
    # a heading is closed by a later one of its level or above
    step = lambda acc, p: F.when(p > F.coalesce(F.get(acc, F.lit(0)), F.lit(-1)), F.concat(F.array(p), acc)).otherwise(acc)
    stack = F.aggregate("last", F.array().cast("array<int>"), step)
    return b.withColumn("sections", F.when(F.size(stack) > 0, stack).otherwise(F.array(F.lit(-1)))).drop("last")


def headings(blocks: DataFrame) -> DataFrame:
    """Sections of heading documents. Ends and parents are the nearest headings of a level below and above, found by running windows over the headings: linear in their number."""
    ends = blocks.groupBy("doc_id").agg(F.max("pos").alias("last"), F.min(F.when(~F.col("kind").isin(*HEADING_KINDS), F.col("pos"))).alias("first_body"), F.min(F.when(F.col("kind") == "heading", F.col("pos"))).alias("first_heading"))
    h = blocks.where("kind = 'heading'").select("doc_id", "pos", "level", "text", "label", "line", "col", "raw", rank().alias("rank"))
    doc = Window.partitionBy("doc_id")
    before, after = (doc.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("pos"), F.desc("pos")))
    nearest = lambda w: F.array(*(F.last(F.when(F.col("rank") <= k, F.col("pos")), ignorenulls=True).over(w) for k in range(LEVELS)))  # noqa: E731 - by level
    h = h.withColumn("sec_no", F.row_number().over(doc.orderBy("pos"))).withColumn("above", nearest(before)).withColumn("next", F.lag("pos").over(doc.orderBy(F.desc("pos")))).withColumn("closing", nearest(after))
    s = h.join(ends.select("doc_id", "last"), "doc_id").select(
        "doc_id", "sec_no", "level", F.col("text").alias("title"), "label", "line", "col", "raw",
        F.col("pos").alias("title_pos"), (F.col("pos") + 1).alias("own_start"), F.coalesce(F.col("next") - 1, "last").alias("own_end"), F.coalesce(F.get("closing", F.col("rank")) - 1, "last").alias("sub_end"),
        F.get("above", F.col("rank") - 1).alias("parent_pos"),
    )
    held = s.where("parent_pos is not null").groupBy("doc_id", F.col("parent_pos").alias("title_pos")).agg(F.count("*").cast("int").alias("children"))
    s = s.join(held, ["doc_id", "title_pos"], "left").withColumn("children", F.coalesce("children", F.lit(0)))
    lead_end = F.coalesce(F.col("first_heading") - 1, "last")
    nothing = {f.name: F.lit(None).cast(f.dataType) for f in s.schema}
    lead = ends.where(F.col("first_body") <= lead_end).select(*({**nothing, "doc_id": F.col("doc_id"), "sec_no": F.lit(0), "level": F.lit(0), "label": F.lit(""), "line": F.lit(0), "col": F.lit(1), "own_start": F.lit(0), "own_end": lead_end, "sub_end": lead_end, "children": F.lit(0)}[c].alias(c) for c in s.columns))
    return s.unionByName(lead)


def peers(sections: DataFrame, least: int = 4) -> DataFrame:
    """Sections of the shallowest level that has enough headed sections which aren't dividers."""
    w = Window.partitionBy("doc_id", "level")
    s = sections.where("title is not null and not divider").withColumn("n_level", F.count("*").over(w)).where(F.col("n_level") >= least)
    return s.withColumn("peer_level", F.min("level").over(Window.partitionBy("doc_id"))).where("level = peer_level")


def slides(blocks: DataFrame) -> DataFrame:
    """Sections of decks: one per slide, in the order in which slides first appear, titles of several paragraphs joined."""
    s = blocks.groupBy("doc_id", "line").agg(
        F.min("pos").alias("own_start"),
        F.max("pos").alias("own_end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind").isin(*HEADING_KINDS), F.struct("pos", "text")))), lambda x: x["text"]), " ").alias("title"),
        F.min(F.when(F.col("kind").isin(*HEADING_KINDS), F.col("pos"))).alias("title_pos"),
        F.sum(F.when(F.col("prose"), F.col("words")).otherwise(0)).alias("prose_words"),
        F.sum((F.col("kind") == "list_item").cast("int")).alias("bullets"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("kind").isin(*HEADING_KINDS) & (F.col("text") != ""), F.struct("pos", "text")))), lambda x: x["text"]), "\n\n").alias("body"),
    )
    w = Window.partitionBy("doc_id").orderBy("own_start")
    return s.select("doc_id", F.row_number().over(w).alias("sec_no"), F.lit(1).alias("level"), F.when(F.col("title_pos").isNotNull(), F.col("title")).alias("title"), F.concat(F.lit("slide "), F.col("line")).alias("label"), "line", "title_pos", "own_start", "own_end", "prose_words", "bullets", "body")
