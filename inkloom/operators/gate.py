"""Which rules apply to which documents, and what document types are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.rules.catalog import DOC_TYPES, Rule, rules_df
from inkloom.settings import Settings


def applies(doc_type: Column, applies_to: Column, skip_for: Column) -> Column:
    """A document without a type gets every rule; being skipped wins over being named."""
    return doc_type.isNull() | (~F.array_contains(skip_for, doc_type) & ((F.size(applies_to) == 0) | F.array_contains(applies_to, doc_type)))


def gated(findings: DataFrame, docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Findings of rules that apply to their documents. Rules are a small table; documents join on doc_id."""
    r = F.broadcast(rules_df(findings.sparkSession, rules).select("code", "applies_to", "skip_for", "severity", "ord"))  # one row per rule
    f = findings.join(r, "code").join(docs.select("doc_id", "path", "doc_type"), "doc_id")
    return f.where(applies(F.col("doc_type"), F.col("applies_to"), F.col("skip_for"))).drop("applies_to", "skip_for")


def applicable(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, code) of every document and rule that go together."""
    r = rules_df(docs.sparkSession, rules).select("code", "kind", "scope", "view", "fragments", "threshold", "share_below", "applies_to", "skip_for", "ord")
    return docs.join(F.broadcast(r), applies(F.col("doc_type"), F.col("applies_to"), F.col("skip_for"))).drop("applies_to", "skip_for")  # one row per rule


def resolve_types(docs: DataFrame, settings: Settings, classified: DataFrame | None = None) -> DataFrame:
    """doc_type, doc_type_confidence, doc_type_source: forced, then by format (decks), then given, then classified, else unresolved.

    classified: (doc_id, choice, confidence) for documents with words; choices that are no types are ignored.
    """
    if settings.forced_type is not None and settings.forced_type not in DOC_TYPES:
        raise ValueError(f"unknown document type {settings.forced_type}")
    d = docs
    if classified is not None and settings.semantic and settings.classify:
        d = d.join(classified.where(F.col("choice").isin(*DOC_TYPES)).select("doc_id", "choice", "confidence"), "doc_id", "left")
    else:
        d = d.withColumn("choice", F.lit(None).cast("string")).withColumn("confidence", F.lit(None).cast("double"))
    forced = F.lit(settings.forced_type)
    deck = F.when(F.col("format") == "pptx", "presentation")
    source = F.when(forced.isNotNull(), "forced").when(deck.isNotNull(), "format").when(F.col("doc_type").isNotNull(), "given").when(F.col("choice").isNotNull(), "classified").otherwise("unresolved")
    return d.select("doc_id", "path", "format", F.coalesce(forced, deck, "doc_type", "choice").alias("doc_type"), F.when(source == "classified", F.col("confidence")).alias("doc_type_confidence"), source.alias("doc_type_source"))
