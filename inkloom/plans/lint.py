"""Linting a corpus: active rules, their findings, and what a model said."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.operators import scoring, units
from inkloom.operators.corpus import Corpus
from inkloom.operators.custom import custom_findings, with_custom
from inkloom.operators.gate import gated, resolve_types
from inkloom.rules.catalog import Rule, active, catalog, check
from inkloom.rules.static import CHECKS, FINDING
from inkloom.settings import Settings


@dataclass
class Lint:
    """findings: doc_id, path, FINDING columns, severity, ord, probability. docs: types and their sources. decisions: one row per model call."""

    docs: DataFrame
    findings: DataFrame
    decisions: DataFrame | None = None
    errors: DataFrame | None = None
    rules: list[Rule] = field(default_factory=list)

    def stats(self) -> DataFrame | None:
        return None if self.decisions is None else scoring.run_stats(self.decisions)

    def ordered(self) -> DataFrame:
        return self.findings.orderBy("path", "line", "col", "code", "ord")


def rules_of(settings: Settings) -> list[Rule]:
    known = check(with_custom(catalog(), settings.rules))
    return active(known, settings.select, settings.ignore, settings.extend_select, settings.extend_ignore, settings.semantic)


def static_findings(c: Corpus, rules: list[Rule], settings: Settings) -> DataFrame:
    """Findings of the exact rules; only the checks of rules that are on enter the plan."""
    options = {"max_sentence_words": settings.max_sentence_words, "max_reading_grade": settings.max_reading_grade}
    parts = [CHECKS[r.code](c, **options).select(*FINDING) if r.custom is None else custom_findings(c, r).select(*FINDING) for r in rules if r.kind == "static"]
    if not parts:
        return c.blocks.sparkSession.createDataFrame([], "doc_id bigint, code string, pos int, line int, col int, label string, value double, message string, snippet string")
    return reduce(DataFrame.unionByName, parts)


def lint(corpus: Corpus, settings: Settings = Settings(), scorer: scoring.Scorer | None = None, errors: DataFrame | None = None) -> Lint:
    """All findings of a corpus. Blocks are partitioned by document once and kept, since every rule reads them.

    Semantic rules need a scorer, given or named in the settings; without one the run stops with a ValueError before anything is read.
    """
    rules = rules_of(settings)
    asks = any(r.kind == "semantic" for r in rules)
    if scorer is None and (asks or settings.semantic and settings.classify and settings.model):
        scorer = scoring.resolve(settings.model)
    c = corpus.persist()
    classified = None
    if settings.semantic and settings.classify and scorer is not None:
        text = c.prose.groupBy("doc_id").agg(F.sum("words").alias("words"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
        classified = scoring.classify(text.join(c.docs.where("doc_type is null"), "doc_id", "left_semi"), scoring.chooser(scorer))
    docs = resolve_types(c.docs, settings, classified)
    c.docs = docs
    found = static_findings(c, rules, settings)
    decisions = None
    if asks:
        asked = units.plan(c, rules, settings.min_words)
        decisions = scoring.decide(asked, rules, scorer, settings.concurrency).persist()  # findings, statistics and reports read them; the model is asked once
        found = found.unionByName(scoring.findings(decisions, c.blocks, rules, settings).select(*FINDING))
    return Lint(docs, gated(found, docs, rules), decisions, errors, rules)
