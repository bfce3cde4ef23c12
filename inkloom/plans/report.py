"""Reports over findings: text, JSON, summaries, outlines, rule-by-label tables, and the exit code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkloom.operators.corpus import location
from inkloom.plans.lint import Lint

CONTROL = "The 9:14 train to Lindor leaves from platform 3 and takes 25 minutes."  # shows no trait
PRICES = {"default": 0.042e-6, "openai": 0.10e-6}  # dollars a token, as published for the two services


def text_lines(findings: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """(path, k, line_text): the lines of a text report, a document's type first."""
    p = F.when(F.col("code").startswith("JEV") & F.col("value").isNotNull(), F.format_string(" p=%.2f", "value")).otherwise("")
    where = F.concat("path", F.lit(":"), F.regexp_replace(location(), ":$", ""), F.lit(": "), F.col("code"), F.lit(" "), F.col("message"), p)
    w = Window.partitionBy("path").orderBy("line", "col", "code", "ord")
    lines = findings.withColumn("k", F.row_number().over(w)).select("path", "k", F.concat(where, F.when(F.col("snippet") != "", F.concat(F.lit("\n    "), F.col("snippet"))).otherwise("")).alias("line_text"))
    if types is not None:
        head = types.where("doc_type is not null").select("path", F.lit(0).alias("k"), F.concat("path", F.lit(": "), F.col("doc_type"), F.lit(" ("), F.col("doc_type_source"), F.lit(")")).alias("line_text"))
        lines = head.unionByName(lines)
    return lines


def top_codes(findings: DataFrame, k: int = 6) -> DataFrame:
    """The codes with most findings."""
    w = Window.orderBy(F.desc("n"), "code")  # over one row per code
    return findings.groupBy("code").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def summary(run: Lint) -> str:
    total = run.findings.count()
    if not total:
        return "All checks passed" if exit_code(run) == 0 else "No findings, but some checks failed"
    codes = ", ".join(f"{r['code']} x{r['n']}" for r in top_codes(run.findings).orderBy("rank").collect())
    return f"{total} finding(s) in {run.findings.select('path').distinct().count()} document(s): {codes}"


def model_note(run: Lint, system: str = "default") -> str:
    if run.decisions is None:
        return ""
    s = run.stats().agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("calls", "input_tokens", "skipped", "context_exceeded", "errors"))).first()
    out = f"{s['calls']} calls, {s['input_tokens']:,} input tokens, ~${s['input_tokens'] * PRICES[system]:.4f}"
    for name in ("skipped", "context_exceeded", "errors"):
        if s[name]:
            out += f"; {s[name]} {name.replace('_', ' ')}"
    return out


def json_report(run: Lint) -> DataFrame:
    """(doc_id, report): one JSON object per document with its type and sorted findings."""
    each = F.struct("line", "col", "code", "ord", "label", "message", "severity", "snippet", "value")
    f = run.findings.groupBy("doc_id").agg(F.array_sort(F.collect_list(each)).alias("f"))
    cleaned = F.transform(F.coalesce("f", F.array().cast(f.schema["f"].dataType)), lambda x: F.struct(x["code"].alias("code"), x["message"].alias("message"), x["line"].alias("line"), x["col"].alias("col"), x["label"].alias("label"), x["snippet"].alias("snippet"), F.when(x["code"].startswith("JEV"), x["value"]).alias("probability"), x["severity"].alias("severity")))
    d = run.docs.join(f, "doc_id", "left")
    parts = ["path", "format", "doc_type", "doc_type_confidence", "doc_type_source", cleaned.alias("findings")]
    if run.decisions is not None:
        s = run.stats()
        d = d.join(s.select("doc_id", F.struct(*(c for c in s.columns if c != "doc_id")).alias("stats")), "doc_id", "left")
        parts.append("stats")
    return d.select("doc_id", F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("report"))


def exit_code(run: Lint) -> int:
    """2 if a document could not be read or a call failed, else 1 if there are findings, else 0."""
    failed = run.errors is not None and not run.errors.isEmpty()
    if failed or run.decisions is not None and not run.decisions.where("status = 'error'").isEmpty():
        return 2
    return 0 if run.findings.isEmpty() else 1


def outline_lines(sections: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, k, line_text): the outline as printed: indentation by level, label, title, own blocks, words of the body."""
    n = F.size(F.filter(F.split(F.col("body"), r"\s+"), lambda x: x != ""))
    line = F.concat(F.repeat(F.lit(" "), 2 * F.greatest("level", F.lit(1))), F.when(F.col("label") != "", F.concat(F.col("label"), F.lit(" "))).otherwise(""), F.coalesce("title", F.lit("(untitled)")), F.format_string(" [%d blocks, %d words]", "own_blocks", n))
    head = sections.groupBy("doc_id").agg(F.count("*").alias("s"), F.sum("own_blocks").alias("b")).join(docs, "doc_id").select("doc_id", F.lit(-1).alias("k"), F.concat("path", F.lit(" ("), F.coalesce("format", F.lit("?")), F.lit(": "), F.col("b").cast("string"), F.lit(" blocks, "), F.col("s").cast("string"), F.lit(" sections)")).alias("line_text"))
    return head.unionByName(sections.select("doc_id", F.col("sec_no").alias("k"), line.alias("line_text")))


def by_label(findings: DataFrame, labels: DataFrame) -> DataFrame:
    """(code, label, documents): in how many documents of each label a rule fires. labels: doc_id, label."""
    return findings.select("doc_id", "code").distinct().join(labels, "doc_id").groupBy("code", "label").agg(F.count("*").alias("documents"))


def probe(scorer, rules) -> list[tuple[str, str, float]]:
    """Each semantic rule on the passages that show its trait, and on a control: (code, which, probability)."""
    out = []
    for r in rules:
        if r.kind == "semantic":
            for which, text in (*(("example", x) for x in r.shows), ("control", CONTROL)):
                out.append((r.code, which, scorer(text, {r.code: r.question})[r.code]))
    return out


def rules_tables(rules) -> list[str]:
    """The catalog as Markdown: a table of the exact rules and one of the semantic rules."""
    out = []
    for kind, title in (("static", "Exact rules"), ("semantic", "Questions to a model")):
        out += [f"### {title}", "", "| Code | Name | On | Scope | What it finds |", "|-|-|-|-|-|"]
        out += [f"| {r.code} | {r.name} | {'yes' if r.default else 'no'} | {r.scope if r.view == 'text' else r.view} | {r.summary.replace('|', chr(92) + '|')} |" for r in sorted(rules, key=lambda r: r.code) if r.kind == kind]
        out.append("")
    return out
