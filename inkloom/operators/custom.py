"""Rules that users define: phrases, patterns, and questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.functions import text as T
from inkloom.operators.corpus import Corpus
from inkloom.rules.catalog import Rule, check
from inkloom.rules.static import _with_matches, finding


def custom_rule(spec: dict, known: list[Rule]) -> Rule:
    """A rule from its specification, in kebab or snake case; says what is wrong with it."""
    s = {k.replace("-", "_"): v for k, v in spec.items()}
    code = s.get("code")
    if not code:
        raise ValueError("a custom rule needs a code")
    if any(r.code == code and r.custom is None and r.kind in ("static", "semantic") and r.ord < 107 for r in known):
        raise ValueError(f"{code} is a built-in rule")
    kind, blocks = s.get("type", "phrase"), s.get("blocks", "prose")
    if blocks not in ("prose", "all"):
        raise ValueError(f"{code}: blocks must be prose or all")
    common = {"code": code, "name": s.get("name", code.lower()), "default": s.get("default", True), "summary": s.get("summary", s.get("name", code)), "severity": s.get("severity", "warning"), "applies_to": tuple(s.get("applies_to", ())), "skip_for": tuple(s.get("skip_for", ())), "ord": len(known)}
    if kind == "phrase":
        if not s.get("phrases"):
            raise ValueError(f"{code}: phrases must not be empty")
        return Rule(kind="static", scope="block", view="text", custom=T.phrase_pattern(s["phrases"], s.get("case_sensitive", False)), custom_kinds=blocks, **common)
    if kind == "regex":
        if not s.get("pattern"):
            raise ValueError(f"{code}: a pattern is needed")
        pattern = ("(?iu)" if s.get("ignore_case", False) else "") + s["pattern"]
        jvm = SparkSession.getActiveSession()._jvm
        try:
            jvm.java.util.regex.Pattern.compile(pattern)
        except Exception as e:
            raise ValueError(f"{code}: bad pattern {s['pattern']}") from e
        return Rule(kind="static", scope="block", view="text", custom=pattern, custom_kinds=blocks, **common)
    if kind in ("question", "jev"):
        if not s.get("question"):
            raise ValueError(f"{code}: a question is needed")
        scope = {"paragraph": "block"}.get(s.get("scope", "block"), s.get("scope", "block"))
        q = s["question"] if isinstance(s["question"], str) else s["question"]["question"]
        r = Rule(kind="semantic", scope=scope, view=s.get("view", "text"), threshold=float(s.get("threshold", 0.6)), fragments=bool(s.get("fragments", False)), question=q, **common)
        return check([r])[0]
    raise ValueError(f"{code}: unknown type {kind}")


def with_custom(rules: list[Rule], specs) -> list[Rule]:
    """The catalog with the users' rules behind it; defining a rule again changes nothing."""
    out = list(rules)
    for spec in specs:
        r = custom_rule(spec, out)
        if all(x.code != r.code for x in out):
            out.append(r)
    return out


def custom_findings(c: Corpus, r: Rule) -> DataFrame:
    m = _with_matches(c.blocks if r.custom_kinds == "all" else c.prose, r.custom)
    return finding(m, r.code, F.concat(F.lit(f"{r.summary}: '"), T.squeeze(F.col("hit")), F.lit("'")), snippet=T.snippet(F.col("raw"), F.col("at")))


def sentence_check(c: Corpus, code: str, predicate: Callable) -> DataFrame:
    """A finding for each prose sentence for which predicate(column) is true."""
    s = c.sentences.where(predicate(F.col("sentence"))).withColumn("text", F.col("sentence"))
    return finding(s, code, F.lit(code))
