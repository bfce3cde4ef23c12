"""Every exact rule on a document that fires it and on one that doesn't."""

import pytest

from inkloom.operators.corpus import Corpus
from inkloom.operators.gate import gated
from inkloom.plans.lint import lint, rules_of
from inkloom.rules.catalog import active, catalog, check, explain
from inkloom.rules.static import CHECKS
from inkloom.settings import Settings
from inkloom.sources.parsers import parse_md

BLOCK = "doc_id bigint, pos int, text string, raw string, kind string, line int, col int, label string, level int, bold boolean"


def make(spark, *texts, fmt="md", doc_type=None):
    rows = [(i, p, b["text"], b["raw"], b["kind"], b["line"], b["col"], b["label"], b["level"], b["bold"]) for i, t in enumerate(texts) for p, b in enumerate(parse_md(t))]
    docs = spark.createDataFrame([(i, f"d{i}.md", fmt, doc_type) for i in range(len(texts))], "doc_id bigint, path string, format string, doc_type string")
    return Corpus.of(docs, spark.createDataFrame(rows, BLOCK))


def words(n, w="word"):
    return " ".join([w] * n)


def sections(*sizes):
    return "# Top\n\n" + "\n\n".join(f"## Part about {'abcdefgh'[i]}\n\n{words(n)}." for i, n in enumerate(sizes))


CASES = {
    "RIF001": ("Input → output, as “smart” as can be.", "“A statement set apart.”", 3),
    "RIF002": ("# Understanding The Impact Of Modern Technology", "# Understanding the impact of technology", 1),
    "RIF003": ("- **One**: a\n- **Two**: b\n- c", "- **One**: a\n- b\n- c", 2),
    "RIF004": ("Portfolio overview (+2 companies added)", "We added two companies.", 1),
    "RIF005": ("# Step 6: hooks\n\ntext\n\n# Steps 5-6: check\n\ntext", "# Step 5: a\n\ntext\n\n# Step 6: b\n\ntext", 1),
    "RIF006": ("# A\n\n## B\n\n#### C\n\n# D", "# A\n\n## B\n\n### C\n\n### C2\n\n## D", 3),
    "RIF007": ("## 1. Getting started\n\n## [link](http://x) here\n\n## 🚀 Start", "## Getting started", 3),
    "RIF008": ("# Log\n\n## 1.0.0 - 2026-01-01\n\n### Added\n\n- a\n\n## 1.2.0 - Jan 5, 2026\n\n### Stuff\n\n- b\n\n### Fixed\n\n## Unreleased\n\n### Added\n\n- c", "# Log\n\n## Unreleased\n\n### Added\n\n- c\n\n## 1.2.0 - 2026-02-01\n\n### Fixed\n\n- b\n\n## 1.0.0 - 2026-01-01\n\n### Added\n\n- a", 5),
    "RIF009": ("Text.\n\n- only\n\nText.", "- a\n- b", 1),
    "RIF010": ("The team is cross-functional. The report is data-driven.", "The team is cross-functional. It is read-only.", 2),
    "CLR001": (words(50) + ".", words(40) + ".", 1),
    "CLR002": (" ".join(["Institutional considerations necessitate methodological reconfiguration notwithstanding epistemological heterogeneity throughout organizational jurisdictions and infrastructures everywhere."] * 4), " ".join(["The cat sat on the mat by the old red door of the house in the sun."] * 4), 1),
    "CLR003": ("One two three four five six seven eight.\n\nSomething else is here.\n\nONE two three four five six seven eight!", "One two three.\n\nOne two three.", 1),
    "CLR004": ("We use one instead of many. This rather than that. It is not large, but loud.", "We use one instead of many. " + words(30), 3),
    "CLR005": (" ".join(["The dog ran to the old house."] * 30), " ".join(["The dog ran to the old house."] * 5), 1),
    "CLR006": ("\n\n".join([words(40) + "."] * 9), "\n\n".join(words(n) + "." for n in (15, 80, 20, 200, 16, 90, 30, 150, 18)), 1),
    "CLR007": ("\n\n".join(["A " + words(20) + ". A " + words(20) + ". So it goes."] * 6), "\n\n".join(["A " + words(20) + ". A " + words(20) + ". It goes."] * 6), 6),
    "CLR008": (sections(150, 160, 140, 155), sections(400, 60, 250, 30), 1),
    "CLR009": (" ".join(["It ran."] * 9), " ".join(["It ran."] * 8), 1),
    "CLR010": ("**" + words(200) + "** " + words(300), "**" + words(100) + "** " + words(450), 1),
    "CLR011": (words(400), "# Head\n\n" + words(400), 1),
    "CLR012": ("# A title that is quite right\n\n" + words(41), "# A title that is quite right\n\n" + words(20), 1),
    "CLR013": (" ".join(["The guard plainly refuses and nothing else reaches the honest seam of the day."] * 14), " ".join(["The man went to the house by the river and saw the old boat there."] * 14), 1),
    "CLR014": ("A shopping cart is an object in the system. A chat room is an object in the system.", "A cart is an object. The room was full of people and light.", 1),
    "CLR015": ("It was a message. It was a permission slip. It was an out.", "It was a message. It was a slip. There was an out.", 1),
}


def test_every_rule_has_a_case():
    assert set(CASES) == set(CHECKS)


@pytest.mark.parametrize("code", sorted(CASES))
def test_rule(spark, code):
    fires, quiet, n = CASES[code]
    c = make(spark, fires, quiet)
    rows = CHECKS[code](c).collect()
    assert [r["doc_id"] for r in rows] == [0] * n, rows
    assert all(r["code"] == code and r["message"] and r["line"] >= 1 for r in rows)


def test_clauses_and_lead_in(spark):
    c = make(spark, "We wanted something to fix, something to ship, something to forget.")
    assert CHECKS["CLR015"](c).first()["message"] == "three clauses in a row open with 'something to'"


def test_duplicate_points_at_the_first(spark):
    r = CHECKS["CLR003"](make(spark, CASES["CLR003"][0])).first()
    assert r["message"] == "duplicates the paragraph at 1:1" and r["line"] == 5


def test_wrapped_match_has_line_and_column(spark):
    r = CHECKS["RIF004"](make(spark, "First line here\nand then as you\nrequested it.")).first()
    assert (r["line"], r["col"]) == (2, 10)


def test_repeating_a_document_changes_nothing(spark):
    text = CASES["CLR003"][0] + "\n\n" + CASES["CLR004"][0]
    one = lint(make(spark, text), Settings(semantic=False)).findings.drop("doc_id", "path").collect()
    two = lint(make(spark, text, text), Settings(semantic=False)).findings.where("doc_id = 1").drop("doc_id", "path").collect()
    assert sorted(map(str, one)) == sorted(map(str, two))


def test_empty_corpus(spark):
    c = make(spark, "# x")
    c.blocks = c.blocks.limit(0)
    for code, f in CHECKS.items():
        assert f(c).count() == 0, code


def test_catalog():
    rules = check(catalog())
    assert len(rules) == 107 and sum(r.kind == "semantic" for r in rules) == 82
    assert sum(r.default for r in rules if r.kind == "semantic") == 36 and sum(r.default for r in rules if r.kind == "static") == 17
    assert [r.code for r in active(rules, select=("RIF",), ignore=("RIF00",))] == ["RIF010"]
    assert all(r.kind == "static" for r in active(rules, semantic=False))
    assert {r.code for r in active(rules, extend_select=("CLR002",))} >= {"CLR002", "CLR001"}
    assert "JEV013" in explain("jev013") and "10%" in explain("JEV013")


def test_gate(spark):
    docs = spark.createDataFrame([(0, "a", None), (1, "b", "presentation"), (2, "c", "documentation")], "doc_id bigint, path string, doc_type string")
    f = spark.createDataFrame([(d, code) for d in range(3) for code in ("CLR012", "CLR010", "CLR001")], "doc_id bigint, code string")
    got = {(r["doc_id"], r["code"]) for r in gated(f, docs, catalog()).collect()}
    assert got == {(0, "CLR012"), (0, "CLR010"), (0, "CLR001"), (1, "CLR012"), (1, "CLR001"), (2, "CLR010"), (2, "CLR001")}


def test_custom_rules(spark):
    specs = ({"code": "ORG001", "phrases": ["side room"], "summary": "house style"}, {"code": "ORG002", "type": "regex", "pattern": "ab+c"}, {"code": "ORG003", "type": "question", "question": "Is it?", "scope": "paragraph"})
    rules = rules_of(Settings(rules=specs, select=("ORG",)))
    assert [r.code for r in rules] == ["ORG001", "ORG002", "ORG003"]
    run = lint(make(spark, "The Side room and abbc."), Settings(rules=specs, select=("ORG",), semantic=False))
    assert sorted(r["code"] for r in run.findings.collect()) == ["ORG001", "ORG002"]
    for bad in ({"phrases": ["x"]}, {"code": "RIF001", "phrases": ["x"]}, {"code": "A1", "type": "regex", "pattern": "("}, {"code": "A1", "type": "x"}, {"code": "A1", "phrases": ["x"], "blocks": "some"}, {"code": "A1"}):
        with pytest.raises(ValueError):
            rules_of(Settings(rules=(bad,)))


def test_sections_without_words(spark):
    """Four sections in a script without ASCII words have no variation; those beside them are still found."""
    bare = "# 題\n\n" + "\n\n".join(f"## 部分 {x}\n\n- 水車的閘門" for x in "甲乙丙丁")
    assert [r["doc_id"] for r in CHECKS["CLR008"](make(spark, bare, CASES["CLR008"][0])).collect()] == [1]
