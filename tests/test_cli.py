"""The command line, and the parts that only it and real models use."""

import json

import pytest

from inkloom import cli
from inkloom.operators import scoring, units
from inkloom.rules.catalog import Rule
from inkloom.sources.documents import corpus_of
from tests.test_engine import _deck
from tests.test_rules import words


def test_rules_and_usage(capsys):
    assert cli.main(["--list-rules"]) == 0 and capsys.readouterr().out.count("\n") == 107
    assert cli.main(["--explain", "CLR001"]) == 0 and "long-sentence" in capsys.readouterr().out
    assert cli.main(["--explain", "NOPE"]) == 2 and cli.main([]) == 2
    capsys.readouterr()
    assert cli.main(["--explain", "jev006"]) == 0
    out = capsys.readouterr().out
    assert "Asked:" in out and "In conclusion, the ferry" in out and "p >= 0.7" in out
    with pytest.raises(SystemExit):
        cli.main(["--version"])


def test_no_model_no_findings(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.delenv(scoring.URL, raising=False)
    f = tmp_path / "a.md"
    f.write_text("The pump was fixed on Monday and the road is open again for all cars.")
    assert cli.main([str(f)]) == 2 and cli.main([str(f), "--model", "keyed:judge"]) == 2
    said = capsys.readouterr()
    assert "--no-model" in said.err and said.out == ""


def test_each_file_has_the_configuration_nearest_to_it(spark, tmp_path, capsys):
    text = words(40) + "."
    for name, limit in (("a", 30), ("a/b", 60), ("c", None)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.md").write_text(text)
        if limit:
            (tmp_path / name / "inkloom.toml").write_text(f"max-sentence-words = {limit}\nselect = ['CLR001']\n")
    (tmp_path / "inkloom.toml").write_text("max-sentence-words = 35\nselect = ['CLR001']\n")
    assert cli.main([str(tmp_path)]) == 1
    out = capsys.readouterr().out
    assert "a/x.md:1:1: CLR001" in out and "c/x.md:1:1: CLR001" in out and "a/b/x.md" not in out
    assert cli.main([str(tmp_path / "a/b/x.md"), str(tmp_path / "none.md"), "-q"]) == 2 and "no such file" in capsys.readouterr().err
    assert cli.main([str(tmp_path), "--config", str(tmp_path / "a/b/inkloom.toml"), "-q"]) == 0


def test_lint(spark, tmp_path, capsys):
    f = tmp_path / "a.md"
    f.write_text("# Understanding The Impact Of Modern Technology\n\n" + words(50) + ".")
    assert cli.main([str(f), "--no-model"]) == 1
    out = capsys.readouterr().out
    assert "RIF002" in out and "CLR001" in out and "2 finding(s)" in out
    assert cli.main([str(f), "--no-model", "--ignore", "RIF002", "--max-sentence-words", "60"]) == 0
    assert "All checks passed" in capsys.readouterr().out
    assert cli.main([str(f), "--no-model", "--format", "json", "-q"]) == 1
    assert len(json.loads(capsys.readouterr().out)["findings"]) == 2
    assert cli.main([str(f), "--outline"]) == 0 and "Understanding" in capsys.readouterr().out
    assert cli.main([str(tmp_path / "none.md")]) == 2 and cli.main([str(f), "--min-words", "0"]) == 2


def test_compare(spark, tmp_path, capsys):
    a, b = tmp_path / "a.md", tmp_path / "b.md"
    a.write_text("It cost 12 crowns in Rome.")
    b.write_text("It cost 13 crowns in Rome.")
    assert cli.main(["--compare", str(a), str(b)]) == 1 and "'12'" in capsys.readouterr().out
    assert cli.main(["--compare", str(a), str(b), "--waive", "1"]) == 0
    assert cli.main(["--compare", str(a), str(a)]) == 0 and "every claim survives" in capsys.readouterr().out


def test_visuals_reach_the_model(spark):
    docs = spark.createDataFrame([(1, "pptx", bytearray(_deck()))], "doc_id bigint, format string, content binary")
    c, _ = corpus_of(docs)
    rules = [Rule("X", "x", "semantic", True, "section", "text", "s", 0.5)]
    got = [json.loads(r["state"]) for r in units.plan(c, rules, min_words=1).collect()]
    assert {g["title"]: g.get("charts_or_images") for g in got} == {"Revenue grew": None, "Costs fell again": "1 (not shown; only the text is)"}


def test_listed_questions():
    asked = {"A": "Is it?", "B": {"question": "Which?", "note": "One only.", "choices": {"x": "first", "y": {"question": "second"}}}}
    a, b = scoring.listed_questions(asked)
    assert a == {"type": "predicate", "name": "A", "instructions": "Is it?"}
    assert b["type"] == "choice" and b["instructions"] == "Which?\nNote: One only." and b["choices"][1] == {"value": "y", "description": "second"}
    good = {"answers": [{"type": "predicate", "name": "A", "probability": 0.4}, {"type": "choice", "name": "B", "choice": "x", "confidence": 0.9}]}
    assert scoring.listed_answers(good, asked) == {"A": 0.4, "B": ("x", 0.9)}
    for bad in ({"answers": good["answers"][:1]}, {"answers": [{"type": "refusal", "name": "A"}]}, {"answers": [{"type": "choice", "name": "A", "choice": "x", "confidence": 1}]}):
        with pytest.raises(ValueError):
            scoring.listed_answers(bad, asked)
