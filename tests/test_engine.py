"""Parsers, planner, scoring, comparison, reports, settings, streams."""

import io
import json
import urllib.error
import zipfile

import pytest

from inkloom.operators import scoring, units
from inkloom.operators.compare import compare, ordered, rendered
from inkloom.operators.corpus import Corpus, peers
from inkloom.plans import report
from inkloom.plans.lint import Lint, lint
from inkloom.rules.catalog import Rule, catalog
from inkloom.settings import Settings, find_config, load_settings
from inkloom.sources.documents import blocks_of, corpus_of, fetch, is_url, read_files, read_urls
from inkloom.sources.parsers import parse_docx, parse_html, parse_md, parse_pptx, parse_txt, visuals_of
from inkloom.streaming.stream import lint_stream
from tests.test_rules import make, words


def brief(blocks):
    return [(b["kind"], b["text"], b["line"]) for b in blocks]


def test_markdown():
    text = "---\na: b\n---\n# Head #\n\nA *b*\nc.\n\n```\ncode\n```\n- x\n  y\n- **z** w\n| a | b |\n<p>html</p>\nSet\n===\n\n> quoted\n> line\n\n---\n"
    assert brief(parse_md(text)) == [("heading", "Head", 4), ("paragraph", "A b c.", 6), ("list_item", "x y", 12), ("list_item", "z w", 14), ("heading", "Set", 17), ("paragraph", "quoted line", 20), ("paragraph", "---", 23)]
    assert [b["text"] for b in parse_md(">> twice\n> > quoted\n\n> Set\n> so\n===")] == ["twice quoted", "Set so"]
    assert parse_md("- **z** w")[0]["bold"] and parse_md("```\nnever closed\n# x") == [] and parse_md("---\nnever closed") == []


def test_text():
    assert brief(parse_txt("one\n two\n\n\nthree")) == [("paragraph", "one two", 1), ("paragraph", "three", 5)]


PAGE = """<html><head><title>T</title><script>x</script></head><body><header><p>Top of the site</p></header><nav><ul><li>Home</li></ul></nav>
<main><h1>Head</h1><div><p><b>Bold</b> lead, and a paragraph that is long enough to count.</p><p>Another paragraph that is long enough to count as well.</p></div>
<section><p>Related</p></section></main><footer><p>© us</p></footer></body></html>"""


def test_html():
    kinds = [(b["kind"], b["text"]) for b in parse_html(PAGE)]
    assert ("title", "T") in kinds and ("list_item", "Home") in kinds and not any("x" == t for _, t in kinds)
    main = parse_html(PAGE, main_content=True)
    assert [b["text"][:7] for b in main] == ["Head", "Bold le", "Another"] and main[1]["bold"] and main[0]["label"] == "block 1"
    assert parse_html("<p>a<b>unclosed<p>b</p>") and parse_html("") == []
    deep = "<div>" * 50_000 + "<blockquote>" * 3_000 + "<p>down here</p>"
    assert [b["text"] for b in parse_html(deep)] == ["down here"] == [b["text"] for b in parse_html(deep, main_content=True)]


def _zip(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="", b="": f'<w:p><w:pPr>{f"""<w:pStyle w:val="{s}"/>""" if s else ""}</w:pPr>' + (f"<w:r><w:rPr><w:b/></w:rPr><w:t>{b}</w:t></w:r>" if b else "") + f"<w:r><w:t>{t}</w:t></w:r></w:p>"
    data = _zip({"word/document.xml": f"<w:document {w}><w:body>{p('Head', 'Heading2')}{p(' rest', 'ListBullet', 'Lead')}{p('Body text.')}<w:tbl><w:tr><w:tc>{p('Cell')}</w:tc></w:tr></w:tbl></w:body></w:document>"})
    got = parse_docx(data)
    assert brief(got) == [("heading", "Head", 1), ("list_item", "Lead rest", 2), ("paragraph", "Body text.", 3), ("table_cell", "Cell", 0)]
    assert got[0]["level"] == 2 and got[1]["bold"] and got[3]["label"] == "table 1 r1c1"


def _deck():
    ns = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    para = lambda t, lvl=0, sz=0: f'<a:p><a:pPr lvl="{lvl}"/><a:r><a:rPr {f"""sz="{sz}" """ if sz else ""}/><a:t>{t}</a:t></a:r></a:p>'
    shape = lambda body, ph="": f'<p:sp><p:nvSpPr><p:nvPr>{f"""<p:ph type="{ph}"/>""" if ph else ""}</p:nvPr></p:nvSpPr><p:txBody>{body}</p:txBody></p:sp>'
    slide = lambda shapes: f"<p:sld {ns}><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>"
    rel = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
    return _zip({
        "ppt/presentation.xml": f'<p:presentation {ns}><p:sldIdLst><p:sldId id="256" r:id="r1"/><p:sldId id="257" r:id="r2"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rel.format('<Relationship Id="r1" Type="x/slide" Target="slides/slide1.xml"/><Relationship Id="r2" Type="x/slide" Target="slides/slide2.xml"/>'),
        "ppt/slides/slide1.xml": slide(shape(para("Revenue grew"), "title") + shape(para("Body") + para("Bullet", 1))),
        "ppt/slides/slide2.xml": slide(shape(para("small words here", sz=1200)) + shape(para("Costs fell again", sz=3200)) + "<p:pic/>"),
        "ppt/slides/_rels/slide1.xml.rels": rel.format('<Relationship Id="r9" Type="x/notesSlide" Target="../notesSlides/notesSlide1.xml"/>'),
        "ppt/notesSlides/notesSlide1.xml": slide(shape(para("Say this"), "body")),
    })


def test_pptx():
    got = parse_pptx(_deck())
    assert brief(got) == [("title", "Revenue grew", 1), ("paragraph", "Body", 1), ("list_item", "Bullet", 1), ("notes", "Say this", 1), ("paragraph", "small words here", 2), ("title", "Costs fell again", 2)]
    assert visuals_of(_deck()) == {2: 1}


def test_read_files_and_errors(spark, tmp_path):
    (tmp_path / "a.md").write_text("# One\n\nTwo words.")
    (tmp_path / "b.docx").write_bytes(b"not a zip")
    (tmp_path / "c.xyz").write_text("?")
    docs = read_files(spark, str(tmp_path))
    c, errors = corpus_of(docs)
    assert errors.count() == 2 and c.blocks.count() == 2
    run = lint(c, Settings(semantic=False), errors=errors)
    assert report.exit_code(run) == 2
    assert blocks_of(docs.limit(0)).count() == 0


def test_urls():
    assert is_url("HTTP://x") and not is_url("ftp://x")
    with pytest.raises(ValueError):
        fetch("file:///etc/passwd")


NESTED = "Lead text.\n\n# A\n\none\n\n## B\n\ntwo\n\n### C\n\nthree\n\n## D\n\nfour\n\n# E\n\nfive"


def test_sections(spark):
    c = make(spark, NESTED)
    s = {r["title"]: r for r in c.sections.collect()}
    assert [s[t]["sec_no"] for t in (None, "A", "B", "C", "D", "E")] == [0, 1, 2, 3, 4, 5]
    assert s["A"]["body"] == "one\n\ntwo\n\nthree\n\nfour" and s["B"]["body"] == "two\n\nthree" and s["A"]["children"] == 2 and s["C"]["parent_pos"] == s["B"]["title_pos"]
    lines = [r["line_text"] for r in report.outline_lines(c.sections, c.docs).orderBy("k").collect()]
    assert lines[0] == "d0.md (md: 6 blocks, 6 sections)" and lines[3].startswith("    B [1 blocks, 2 words]")


def test_peers_and_dividers(spark):
    c = make(spark, "\n\n".join(f"## Name {x}\n\n{words(5)}" for x in "abcd") + "\n\n## Divider\n\n## Next\n\nPart 2")
    assert peers(c.sections).count() == 4
    assert {r["title"] for r in c.sections.where("divider").collect()} == {"Divider", "Next"}


def test_dividers_need_no_bodies(spark):
    """What a section opens with decides, however it is spread over blocks and parts below; asking for it gathers no bodies."""
    heads = {
        "Part": ["Part", "3 begins"], "Parts": ["Part one", "3"], "Blank": [" \u00a0", "\u2003\n"], "Late": ["\u00a0", "\u3000chapter\u00a0\u2003iv: x"], "Word": ["Unit 12b"],
        "Sub": ["# Below", "module", "7"], "Split": ["act", "# Below", "5 now"], "Far": ["act", " ", "# Below", "", "we"], "List": ["Act 1234"], "None": [],
    }
    rows = []
    for title, texts in heads.items():
        rows.append((title, "heading", 1))
        rows += [(t.lstrip("# "), "heading", 2) if t.startswith("#") else (t, "paragraph", 0) for t in texts]
    docs = spark.createDataFrame([(1, "a", "md", None)], "doc_id bigint, path string, format string, doc_type string")
    c = Corpus.of(docs, spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "doc_id bigint, pos int, text string, kind string, level int"))
    assert {r["title"] for r in c.sections.where("divider and level = 1").collect()} == {"Part", "Blank", "Late", "Sub", "Split", "None"}
    told = c.sections.select("title", "divider", "prose_words")._jdf.queryExecution().optimizedPlan().toString()
    assert " AS body" not in told and " AS body" in c.sections._jdf.queryExecution().optimizedPlan().toString()


def test_plan(spark):
    rules = [Rule("X1", "x", "semantic", True, "block", "text", "s", 0.5), Rule("X2", "x", "semantic", True, "block", "text", "s", 0.5, fragments=True), Rule("X3", "x", "semantic", True, "title", "text", "s", 0.5), Rule("X4", "x", "semantic", True, "section", "text", "s", 0.5), Rule("X5", "x", "semantic", True, "document", "outline", "s", 0.5), Rule("X6", "x", "semantic", True, "document", "structure", "s", 0.5), Rule("X7", "x", "semantic", True, "sentence", "text", "s", 0.5), Rule("X8", "x", "semantic", True, "document", "text", "s", 0.5)]
    c = make(spark, f"# First title\n\n{words(20)}.\n\n# Second title\n\n{words(9)}.\n\n# Third title\n\n{words(5)}.")
    u = units.plan(c, rules).collect()
    n = {}
    for r in u:
        n[r["unit_scope"], r["view"]] = n.get((r["unit_scope"], r["view"]), 0) + 1
    assert n == {("block", "text"): 2, ("sentence", "text"): 2, ("title", "text"): 3, ("section", "text"): 1, ("document", "text"): 1, ("document", "outline"): 1, ("document", "structure"): 1}
    title = json.loads(next(r for r in u if r["unit_scope"] == "title" and r["sec_no"] == 1)["state"])
    assert title == {"kind": "section heading (level 1)", "title": "First title", "position": "1 of 3", "words_under_it": 20, "opening": " ".join(["word"] * 14) + " ..."}
    outline = json.loads(next(r for r in u if r["view"] == "outline")["state"])["outline"]
    assert outline.splitlines()[1] == "2. (section 2) Second title"
    short = {r["anchor_pos"]: r["codes"] for r in units.plan(c, rules, min_words=4).collect() if r["unit_scope"] == "block"}
    assert short[5] == ["X2"] and short[1] == ["X1", "X2"]


def test_attempt_retries():
    seen = []

    def flaky(state, questions):
        seen.append(1)
        if len(seen) < 3:
            raise urllib.error.HTTPError("u", 503 if len(seen) == 1 else 429, "m", {}, io.BytesIO(b"busy"))
        return {"A": 0.9}

    assert scoring.attempt(flaky, "s", {"A": "?"}, sleep=lambda s: None) == ("ok", {"A": 0.9}, "") and len(seen) == 3

    def always(code, text):
        def f(state, questions):
            raise urllib.error.HTTPError("u", code, "m", {}, io.BytesIO(text))

        return f

    assert scoring.attempt(always(503, b"x"), "s", {}, sleep=lambda s: None)[0] == "error"
    assert scoring.attempt(always(400, b"maximum context length exceeded"), "s", {}, sleep=lambda s: None)[0] == "context_exceeded"
    assert scoring.attempt(always(401, b"no key"), "s", {}, sleep=lambda s: None)[0] == "error"


def _hot(state, questions):
    return {c: 0.95 if "hot" in state else 0.05 for c in questions}


def test_lint_with_a_model(spark):
    c = make(spark, "This is a hot paragraph of more than eight words.\n\nThis is a cold paragraph of more than eight words.")
    run = lint(c, Settings(select=("JEV001", "JEV002"), thresholds={"JEV002": 0.99}, classify=False), scorer=_hot)
    rows = run.ordered().collect()
    assert [(r["code"], r["line"], r["value"]) for r in rows] == [("JEV001", 1, 0.95)]
    assert run.stats().first()["calls"] == 2 and report.exit_code(run) == 1
    assert "2 calls" in report.model_note(run)


def test_share_below(spark):
    text = "\n\n".join(["This is a cold paragraph of more than eight words."] * 11 + ["This is a hot paragraph of more than eight words."])
    got = lint(make(spark, text, text.replace("cold", "hot")), Settings(select=("JEV013",), classify=False), scorer=_hot).findings.collect()
    assert [(r["doc_id"], r["pos"], r["value"], r["snippet"]) for r in got] == [(0, 0, None, "")]


def test_compare(spark):
    rows = [(1, "The price was 1,200 for Acme, said \"the lead man\". It is the fastest; nobody may fail. See `x()`.", "The price was 300 for Bravo, he said. It is fast; we fail."), (2, "Two dogs of Rome.", "2 dogs of Rome."), (3, None, "")]
    pairs = spark.createDataFrame(rows, "pair_id bigint, source string, rewrite string")
    got = [(r["pair_id"], r["direction"], r["kind"], r["token"]) for r in ordered(compare(pairs)).collect()]
    assert got == [(1, "LOST", "name", "Acme"), (1, "LOST", "number", "1200"), (1, "LOST", "quoted", "the lead man"), (1, "LOST", "verbatim", "`x()`"), (1, "ADDED", "name", "Bravo"), (1, "ADDED", "number", "300"), (1, "COUNT", "hedge", "hedge total"), (1, "COUNT", "superlative", "superlative total")]
    assert compare(pairs, waive=("acme", "bravo")).where("kind = 'name'").count() == 0
    assert "Acme" in rendered(compare(pairs)).first()["report"]


def test_reports(spark):
    run = lint(make(spark, "# Understanding The Impact Of Modern Technology\n\n" + words(50) + "."), Settings(semantic=False))
    assert report.exit_code(run) == 1 and "CLR001 x1" in report.summary(run)
    doc = json.loads(report.json_report(run).first()["report"])
    assert [f["code"] for f in doc["findings"]] == ["RIF002", "CLR001"] and doc["doc_type_source"] == "unresolved"
    lines = report.text_lines(run.findings, run.docs).orderBy("k").collect()
    assert lines[0]["line_text"].startswith("d0.md:1:1: RIF002 heading")
    clean = Lint(run.docs, run.findings.limit(0))
    assert report.exit_code(clean) == 0 and report.summary(clean) == "All checks passed"
    labels = spark.createDataFrame([(0, "a")], "doc_id bigint, label string")
    assert report.by_label(run.findings, labels).count() == 2
    tables = report.rules_tables(catalog())
    assert sum(x.startswith("| CLR") or x.startswith("| RIF") for x in tables) == 25 and sum(x.startswith("| JEV") for x in tables) == 82
    probed = report.probe(lambda s, q: {c: float(s != report.CONTROL) for c in q}, catalog())
    assert len({c for c, _, _ in probed}) == 82 and len(probed) > 164 and all((p == 1) == (which == "example") for _, which, p in probed)


def test_settings(tmp_path):
    assert Settings().max_sentence_words == 45 and Settings().max_reading_grade == 14.0
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    (tmp_path / "pyproject.toml").write_text("[tool.inkloom]\nmax-sentence-words = 30\nselect = ['RIF']\n[tool.inkloom.thresholds]\nJEV001 = 0.9\n")
    (tmp_path / "a" / "pyproject.toml").write_text("not toml [")
    s = load_settings(find_config(deep))
    assert s.max_sentence_words == 30 and s.select == ("RIF",) and s.threshold_for("JEV001", 0.5) == 0.9 and s.threshold_for("X", 0.5) == 0.5
    assert s.with_options(ignore=("A",)).with_options(ignore=("B",)).ignore == ("A", "B")
    (tmp_path / "bad.toml").write_text("nonsense = 1")
    with pytest.raises(ValueError):
        load_settings(tmp_path / "bad.toml")


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "md", bytearray(b"# Understanding The Impact Of Modern Technology"))], "doc_id bigint, format string, content binary").write.parquet(str(tmp_path / "in"))
    got = []
    docs = spark.readStream.schema("doc_id bigint, format string, content binary").parquet(str(tmp_path / "in"))
    lint_stream(docs, lambda f, i: got.extend(r["code"] for r in f.collect()), str(tmp_path / "ck")).awaitTermination(120)
    assert got == ["RIF002"]


def _reports_only(state, questions):
    return {c: (("report" if "mill" in state else "novel"), 0.3) if isinstance(q, dict) else 0.1 for c, q in questions.items()}


def test_the_model_says_what_type_a_document_has(spark, monkeypatch):
    monkeypatch.setitem(scoring.SCORERS, "fixed", lambda name: _reports_only)
    for scorer, model in ((_reports_only, None), (None, "fixed:x")):
        docs = lint(make(spark, "The old mill stands by the river.", "The cat sat on the mat."), Settings(select=("JEV001",), model=model), scorer=scorer).docs.collect()
        assert sorted((r["doc_type_source"], r["doc_type"], r["doc_type_confidence"]) for r in docs) == [("classified", "report", 0.3), ("unresolved", None, None)]


def test_types_decide_which_rules_are_asked(spark):
    """JEV610 is only for reports and memos, and a report that the model recognises is asked about it."""

    def model(state, questions):
        return {c: ("report" if "mill" in state else "poem", 0.9) if isinstance(q, dict) else 0.9 for c, q in questions.items()}

    texts = ("The old mill by the river was mended in the spring of last year.", "The cat sat on the mat and looked at the wide and empty sea.")
    got = lint(make(spark, *texts), Settings(select=("JEV610", "JEV650")), scorer=model).findings.collect()
    assert sorted((r["doc_id"], r["code"]) for r in got) == [(0, "JEV610"), (1, "JEV650")]


def test_nothing_is_asked_without_a_model(spark, monkeypatch):
    monkeypatch.delenv(scoring.URL, raising=False)
    c = make(spark, "The pump was fixed on Monday and the road is open again for all cars.")
    for model in (None, "keyed:judge", "judge", "unknown:x"):
        with pytest.raises(ValueError):
            lint(c, Settings(model=model))
    assert lint(c, Settings(semantic=False)).findings.count() == 0
    assert lint(c, Settings(select=("CLR",))).findings.count() == 0
    assert lint(c, Settings(select=("JEV001",), model="hash", classify=False)).decisions.count() == 1


def test_every_semantic_rule_has_a_question_of_its_own():
    rules = [r for r in catalog() if r.kind == "semantic"]
    assert len(rules) == 82 == len({r.question for r in rules})
    assert all(r.question.split("\n")[0].endswith("?") and r.why and r.shows for r in rules)


class _Served:
    """A server of pages and decisions."""

    def __init__(self):
        import http.server
        import threading

        served = self

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_GET(self):
                ok = self.path == "/page"
                body = PAGE.encode() if ok else b"{}"
                self.send_response(404 if self.path == "/gone" else 200)
                self.send_header("Content-Type", "text/html; charset=utf-8" if ok or self.path == "/gone" else "application/json")
                self.end_headers()
                self.wfile.write(body)

            def do_POST(self):
                asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                served.asked.append((self.headers.get("Authorization"), asked))
                if isinstance(asked["questions"], dict):
                    reply = {"answers": {c: {"type": "choice", "choice": "memo", "confidence": 0.4} if q["type"] == "choice" else {"type": "noul", "noul": 0.95} for c, q in asked["questions"].items()}}
                else:
                    reply = {"answers": [{"type": "choice", "name": q["name"], "choice": "memo", "confidence": 0.4} if q["type"] == "choice" else {"type": "predicate", "name": q["name"], "probability": 0.95} for q in asked["questions"]]}
                self.send_response(200)
                self.end_headers()
                self.wfile.write(json.dumps(reply).encode())

            def log_message(self, *_):
                pass

        self.asked = []
        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_address[1]}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()


@pytest.fixture(scope="module")
def served():
    s = _Served()
    yield s
    s.server.shutdown()


@pytest.mark.parametrize("model", ["keyed:judge", "judge", "listed:judge"])
def test_models_behind_an_address(spark, served, monkeypatch, model):
    monkeypatch.setenv(scoring.URL, served.url)
    monkeypatch.setenv(scoring.KEY, "secret")
    served.asked.clear()
    run = lint(make(spark, "The old mill by the river was mended in the spring of last year."), Settings(select=("JEV001", "JEV610"), model=model))
    assert sorted(r["code"] for r in run.findings.collect()) == ["JEV001", "JEV610"]
    assert [r["doc_type"] for r in run.docs.collect()] == ["memo"]
    assert all(key == "Bearer secret" and body["model"] == "judge" for key, body in served.asked)
    assert "would cost the reader no information?" in json.dumps([body for _, body in served.asked])


def test_pages_that_fail_are_errors_and_only_web_pages_lose_their_frame(spark, served, tmp_path):
    urls = [f"{served.url}/{x}" for x in ("page", "gone", "data")]
    local = tmp_path / "local.html"
    local.write_text(PAGE)
    c, errors = corpus_of(read_urls(spark, urls).unionByName(read_files(spark, str(local))))
    assert c.blocks.where("text = 'Home'").count() == 1  # of the local file
    assert c.blocks.where("text = 'Head'").count() == 2
    assert sorted(r["error"].split(":")[0] for r in errors.collect()) == ["HTTPError", "ValueError"]
    run = lint(c, Settings(semantic=False), errors=errors)
    assert report.exit_code(run) == 2


def test_sections_of_a_long_document(spark):
    """Ends, parents, bodies and numbers of children against a plain reading."""
    import random

    rnd = random.Random(5)
    kinds = [(rnd.random() < 0.3, rnd.randint(1, 4)) for _ in range(400)]
    rows = [(1, i, f"H{i}" if head else f"body {i}", "heading" if head else rnd.choice(("paragraph", "list_item")), lv if head else 0) for i, (head, lv) in enumerate(kinds)]
    docs = spark.createDataFrame([(1, "a", "md", None)], "doc_id bigint, path string, format string, doc_type string")
    c = Corpus.of(docs, spark.createDataFrame(rows, "doc_id bigint, pos int, text string, kind string, level int"))
    got = {r["title_pos"]: r for r in c.sections.collect()}
    heads = [i for i, (head, _) in enumerate(kinds) if head]
    assert set(got) == {*heads, *([None] if heads[0] > 0 else [])}
    for n, i in enumerate(heads):
        r = got[i]
        end = next((j for j in heads if j > i and kinds[j][1] <= kinds[i][1]), len(kinds)) - 1
        own = (heads[n + 1] if n + 1 < len(heads) else len(kinds)) - 1
        parent = next((j for j in reversed(heads[:n]) if kinds[j][1] < kinds[i][1]), None)
        bodies = [t for _, p, t, k, _ in rows if i < p <= end and k != "heading"]
        assert (r["sec_no"], r["own_end"], r["sub_end"], r["parent_pos"]) == (n + 1, own, end, parent)
        assert r["body"] == "\n\n".join(bodies) and r["prose_words"] == 2 * len(bodies) and r["own_blocks"] == own - i
        assert r["children"] == sum(next((j for j in reversed([h for h in heads if h < x]) if kinds[j][1] < kinds[x][1]), None) == i for x in heads)
