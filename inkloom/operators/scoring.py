"""Asking a model, and turning probabilities into findings.

A scorer takes (state, {code: question}) and returns {code: probability}, or {code: (choice, confidence)} for questions with choices. It runs inside the tasks,
over batches, with its own retries; what fails is counted and never becomes a finding. Without a model nothing is asked: a run that needs one stops. ``hash_scorer``
is a stand-in for tests that has to be named; it is reproducible, not a judge.
"""

from __future__ import annotations

import json
import os
import re
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.operators.units import MAX_TOKENS
from inkloom.rules.catalog import TYPES, Rule, rules_df
from inkloom.settings import Settings

Scorer = Callable[[str, Mapping[str, object]], Mapping[str, object]]
RETRIED = {408, 409, 429, 500, 502, 503, 504, 529}
RETRIES, FIRST_DELAY, TIMEOUT = 3, 0.5, 60.0
_OVERFLOW = re.compile(r"context|too (?:long|large|many tokens)|maximum.*tokens", re.I)


class ContextExceeded(Exception):
    pass


def hash_scorer(state: str, questions: Mapping[str, object]) -> dict[str, object]:
    """crc32 of code and state, in hundredths; of choices the one that it falls on."""
    out: dict[str, object] = {}
    for code, q in questions.items():
        h = zlib.crc32(f"{code}\x00{state}".encode())
        choices = _choices(q)
        out[code] = (list(choices)[h % len(choices)], h % 100 / 100) if choices else h % 100 / 100
    return out


def _choices(question: object) -> Mapping[str, str]:
    return question.get("choices", {}) if isinstance(question, Mapping) else {}


def http_scorer(url: str, model: str, key: str = "") -> Scorer:
    """A model behind HTTP: posts {model, state, questions: {code: {type, instructions}}}, and reads {code: probability}, {code: {noul: probability}} or {code: {choice, confidence}}."""

    def told(q: object) -> dict:
        if _choices(q):
            return {"type": "choice", "instructions": {k: v for k, v in q.items() if k != "choices"}, "criteria": dict(_choices(q))}
        return {"type": "noul", "instructions": {"question": q} if isinstance(q, str) else q}

    def answer(a: object) -> object:
        if isinstance(a, Mapping) and "choice" in a:
            return a["choice"], float(a["confidence"])
        return float(a.get("noul", a.get("probability")) if isinstance(a, Mapping) else a)

    def ask(state: str, questions: Mapping[str, object]) -> dict[str, object]:
        body = json.dumps({"model": model, "state": state, "questions": {c: told(q) for c, q in questions.items()}}).encode()
        request = urllib.request.Request(url, body, {"Content-Type": "application/json", **({"Authorization": f"Bearer {key}"} if key else {})})
        with urllib.request.urlopen(request, timeout=TIMEOUT) as response:
            answers = json.load(response)
        answers = answers.get("answers", answers)
        return {c: answer(a) for c, a in answers.items() if c in questions}

    return ask


def listed_questions(questions: Mapping[str, object]) -> list[dict]:
    """Questions as a list of predicates and choices: a text or mapping is a predicate, a mapping with ``choices`` a choice. Mappings become text, the question first."""

    def told(x) -> str:
        if not isinstance(x, Mapping):
            return str(x)
        rest = [f"{k.replace('_', ' ').capitalize()}: {v}" for k, v in x.items() if k not in ("question", "choices")]
        return "\n".join(([str(x["question"])] if "question" in x else []) + rest)

    out = []
    for name, x in questions.items():
        one = {"type": "predicate", "name": name, "instructions": told(x)}
        if isinstance(x, Mapping) and "choices" in x:
            one |= {"type": "choice", "choices": [{"value": v, "description": told(t)} for v, t in x["choices"].items()]}
        out.append(one)
    return out


def listed_answers(payload: Mapping, questions: Mapping[str, object]) -> dict[str, object]:
    """name -> probability, or (choice, confidence); a refusal, a missing or an extra answer is an error."""
    out: dict[str, object] = {}
    for a in payload["answers"]:
        if a["type"] == "refusal":
            raise ValueError(f"refused: {a.get('name')}")
        chosen = isinstance(questions[a["name"]], Mapping) and "choices" in questions[a["name"]]
        if (a["type"] == "choice") != chosen:
            raise ValueError(f"{a['name']} was answered as {a['type']}")
        out[a["name"]] = (a["choice"], float(a["confidence"])) if chosen else float(a["probability"])
    if out.keys() != questions.keys():
        raise ValueError("the answers don't match the questions")
    return out


def listed_scorer(url: str, model: str, key: str = "") -> Scorer:
    """A model that takes its questions as a list of predicates."""

    def ask(state: str, questions: Mapping[str, str]) -> dict[str, float]:
        body = json.dumps({"model": model, "input": state, "questions": listed_questions(questions)}).encode()
        request = urllib.request.Request(url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
        with urllib.request.urlopen(request, timeout=TIMEOUT) as response:
            return listed_answers(json.load(response), questions)

    return ask


URL, KEY = "INKLOOM_MODEL_URL", "INKLOOM_MODEL_KEY"  # environment of the driver


def _served(make: Callable[[str, str, str], Scorer]) -> Callable[[str], Scorer]:
    def by_name(model: str) -> Scorer:
        if URL not in os.environ:
            raise ValueError(f"the model {model} needs an address: set {URL}, and {KEY} if it asks for a key; or run with exact rules only (--no-model)")
        return make(os.environ[URL], model, os.environ.get(KEY, ""))

    return by_name


#: What stands before the colon of a model's name -> its scorer. Others may be added.
SCORERS: dict[str, Callable[[str], Scorer]] = {"keyed": _served(http_scorer), "listed": _served(listed_scorer)}


def resolve(name: str | None) -> Scorer:
    """A scorer by name, such as ``keyed:NAME`` for questions by key or ``listed:NAME`` for a list of them, or ``hash``, the stand-in. A name without a prefix is keyed; no name is an error."""
    if not name:
        raise ValueError("no model is named: name one (--model keyed:NAME or listed:NAME), or run with exact rules only (--no-model)")
    if name == "hash":
        return hash_scorer
    prefix, colon, rest = name.partition(":")
    if not colon:
        prefix, rest = "keyed", name
    if prefix not in SCORERS:
        raise ValueError(f"no scorer for {name}; known are {', '.join(sorted(SCORERS))} and hash")
    return SCORERS[prefix](rest)


def attempt(scorer: Scorer, state: str, questions: Mapping[str, str], sleep: Callable[[float], None] = time.sleep) -> tuple[str, Mapping[str, float], str]:
    """(status, answers, detail): ok, context_exceeded or error. Passing faults are tried again, with growing delays; a state that is too long is not."""
    for k in range(RETRIES + 1):
        try:
            return "ok", scorer(state, questions), ""
        except ContextExceeded as e:
            return "context_exceeded", {}, str(e)
        except urllib.error.HTTPError as e:
            text = e.read().decode("utf-8", "replace")
            if e.code == 400 and _OVERFLOW.search(text):
                return "context_exceeded", {}, text[:200]
            if e.code not in RETRIED or k == RETRIES:
                return "error", {}, f"{e.code} {text[:200]}"
        except (OSError, TimeoutError) as e:
            if k == RETRIES:
                return "error", {}, str(e)[:200]
        except Exception as e:  # noqa: BLE001 - one unit must not end the job
            return "error", {}, f"{type(e).__name__}: {e}"[:200]
        sleep(FIRST_DELAY * 2**k)
    raise AssertionError


DECISION = "doc_id bigint, unit_scope string, view string, anchor_pos int, sec_no int, snippet string, tokens bigint, status string, detail string, answers map<string,double>"


def decide(units: DataFrame, rules: list[Rule], scorer: Scorer, concurrency: int = 8) -> DataFrame:
    """One row per unit with its answers. Units over the token limit are skipped; ``concurrency`` requests are in flight in each task."""
    asked = {r.code: r.question or r.summary for r in rules if r.kind == "semantic"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(concurrency) as pool:
            for pdf in batches:

                def one(state: str, codes, tokens: int):
                    if tokens > MAX_TOKENS:
                        return "skipped", {}, ""
                    return attempt(scorer, state, {c: asked[c] for c in codes if c in asked})

                got = list(pool.map(one, pdf["state"], pdf["codes"], pdf["tokens"])) if scorer is not hash_scorer else [one(*x) for x in zip(pdf["state"], pdf["codes"], pdf["tokens"])]
                out = pdf.drop(columns=["state", "codes"])
                out["status"], out["detail"] = [g[0] for g in got], [g[2] for g in got]
                out["answers"] = [dict(g[1]) for g in got]
                yield out

    return units.mapInPandas(run, DECISION)


def answers(decisions: DataFrame) -> DataFrame:
    """(…, code, probability): every answer, as a debug view shows them."""
    return decisions.where("status = 'ok'").select("doc_id", "unit_scope", "view", "anchor_pos", "sec_no", "snippet", F.explode("answers").alias("code", "probability"))


def findings(decisions: DataFrame, blocks: DataFrame, rules: list[Rule], settings: Settings) -> DataFrame:
    """Findings of answers at or over their thresholds, at the unit's anchor; rules on shares fire once for a document of which few units show the trait."""
    r = rules_df(decisions.sparkSession, rules).select("code", "summary", "threshold", "share_below")
    override = F.create_map(*(F.lit(x) for kv in settings.thresholds.items() for x in kv)) if settings.thresholds else None
    limit = F.col("threshold") if override is None else F.coalesce(override[F.col("code")], F.col("threshold"))
    a = answers(decisions).join(F.broadcast(r), "code").withColumn("limit", limit)  # one row per rule
    at = blocks.select("doc_id", F.col("pos").alias("anchor_pos"), "line", "col", "label")
    message = F.regexp_replace("summary", r"\.$", "")
    each = a.where("share_below is null and probability >= limit").join(at, ["doc_id", "anchor_pos"])
    shares = a.where("share_below is not null").groupBy("doc_id", "code", "summary", "share_below").agg(F.count("*").alias("n"), F.sum((F.col("probability") >= F.col("limit")).cast("int")).alias("hits")).where("n >= 8 and hits / n <= share_below")
    first = blocks.groupBy("doc_id").agg(F.min_by(F.struct("pos", "line", "col", "label"), F.struct(~F.col("prose"), F.col("pos"))).alias("b"))
    cols = ["doc_id", "code", F.col("anchor_pos").alias("pos"), "line", "col", "label", F.col("probability").alias("value"), message.alias("message"), "snippet"]
    rare = shares.join(first, "doc_id").select("doc_id", "code", "summary", F.col("b.pos").alias("anchor_pos"), F.col("b.line").alias("line"), F.col("b.col").alias("col"), F.col("b.label").alias("label"), F.lit(None).cast("double").alias("probability"), F.lit("").alias("snippet"))
    return each.select(*cols).unionByName(rare.select(*cols))


def run_stats(decisions: DataFrame) -> DataFrame:
    """Per document: units by outcome and tokens sent."""
    s = F.col("status")
    return decisions.groupBy("doc_id").agg(F.count_if(s == "ok").alias("calls"), F.coalesce(F.sum(F.when(s == "ok", F.col("tokens"))), F.lit(0)).alias("input_tokens"), F.count_if(s == "skipped").alias("skipped"), F.count_if(s == "context_exceeded").alias("context_exceeded"), F.count_if(s == "error").alias("errors"), F.max(F.when(s == "error", F.col("detail"))).alias("error_detail"), F.max(F.when(s == "context_exceeded", F.col("tokens"))).alias("context_tokens"))


TYPE_QUESTION = {"question": "Which kind of document is this text as a whole?", "note": "The number of words is given; a short text need not be a message or a note.", "choices": TYPES}


def chooser(scorer: Scorer) -> Callable[[int, str], tuple[str, float]]:
    """Asks a scorer which of the 24 document types a text is; fails where it can't be asked or answers with another."""

    def choose(words: int, text: str) -> tuple[str, float]:
        status, got, detail = attempt(scorer, json.dumps({"word_count": words, "text": text}, ensure_ascii=False), {"type": TYPE_QUESTION})
        if status != "ok" or got.get("type", ("",))[0] not in TYPES:
            raise ValueError(detail or "no type")
        return got["type"][0], float(got["type"][1])

    return choose


def classify(docs_text: DataFrame, choose: Callable[[int, str], tuple[str, float]]) -> DataFrame:
    """(doc_id, choice, confidence) of documents with words, from (doc_id, words, text); a document whose choice fails is left out. The confidence is recorded, not a limit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, n, text in zip(pdf["doc_id"], pdf["words"], pdf["text"]):
                try:
                    rows.append((doc_id, *choose(int(n), text)))
                except Exception:  # noqa: BLE001, S112 - unresolved
                    continue
            yield pd.DataFrame(rows, columns=["doc_id", "choice", "confidence"])

    return docs_text.where("words > 0").select("doc_id", "words", "text").mapInPandas(run, "doc_id bigint, choice string, confidence double")
