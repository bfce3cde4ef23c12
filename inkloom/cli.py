"""The command line: lint files, folders and addresses, print outlines and rules, compare texts."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.operators import scoring
from inkloom.operators.compare import compare, ordered, rendered
from inkloom.plans import report
from inkloom.plans.lint import Lint, lint
from inkloom.rules.catalog import DOC_TYPES, catalog, explain
from inkloom.settings import CONFIG_NAMES, Settings, find_config, load_settings
from inkloom.sources.documents import corpus_of, is_url, read_files, read_urls, texts_for_compare
from inkloom.sources.parsers import FORMATS

VERSION = "0.2"


def codes(value: str) -> tuple[str, ...]:
    return tuple(x.strip() for x in value.split(",") if x.strip())


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="inkloom", description="Checks prose at corpus scale.")
    p.add_argument("--version", action="version", version=f"inkloom {VERSION}")
    p.add_argument("paths", nargs="*", help="files, folders or http(s) addresses")
    p.add_argument("-f", "--file", action="append", default=[], help="one more file")
    for name in ("select", "ignore", "extend-select"):
        p.add_argument(f"--{name}", type=codes, default=(), help="rule codes or prefixes, by commas")
    p.add_argument("--no-model", action="store_true", help="exact rules only")
    p.add_argument("--model", help="scorer")
    p.add_argument("--type", choices=DOC_TYPES, metavar="TYPE", help="force the document type")
    p.add_argument("--no-classify", action="store_true")
    p.add_argument("--max-sentence-words", type=int)
    p.add_argument("--min-words", type=int, help="shortest unit that a model is asked about")
    p.add_argument("--outline", action="store_true", help="print the structure and stop")
    p.add_argument("--format", choices=("text", "json"), default="text")
    p.add_argument("--config", type=Path)
    p.add_argument("--debug-model", action="store_true", help="print every probability")
    p.add_argument("--compare", nargs=2, metavar=("SOURCE", "REWRITE"))
    p.add_argument("--waive", action="append", default=[])
    p.add_argument("--list-rules", action="store_true")
    p.add_argument("--explain", metavar="CODE")
    p.add_argument("--no-color", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true", help="findings only")
    return p


def settings_of(args: argparse.Namespace, config: Path | None) -> Settings:
    s = load_settings(config)
    if args.min_words is not None and args.min_words < 1:
        raise ValueError("--min-words must be at least 1")
    options = {k: v for k, v in (("select", args.select), ("model", args.model), ("max_sentence_words", args.max_sentence_words), ("min_words", args.min_words), ("forced_type", args.type)) if v}
    if args.no_model:
        options["semantic"] = False
    if args.no_classify:
        options["classify"] = False
    return s.with_options(ignore=args.ignore, extend_select=args.extend_select, **options)


def by_config(paths: list[str]) -> dict[Path | None, list[str]]:
    """Paths by the configuration nearest to them, upward; folders that hold configurations of their own are taken apart."""
    out: dict[Path | None, list[str]] = {}
    todo = list(reversed(paths))
    while todo:
        p = todo.pop()
        here = Path.cwd() if is_url(p) else Path(p)
        if not is_url(p) and here.is_dir() and any(f.is_file() and f.parent != here for name in CONFIG_NAMES for f in here.rglob(name)):
            todo.extend(sorted((str(x) for x in here.iterdir() if x.is_dir() or x.suffix.lower() in FORMATS), reverse=True))
        else:
            out.setdefault(find_config(here), []).append(p)
    return out


def documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All documents of the paths."""
    parts = [read_urls(spark, urls)] if (urls := [p for p in paths if is_url(p)]) else []
    for p in paths:
        if not is_url(p):
            d = read_files(spark, p)
            parts.append(d.where("format is not null") if Path(p).is_dir() else d)  # what else lies in a folder isn't meant
    out = parts[0]
    for d in parts[1:]:
        out = out.unionByName(d)
    return out


def colored(line: str, on: bool) -> str:
    head, _, rest = line.partition(": ")
    return f"\033[1m{head}\033[0m: {rest}" if on and rest else line


def show_compare(spark: SparkSession, pair: list[str], waive: list[str], fmt: str) -> int:
    texts = [texts_for_compare(documents(spark, [p])).first()["text"] for p in pair]  # one pair named by hand
    changes = ordered(compare(spark.createDataFrame([(1, *texts)], "pair_id bigint, source string, rewrite string"), tuple(waive)))
    if fmt == "json":
        for line in changes.drop("pair_id").toJSON().collect():
            print(line)
    else:
        r = rendered(changes).first()
        print(f"{pair[1]}: {r['report'] if r else 'every claim survives, nothing invented'}")
    return 0 if changes.isEmpty() else 1


def show(run: Lint, args: argparse.Namespace) -> None:
    if args.format == "json":
        for r in report.json_report(run).toLocalIterator():
            print(r["report"])
        return
    color = sys.stdout.isatty() and not args.no_color and "NO_COLOR" not in os.environ
    for r in report.text_lines(run.findings, run.docs).orderBy("path", "k").toLocalIterator():
        print(colored(r["line_text"], color))
    if args.debug_model and run.decisions is not None:
        for r in scoring.answers(run.decisions).select("doc_id", "anchor_pos", "code", F.round("probability", 3).alias("p")).orderBy("doc_id", "anchor_pos", "code").toLocalIterator():
            print(f"{r['doc_id']}:{r['anchor_pos']} {r['code']} {r['p']:.3f}")
    if not args.quiet:
        print(report.summary(run))
        if run.decisions is not None:
            print(report.model_note(run))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.list_rules:
        for r in catalog():
            print(f"{r.code}  {'on ' if r.default else 'off'}  {r.name}: {r.summary}")
        return 0
    try:
        if args.explain:
            print(explain(args.explain))
            return 0
        paths = [*args.paths, *args.file]
        if not paths and not args.compare:
            parser().print_usage(sys.stderr)
            return 2
        missing = [p for p in paths if not is_url(p) and not Path(p).exists()]
        for p in missing:
            print(f"{p}: no such file", file=sys.stderr)
        paths = [p for p in paths if p not in missing]
        groups = {args.config: paths} if args.config else by_config(paths)
        runs = [(ps, settings_of(args, config)) for config, ps in groups.items()]
        if not paths and not args.compare:
            return 2
        spark = SparkSession.builder.appName("inkloom").getOrCreate()
        if args.compare:
            return show_compare(spark, args.compare, args.waive, args.format)
        worst = 2 if missing else 0
        for ps, settings in runs:
            docs = documents(spark, ps)
            corpus, errors = corpus_of(docs)
            if args.outline:
                for r in report.outline_lines(corpus.sections, corpus.docs).orderBy("doc_id", "k").toLocalIterator():
                    print(r["line_text"])
                continue
            run = lint(corpus, settings, errors=errors)
            run.findings = run.findings.persist()
            show(run, args)
            for r in errors.join(docs.select("doc_id", "path"), "doc_id").orderBy("path").toLocalIterator():
                print(f"{r['path']}: {r['error']}", file=sys.stderr)
            worst = max(worst, report.exit_code(run))
        return worst
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
