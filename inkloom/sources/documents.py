"""Documents as DataFrames: files of a folder, tables with a text column, and web pages."""

from __future__ import annotations

import re
import urllib.request
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.operators.corpus import Corpus
from inkloom.sources.parsers import FORMATS, parse, visuals_of

BLOCK = "doc_id bigint, pos int, text string, raw string, kind string, line int, col int, label string, level int, bold boolean, error string"

_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
_SCHEMA = pa.schema([(n, _TYPES[t]) for n, t in map(str.split, BLOCK.split(", "))])


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(doc_id, path, format, content, error, web) of the files under a path; doc_id is a hash of the path; files of other formats have a null format."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    formats = F.create_map(*(F.lit(x) for kv in FORMATS.items() for x in kv))
    return r.load(path).select(F.xxhash64("path").alias("doc_id"), "path", formats[suffix].alias("format"), "content", F.lit(None).cast("string").alias("error"), F.lit(False).alias("web"))


def blocks_of(documents: DataFrame, main_content: bool = False) -> DataFrame:
    """Blocks of documents (doc_id, format, content). A document that can't be read, or comes with an error, gives one row with its error and no text.

    Of web pages (``web``), and of all HTML if ``main_content`` is true, only the main content is kept.
    """
    have = set(documents.columns)
    failed = F.col("error") if "error" in have else F.lit(None).cast("string")
    web = F.coalesce("web", F.lit(False)) if "web" in have else F.lit(False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, fmt, content, error, page in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "format", "content", "failed", "page"))):
                if error is not None:
                    rows.append({"doc_id": doc_id, "pos": 0, "line": 0, "col": 1, "level": 0, "bold": False, "error": error[:300]})
                if content is None or error is not None:
                    continue
                try:
                    for pos, b in enumerate(parse(content, fmt, page)):
                        rows.append({"doc_id": doc_id, "pos": pos, **b, "error": None})
                except Exception as e:  # noqa: BLE001 - one document must not end the job
                    rows.append({"doc_id": doc_id, "pos": 0, "line": 0, "col": 1, "level": 0, "bold": False, "error": f"{type(e).__name__}: {e}"[:300]})
            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    page = F.lit(True) if main_content else web
    return documents.where("doc_id is not null").select("doc_id", "format", "content", failed.alias("failed"), page.alias("page")).mapInArrow(run, BLOCK)


def visuals(documents: DataFrame) -> DataFrame:
    """(doc_id, line, visuals): pictures and charts of each slide of the decks that can be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, content in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist()):
                try:
                    rows += [{"doc_id": doc_id, "line": n, "visuals": k} for n, k in visuals_of(content).items()]
                except Exception:  # noqa: BLE001, S112 - blocks_of reports it
                    continue
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("line", pa.int32()), ("visuals", pa.int32())]))

    return documents.where("format = 'pptx' and content is not null").select("doc_id", "content").mapInArrow(run, "doc_id bigint, line int, visuals int")


def texts_for_compare(documents: DataFrame) -> DataFrame:
    """(doc_id, text): Markdown and text as written, so that code and link targets survive; of other formats the texts of their blocks."""
    plain = F.col("format").isNull() | F.col("format").isin("md", "txt")
    raw = documents.where(plain).select("doc_id", F.decode("content", "UTF-8").alias("text"))
    b = blocks_of(documents.where(~plain)).where("error is null").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    return raw.unionByName(b)


def corpus_of(documents: DataFrame, main_content: bool = False) -> tuple[Corpus, DataFrame]:
    """(corpus, errors) of documents with doc_id, format, content and perhaps path and doc_type."""
    have = set(documents.columns)
    docs = documents.select("doc_id", F.col("path") if "path" in have else F.lit("").alias("path"), "format", F.col("doc_type") if "doc_type" in have else F.lit(None).cast("string").alias("doc_type"))
    b = blocks_of(documents, main_content)
    errors = b.where("error is not null").select("doc_id", "error")
    c = Corpus.of(docs, b.where("error is null").drop("error"))
    c.visuals = visuals(documents)
    return c, errors


MAX_PAGE, PAGE_TIMEOUT = 10_000_000, 30


def is_url(path: str) -> bool:
    return bool(re.match(r"https?://", path, re.I))


def fetch(url: str) -> str:
    """The HTML behind an http(s) address, at most MAX_PAGE bytes; anything else is an error."""
    if not is_url(url):
        raise ValueError(f"not an http(s) address: {url}")
    request = urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0 (compatible; inkloom)", "Accept": "text/html,application/xhtml+xml"})
    with urllib.request.urlopen(request, timeout=PAGE_TIMEOUT) as response:
        kind = response.headers.get_content_type()
        if kind not in ("text/html", "application/xhtml+xml"):
            raise ValueError(f"{url} is {kind}, not HTML")
        data = response.read(MAX_PAGE + 1)
        if len(data) > MAX_PAGE:
            raise ValueError(f"{url} is larger than {MAX_PAGE} bytes")
        return data.decode(response.headers.get_content_charset() or "utf-8", "replace")


def read_urls(spark: SparkSession, urls: list[str], partitions: int = 8) -> DataFrame:
    """(doc_id, path, format, content, error, web) of web pages, fetched inside tasks; a page that can't be fetched has a null content and an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, errors = [], []
            for u in pdf["path"]:
                content, error = None, None
                try:
                    content = fetch(u).encode()
                except Exception as e:  # noqa: BLE001 - one page must not end the job
                    error = f"{type(e).__name__}: {e}"
                out.append(content)
                errors.append(error)
            yield pd.DataFrame({"path": pdf["path"], "content": out, "error": errors})

    got = spark.createDataFrame([(u,) for u in urls], "path string").repartition(partitions).mapInPandas(run, "path string, content binary, error string")
    return got.select(F.xxhash64("path").alias("doc_id"), "path", F.lit("html").alias("format"), "content", "error", F.lit(True).alias("web"))
