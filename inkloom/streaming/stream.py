"""Structured Streaming over arriving documents.

A document is one row until it is cut into blocks, so checks that stay within a document need no state: each micro-batch is linted as a corpus. Counts
over time use event time with a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkloom.functions import text as T
from inkloom.plans.lint import lint
from inkloom.settings import Settings
from inkloom.sources.documents import corpus_of


def lint_stream(documents: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, settings: Settings = Settings(semantic=False), once: bool = True) -> StreamingQuery:
    """Findings of every micro-batch of (doc_id, format, content …) go to sink(findings, batch id), which must be idempotent by batch id."""

    def each(batch: DataFrame, batch_id: int) -> None:
        corpus, errors = corpus_of(batch)
        run = lint(corpus, settings, errors=errors)
        sink(run.findings, batch_id)
        corpus.unpersist()

    w = documents.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def drain(results: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """What a stream gives for all that has arrived so far, as a table under ``folder``. Appended rows are written once, by batch; complete results replace those of the batch before."""
    out = f"{folder.rstrip('/')}/out"

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id if mode == 'append' else 0}")

    query = results.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{folder.rstrip('/')}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return results.sparkSession.read.parquet(out).drop("batch")


def long_sentences(documents: DataFrame, limit: int = 45) -> DataFrame:
    """Stateless: sentences over the limit, straight from (doc_id, text) rows, batch or stream."""
    s = documents.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sent_no", "sentence"))
    return s.withColumn("words", T.word_count("sentence")).where(F.col("words") > limit).select("doc_id", "sent_no", "words")


def windowed_counts(documents: DataFrame, time: str = "added_at", window: str = "1 day", late: str = "30 days") -> DataFrame:
    """Documents and words by window of event time and source; rows later than the watermark are dropped by a stream."""
    d = documents.withWatermark(time, late) if documents.isStreaming else documents
    return d.groupBy(F.window(time, window).alias("w"), "source").agg(F.count("*").alias("documents"), F.sum(T.word_count("text")).alias("words")).select(F.col("w.start").alias("window_start"), "source", "documents", "words")
