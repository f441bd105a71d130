"""Document summaries: candidates, model input, backfill, search and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..udfs import Completer, complete
from . import lexical

INPUT_CHARS = 6000
SYSTEM_PROMPT = "Write an abstract by which a search can find this document again. Answer with the abstract alone."


def scoped_content(content: DataFrame, scoped_paths: DataFrame) -> DataFrame:
    """SUM-1: content with status ok behind the distinct in-scope hashes."""
    return content.filter(F.col("status") == "ok").join(scoped_paths.select("file_hash").distinct(), "file_hash", "left_semi")


def summary_candidates(content: DataFrame, chunks: DataFrame) -> DataFrame:
    """SUM-2: content without a summary, flagged ``has_text``; the rest counts as skipped."""
    filled = chunks.groupBy("file_hash").agg(F.bool_or(~text.is_blank(F.col("content"))).alias("has_text"))
    missing = content.filter(F.coalesce("summary", F.lit("")) == "")
    return missing.join(filled, "file_hash", "left").withColumn("has_text", F.coalesce("has_text", F.lit(False)))


def summary_input(chunks: DataFrame, max_chars: int = INPUT_CHARS) -> DataFrame:
    """SUM-3: (file_hash, input): chunk contents by line, cut at ``max_chars``.

    Only chunks that start before the cut are collected.
    """
    before = Window.partitionBy("file_hash").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("content") + 1).over(before), F.lit(0))
    lead = chunks.select("file_hash", "chunk_index", "content", start.alias("_start")).filter(F.col("_start") <= max_chars)
    listed = lead.groupBy("file_hash").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "content"))).alias("c"))
    return listed.select("file_hash", F.substring(F.array_join(F.transform("c", lambda c: c["content"]), "\n"), 1, max_chars).alias("input"))


def backfill_summaries(
    content: DataFrame, chunks: DataFrame, fn: Completer, model_id: str, *, calls_at_a_time: int | None = None
) -> DataFrame:
    """SUM-4: (file_hash, summary, summary_model_id, error) for the candidates; a failed document is a row with an error.

    As many tasks call the model as Spark runs, unless the model's rate asks for another number: ``calls_at_a_time`` deals
    the inputs to that many tasks.
    """
    todo = summary_candidates(content, chunks).filter("has_text").select("file_hash")
    inputs = summary_input(chunks.join(todo, "file_hash", "left_semi"))
    if calls_at_a_time:
        inputs = inputs.repartition(calls_at_a_time)
    out = inputs.select("file_hash", complete(fn)(F.col("input")).alias("r"))
    return out.select("file_hash", F.col("r.text").alias("summary"), F.lit(model_id).alias("summary_model_id"), "r.error")


def backfill_report(candidates: DataFrame, results: DataFrame) -> DataFrame:
    """SUM-4: (done, failed, total, skipped, last_error)."""
    done = results.agg(
        F.count_if(F.col("error").isNull()).alias("done"), F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.count(F.lit(1)).alias("total"), F.max_by("error", F.when(F.col("error").isNotNull(), F.col("file_hash"))).alias("last_error"),
        F.lit(1).alias("_one"),
    )
    skipped = candidates.agg(F.count_if(~F.col("has_text")).alias("skipped"), F.lit(1).alias("_one"))
    return done.join(skipped, "_one").select("done", "failed", "total", "skipped", "last_error")


def search_summaries(queries: DataFrame, content: DataFrame, k: int = 25, model: lexical.Bm25 = lexical.Bm25(boosts={})) -> DataFrame:
    """SUM-5: (query_id, file_hash, score, rank): BM25 over the summaries as a single field."""
    docs = content.filter(F.coalesce("summary", F.lit("")) != "").select(F.col("file_hash").alias("chunk_id"), "summary")
    postings = lexical.build_postings(docs, ("summary",))
    corpus = lexical.corpus_stats(lexical.doc_stats(docs, ("summary",)))
    return lexical.search_topk(queries, postings, corpus, k, model).withColumnRenamed("chunk_id", "file_hash")


def summary_coverage(content: DataFrame) -> DataFrame:
    """SUM-6: (total, with_summary)."""
    return content.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("summary", F.lit("")) != "").alias("with_summary"))
