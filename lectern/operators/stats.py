"""Aggregates over index state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scope_stats(scoped_paths: DataFrame, chunks: DataFrame) -> DataFrame:
    """AGG-1: per notebook, alive files in scope and chunks over their distinct hashes.

    scoped_paths (notebook_id, file_path, file_hash); chunks (file_hash, ...).
    """
    files = scoped_paths.groupBy("notebook_id").agg(F.count(F.lit(1)).alias("file_count"))
    sizes = chunks.groupBy("file_hash").agg(F.count(F.lit(1)).alias("_n"))
    counts = (
        scoped_paths.select("notebook_id", "file_hash")
        .distinct()
        .join(sizes, "file_hash")
        .groupBy("notebook_id")
        .agg(F.sum("_n").alias("chunk_count"))
    )
    return files.join(counts, "notebook_id", "left").fillna(0, ["chunk_count"])


def run_report(diff: DataFrame, by: list[str] | None = None) -> DataFrame:
    """AGG-2: number of changes per class."""
    return diff.groupBy(*(by or []), "classification").agg(F.count(F.lit(1)).alias("n_files"))


def index_report(run: dict[str, DataFrame], started_ms: int, ended_ms: int) -> DataFrame:
    """AGG-2: (item, name, n) of an indexing run: files by class of change, errors by class, chunks, milliseconds."""
    rows = run["diff"].groupBy(F.lit("files").alias("item"), F.col("classification").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    rows = rows.unionByName(run["errors"].groupBy(F.lit("errors").alias("item"), F.col("error_class").alias("name")).agg(F.count(F.lit(1)).alias("n")))
    rows = rows.unionByName(run["chunks"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("chunks").alias("item"), F.lit("all").alias("name"), "n"))
    took = run["chunks"].sparkSession.range(1).select(F.lit("milliseconds").alias("item"), F.lit("all").alias("name"), F.lit(ended_ms - started_ms).cast("bigint").alias("n"))
    return rows.unionByName(took)


def notebook_status(notebooks: DataFrame, runs: DataFrame, changes: DataFrame) -> DataFrame:
    """AGG-3: idle / dirty / indexing / error.

    runs (notebook_id, seq, state, finished_at, error), the last one counts; changes (notebook_id, ts).
    """
    last = runs.groupBy("notebook_id").agg(F.max_by(F.struct("state", "finished_at", "error"), "seq").alias("run"))
    pending = changes.groupBy("notebook_id").agg(F.max("ts").alias("last_change"))
    status = (
        F.when(F.col("run.state") == "running", "indexing")
        .when(F.col("run.error").isNotNull(), "error")
        .when(F.col("last_change") > F.coalesce("run.finished_at", F.lit(-1)), "dirty")
        .otherwise("idle")
    )
    return (
        notebooks.select("notebook_id")
        .join(last, "notebook_id", "left")
        .join(pending, "notebook_id", "left")
        .select("notebook_id", status.alias("status"))
    )
