"""A kept table of vectors: a run embeds only texts that the table's model has not seen.

The table is Parquet by ``model_id`` and ``batch``. A run writes whole files: of a file, the rows of its last batch count. Rows
carry the hash of their chunk's text, so a chunk cut or numbered anew keeps its vector as long as its text stays.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.scans import broadcast_small
from ..schemas import KEPT_VECTORS
from ..session import cut_lineage
from ..udfs import Embedder, embed


def _rows(spark: SparkSession, root: str, model_id: str | None, before: int | None) -> DataFrame:
    """All rows written, replaced ones too."""
    try:
        rows = spark.read.schema(KEPT_VECTORS).parquet(root)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], KEPT_VECTORS)
    if model_id is not None:
        rows = rows.where(F.col("model_id") == model_id)
    return rows if before is None else rows.where(F.col("batch") < before)


def read_vectors(spark: SparkSession, root: str, model_id: str | None = None, before: int | None = None) -> DataFrame:
    """The rows that count, of one model or of all, with those of failed files (null chunk, an error); partitions of other models are not read."""
    rows = _rows(spark, root, model_id, before)
    last = rows.groupBy("model_id", "file_hash").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["model_id", "file_hash", "batch"])


def _hashed(chunks: DataFrame) -> DataFrame:
    return chunks.select("file_hash", "chunk_id", text.content_hash(F.coalesce("content", F.lit(""))).alias("text_hash"), "content")


def outdated(chunks: DataFrame, kept: DataFrame) -> DataFrame:
    """VEC-5: (file_hash) of ``chunks`` whose kept vectors are not exactly those of their chunks and texts."""
    want = chunks.select("file_hash", "chunk_id", "text_hash")
    have = kept.select("file_hash", "chunk_id", F.col("text_hash").alias("_had"))
    same = F.col("text_hash").eqNullSafe(F.col("_had"))
    joined = want.withColumn("_want", F.lit(True)).join(have, ["file_hash", "chunk_id"], "full")
    files = joined.groupBy("file_hash").agg(F.bool_or(~same).alias("_bad"), F.bool_or("_want").alias("_known"))
    return files.where(F.col("_bad") & F.col("_known")).select("file_hash")


def update_vectors(spark: SparkSession, root: str, chunks: DataFrame, model_id: str, fn: Embedder, batch: int) -> None:
    """VEC-3/VEC-5/VEC-8: bring the model's vectors in line with ``chunks`` (file_hash, chunk_id, content), whole files at a time.

    Texts that the model has embedded before are carried over, whichever chunk they stood in; others are embedded once each. A file with a
    failed text has no vectors until a later run gets them all. Files that ``chunks`` lacks are left as they are, so
    content that comes back is not embedded again. A batch reads earlier batches only and overwrites its own, so it can be repeated.
    """
    kept = read_vectors(spark, root, model_id, batch)
    named = _hashed(chunks)
    files = cut_lineage(outdated(named, kept))
    todo = cut_lineage(named.join(broadcast_small(files), "file_hash", "left_semi"))
    wanted = todo.select("text_hash").distinct()
    # one vector of each text, however many chunks have it or had it
    seen = _rows(spark, root, model_id, batch).where(F.col("vec").isNotNull()).join(broadcast_small(wanted), "text_hash", "left_semi")
    seen = cut_lineage(seen.groupBy("text_hash").agg(F.min_by("vec", F.struct("file_hash", "chunk_id")).alias("vec")))
    unseen = todo.groupBy("text_hash").agg(F.min("content").alias("content")).join(seen.select("text_hash"), "text_hash", "left_anti")
    made = unseen.select("text_hash", embed(model_id, fn, "document")(F.col("content")).alias("e")).select("text_hash", "e.vec", "e.error")
    made = cut_lineage(made)  # the model is asked once
    vectors = seen.withColumn("error", F.lit(None).cast("string")).unionByName(made)
    rows = todo.drop("content").join(vectors, "text_hash")
    failed = rows.where(F.col("error").isNotNull()).groupBy("file_hash").agg(F.min("error").alias("error"))
    good = rows.join(broadcast_small(failed.select("file_hash")), "file_hash", "left_anti")
    none = F.lit(None).cast("string")
    bad = failed.select("file_hash", none.alias("chunk_id"), none.alias("text_hash"), F.lit(None).cast("array<float>").alias("vec"), "error")
    out = good.unionByName(bad).withColumns({"model_id": F.lit(model_id), "batch": F.lit(batch).cast("long")})
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_id", "batch").parquet(root)


def vectors_of(chunks: DataFrame, kept: DataFrame) -> DataFrame:
    """VEC-2: the kept rows that belong to ``chunks`` as they are now: same chunk, same text."""
    now = _hashed(chunks).select("file_hash", "chunk_id", "text_hash")
    return kept.where(F.col("vec").isNotNull()).join(now, ["file_hash", "chunk_id", "text_hash"], "left_semi")


def in_use(kept: DataFrame, settings: DataFrame) -> DataFrame:
    """Rows of the models that ``settings`` (model_id) name: few rows, broadcast, and of ``kept`` only their partitions are read."""
    return kept.join(broadcast_small(settings.select("model_id").distinct(), 1_000), "model_id", "left_semi")
