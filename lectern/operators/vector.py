"""Exact vector search and the upkeep of the vectors table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import BestRows, small_enough, top_k

MAX_QUERY_BLOCK = 20_000  # queries whose vectors are shipped to the tasks at a time
# Fixed values of embedding batches.
BATCH_TOKENS, BATCH_ROWS, MAX_CHARS = 8_192, 96, 2_048


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _scorer(ids: np.ndarray, matrix: np.ndarray, k: int, digits: int | None):
    """Per Arrow batch: scores of all queries by one matrix product. A task passes on the best k of each query."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = BestRows(len(ids), k)
        for batch in batches:
            if batch.empty:
                continue
            scores = matrix @ np.stack(batch["vec"].to_numpy()).astype(np.float64).T
            best.offer(scores if digits is None else np.round(scores, digits), batch["chunk_id"].to_numpy())
        yield best.result(ids)

    return run


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 50, *, digits: int | None = None, block: int = MAX_QUERY_BLOCK) -> DataFrame:
    """VEC-1: ``k`` best dot products per query over (chunk_id, vec), for (query_id, qvec).

    Query vectors go to the tasks in blocks of a fixed size, so any number of queries works; each block is
    one map-only pass over the vectors, and a task returns ``k`` rows per query at most.
    """
    slices = 1 if small_enough(queries, block) else -(-queries.count() // (block // 2))
    out = None
    for i in range(slices):
        part = queries if slices == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == i)
        local = part.select("query_id", "qvec").toPandas()
        if local.empty:
            continue
        ids, matrix = local["query_id"].to_numpy(), np.stack(local["qvec"].to_numpy()).astype(np.float64)
        schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id string, score double"
        scored = vectors.select("chunk_id", "vec").mapInPandas(_scorer(ids, matrix, k, digits), schema)
        out = scored if out is None else out.unionByName(scored)
    if out is None:
        out = queries.limit(0).select("query_id", F.lit("").alias("chunk_id"), F.lit(0.0).alias("score"))
    return top_k(out, ["query_id"], [F.desc("score"), F.col("chunk_id")], k)


def load_vectors(vectors: DataFrame, chunks: DataFrame, scoped_paths: DataFrame, model_id: str) -> DataFrame:
    """VEC-2: vectors of the current model for the distinct in-scope hashes (``model_id`` is a partition key)."""
    hashes = scoped_paths.select("file_hash").distinct()
    ids = chunks.join(hashes, "file_hash", "left_semi").select("chunk_id")
    return vectors.filter(F.col("model_id") == model_id).join(ids, "chunk_id", "left_semi")


def batch_by_tokens(chunks: DataFrame, max_tokens: int = BATCH_TOKENS, max_rows: int = BATCH_ROWS) -> DataFrame:
    """VEC-4: adds ``batch_id`` to the chunks of each file, in order.

    A fold that restarts when a batch is full, over one file's chunks (without their text).
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk_index")
        out, batch, tokens, rows = [], 0, 0, 0
        for n in pdf["token_count"]:
            if rows and (tokens + n > max_tokens or rows >= max_rows):
                batch, tokens, rows = batch + 1, 0, 0
            tokens, rows = tokens + n, rows + 1
            out.append(batch)
        return pdf.assign(batch_id=np.array(out, dtype="int64"))

    cols = chunks.select("file_hash", "chunk_id", "chunk_index", "token_count")
    schema = cols.schema.simpleString()[len("struct<") : -1] + ",batch_id:bigint"
    return cols.groupBy("file_hash").applyInPandas(fold, schema.replace(":", " "))


def needs_embedding(chunks: DataFrame, vectors: DataFrame, model_id: str) -> DataFrame:
    """VEC-5: hashes whose vectors of the current model do not cover exactly their chunk ids.

    vectors (file_hash, chunk_id, model_id).
    """
    have = vectors.filter(F.col("model_id") == model_id).select("file_hash", "chunk_id", F.lit(True).alias("_have"))
    want = chunks.select("file_hash", "chunk_id", F.lit(True).alias("_want"))
    joined = want.join(have, ["file_hash", "chunk_id"], "full")
    return (
        joined.groupBy("file_hash")
        .agg(F.bool_or(F.col("_have").isNull() | F.col("_want").isNull()).alias("_bad"), F.bool_or("_want").alias("_known"))
        .filter(F.col("_bad") & F.col("_known"))
        .select("file_hash")
    )


def invalidate_embeddings(content: DataFrame) -> DataFrame:
    """VEC-6: content rows that had a model, with model and error cleared; their vectors go by ``left_anti``."""
    return content.filter(F.col("embedding_model_id").isNotNull()).withColumns(
        {"embedding_model_id": F.lit(None).cast("string"), "embedding_error": F.lit(None).cast("string")}
    )


def embedding_coverage(content: DataFrame, chunks: DataFrame, vectors: DataFrame, model_id: str) -> DataFrame:
    """VEC-7: (total, embedded, failed, outdated) over content with status ok. vectors (file_hash, chunk_id, model_id)."""
    ok = content.filter(F.col("status") == "ok").select("file_hash", "embedding_error")
    total = chunks.join(ok, "file_hash", "left_semi").agg(F.count(F.lit(1)).alias("total"))
    vecs = vectors.join(ok, "file_hash", "left_semi").agg(
        F.count_if(F.col("model_id") == model_id).alias("embedded"), F.count_if(F.col("model_id") != model_id).alias("other")
    )
    failed = ok.agg(F.count_if(F.col("embedding_error").isNotNull()).alias("failed"))
    one = F.lit(1).alias("_one")
    return (
        total.withColumn("_one", one).join(vecs.withColumn("_one", one), "_one").join(failed.withColumn("_one", one), "_one")
        .select("total", "embedded", "failed", ((F.col("embedded") == 0) & (F.col("other") > 0)).alias("outdated"))
    )


def reassemble_batch(responses: DataFrame) -> DataFrame:
    """VEC-9: (batch_id, response JSON) to (batch_id, index, vec), placed by the response's own ``index``."""
    parsed = F.from_json("response", "data ARRAY<STRUCT<index: INT, embedding: ARRAY<DOUBLE>>>")
    return (
        responses.select("batch_id", F.explode(parsed["data"]).alias("d"))
        .groupBy("batch_id", F.col("d.index").alias("index"))
        .agg(F.max("d.embedding").alias("vec"))
    )


def split_failures(embedded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """VEC-8: (vectors, failed files) of ``embed_documents``: one failed chunk voids its file's vectors, nothing else."""
    failed = embedded.filter(F.col("error").isNotNull()).groupBy("file_hash").agg(F.min("error").alias("embedding_error"))
    vectors = embedded.join(failed, "file_hash", "left_anti").select("file_hash", "chunk_id", "model_id", "vec")
    return vectors, failed
