"""Rank fusion, hydration, display paths and reranking of hit tables (bounded by k rows per query)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .scans import broadcast_small, top_k

RRF_K = 60
DEFAULT_TOP_K, DEFAULT_CANDIDATES = 10, 50
# Fixed value: the answer form that ``parse_rankings`` reads.
RANKING_FORMAT = 'Answer with JSON only: {"rankings":[{"index":N,"score":0-10}]}'
RERANK_CHARS, RERANK_MIN_TOKENS, RERANK_TOKENS_EACH = 300, 4000, 200


def rrf(bm25_hits: DataFrame, vector_hits: DataFrame, k: int = RRF_K, digits: int | None = None) -> DataFrame:
    """RET-1/RET-2: union of both hit lists (query_id, chunk_id, score, rank), both scores kept.

    A query without any vector hit keeps its BM25 order and gets no fused score.
    ``position`` orders the result per query, from 1.
    """
    b = bm25_hits.select("query_id", "chunk_id", F.col("score").alias("bm25_score"), F.col("rank").alias("bm25_rank"))
    v = vector_hits.select("query_id", "chunk_id", F.col("score").alias("vector_score"), F.col("rank").alias("vector_rank"))
    fused = F.coalesce(1.0 / (k + F.col("bm25_rank")), F.lit(0.0)) + F.coalesce(1.0 / (k + F.col("vector_rank")), F.lit(0.0))
    if digits is not None:
        fused = F.round(fused, digits)
    per_query = Window.partitionBy("query_id")
    both = b.join(v, ["query_id", "chunk_id"], "full").withColumn("_vectors", F.count("vector_rank").over(per_query))
    scored = both.withColumn("rrf_score", F.when(F.col("_vectors") > 0, fused))
    order = per_query.orderBy(F.desc_nulls_last("rrf_score"), F.asc_nulls_last("bm25_rank"), "chunk_id")
    if digits is not None:
        order = per_query.orderBy(
            F.desc_nulls_last("rrf_score"), F.when(F.col("_vectors") == 0, F.col("bm25_rank")).asc_nulls_last(), "chunk_id"
        )
    return scored.withColumn("position", F.row_number().over(order)).select(
        "query_id", "chunk_id", "bm25_score", "vector_score", "rrf_score", "position"
    )


def rrf_many(hits: DataFrame, top_n: int, k: int = RRF_K, digits: int | None = None) -> DataFrame:
    """RET-3: fuse the hit lists of several rewrites of a query: (query_id, rewrite_id, chunk_id, rank from 1)."""
    score = F.sum(1.0 / (k + F.col("rank")))
    score = F.round(score, digits) if digits is not None else score
    merged = hits.groupBy("query_id", "chunk_id").agg(score.alias("score"))
    return top_k(merged, ["query_id"], [F.desc("score"), F.col("chunk_id")], max(top_n, ceil(top_n * 1.5)))


def hydrate(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """RET-4: attach the chunk; hits whose chunk is gone drop out. Hits are the small side once counted."""
    return chunks.join(broadcast_small(hits), "chunk_id")


def post_filter(hits: DataFrame, predicate: Column) -> DataFrame:
    """FLT-7: a predicate on hydrated hits, after the candidate cut: fewer than k hits may be left."""
    return hits.filter(predicate)


def display_path(hits: DataFrame, scoped_paths: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """RET-5: the stored path while it is alive, in scope and of the same content, else the smallest such path.

    scoped_paths (file_path, file_hash): alive paths in scope. Aggregating by hash first keeps a text
    with very many copies to one row. ``within`` names columns of both sides (a notebook) that must agree too.
    """
    by = ["file_hash", *within]
    wanted = scoped_paths.join(broadcast_small(hits.select(*by).distinct()), by, "left_semi").select(*by, "file_path")
    mine = hits.select(*by, "file_path").distinct()
    kept = wanted.join(broadcast_small(mine), [*by, "file_path"], "left_semi").distinct().withColumn("_kept", F.lit(True))
    other = wanted.groupBy(*by).agg(F.min("file_path").alias("_other"))
    out = hits.join(kept, [*by, "file_path"], "left").join(other, by, "left")
    shown = F.when(F.col("_kept"), F.col("file_path")).otherwise(F.coalesce("_other", "file_path"))
    return out.withColumn("file_path", shown).drop("_kept", "_other")


def take(hits: DataFrame, n: int, order: str = "position") -> DataFrame:
    """First ``n`` per query, with the dense 0-based ``final_rank``."""
    out = top_k(hits, ["query_id"], [F.col(order)], n, "_rn")
    return out.withColumn("final_rank", F.col("_rn") - 1).drop("_rn")


def rerank(
    hits: DataFrame,
    queries: DataFrame,
    scorer: Callable[[Column, Column], Column] | None,
    n: int = DEFAULT_TOP_K,
    digits: int | None = None,
) -> DataFrame:
    """RET-7: score the first 2n hits of each query and keep the best n; without a scorer the order stays."""
    pool = top_k(hits, ["query_id"], [F.col("position")], 2 * n, "_rn")
    if scorer is None:
        return take(pool.drop("_rn").withColumn("rerank_score", F.lit(None).cast("double")), n)
    scored = pool.join(broadcast_small(queries.select("query_id", F.col("text").alias("_query"))), "query_id").withColumn(
        "rerank_score", scorer(F.col("_query"), F.col("content"))
    )
    if digits is not None:
        scored = scored.withColumn("rerank_score", F.round("rerank_score", digits))
    best = top_k(scored, ["query_id"], [F.desc("rerank_score"), F.col("_rn")], n, "_final")
    return best.withColumn("final_rank", F.col("_final") - 1).drop("_query", "_rn", "_final")


def overlap_scorer(query: Column, content: Column) -> Column:
    """A model-free scorer: share of distinct query terms that the text holds."""
    asked = F.array_distinct(text.terms(query))
    return F.size(F.array_intersect(asked, text.terms(content))) / F.greatest(F.size(asked), F.lit(1))


def rerank_prompt(hits: DataFrame, queries: DataFrame, order: str = "position") -> DataFrame:
    """RET-9: (query_id, user_prompt, max_tokens): numbered headings and clipped contents of a query's hits."""
    number = F.row_number().over(Window.partitionBy("query_id").orderBy(order))
    heading = F.when(F.coalesce("heading_text", F.lit("")) == "", "(none)").otherwise(F.col("heading_text"))
    entry = F.concat(
        F.lit("["), number.cast("string"), F.lit("] Heading: "), heading, F.lit("\n    Text: "), text.ellipsis(F.col("content"), RERANK_CHARS)
    )
    listed = (
        hits.select("query_id", number.alias("n"), entry.alias("entry"))
        .groupBy("query_id")
        .agg(F.sort_array(F.collect_list(F.struct("n", "entry"))).alias("entries"))
    )
    body = F.array_join(F.transform("entries", lambda e: e["entry"]), "\n")
    return listed.join(broadcast_small(queries), "query_id").select(
        "query_id",
        F.concat(
            F.lit("Question: "), "text", F.lit("\nCandidates:\n"), body, F.lit("\n\n" + RANKING_FORMAT)
        ).alias("user_prompt"),
        F.greatest(F.lit(RERANK_MIN_TOKENS), F.size("entries") * RERANK_TOKENS_EACH).alias("max_tokens"),
    )


_RANKINGS = "rankings ARRAY<STRUCT<index: STRING, score: STRING>>"


def _object_rankings(raw: Column) -> Column:
    return F.from_json(raw, _RANKINGS)["rankings"]


def parse_rankings(raw: Column) -> Column:
    """RET-17: the ``rankings`` of a model answer: the whole text as JSON, else its widest ``{...}``; null if neither."""
    span = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return F.coalesce(_object_rankings(raw), F.when(span != "", _object_rankings(span)))


def apply_rankings(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """RET-8: order a query's candidates (query_id, position from 1, ...) by the answers (query_id, raw).

    Listed candidates come first in listed order, the first mention counting; indices that are no
    integer or out of range are passed over; the others follow in their old order.
    """
    index = F.col("r.index").try_cast("double")
    listed = (
        answers.select("query_id", F.posexplode(parse_rankings(F.col("raw"))).alias("pos", "r"))
        .filter(index == F.floor(index))
        .select("query_id", index.cast("int").alias("position"), "pos", F.coalesce(F.col("r.score").try_cast("double"), F.lit(0.0)).alias("s"))
        .groupBy("query_id", "position")
        .agg(F.min("pos").alias("_pos"), F.min_by("s", "pos").alias("rerank_score"))
    )
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("_pos"), "position")
    return (
        candidates.join(listed, ["query_id", "position"], "left")
        .withColumn("final_rank", F.row_number().over(order) - 1)
        .drop("_pos")
    )


def parse_rewrites(raw: Column, original: Column, limit: int = 3) -> Column:
    """RET-16: query rewrites of a model answer: its ``[...]`` as a JSON array of other, non-empty strings."""
    span = F.regexp_extract(raw, r"(?s)\[.*\]", 0)
    # strings only: numbers and objects keep their JSON form without quotes, so they are told apart by their first mark
    items = F.from_json(span, "array<variant>")
    strings = F.transform(F.filter(items, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: text.trim_ws(F.variant_get(v, "$", "string")))
    kept = F.filter(strings, lambda s: (s != "") & (s != original))
    return F.coalesce(F.slice(kept, 1, limit), F.array().cast("array<string>"))
