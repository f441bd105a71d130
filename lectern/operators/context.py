"""From hits to prompts: grouping by document, neighbours, token budgets, citations, messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .scans import broadcast_small, top_k

# Context budget, cost of a chunk's header, summary-mode limits.
CONTEXT_TOKENS, HEADER_TOKENS = 32_000, 30
SUMMARY_SEARCH_K, SUMMARY_PER_DOC, SUMMARY_DOC_LIMIT, SUMMARY_MIN_DOCS = 50, 1, 25, 5
UNTITLED = "(untitled)"
MATERIALS = "== Materials =="
DEFAULT_SYSTEM_PROMPT = (
    "Base the answer on the materials that follow; each has a number.\n"
    "After a statement put the numbers it rests on in brackets, as [2]. If they do not hold the answer, tell the reader."
)


def group_by_document(hits: DataFrame, per_doc: int = SUMMARY_PER_DOC, max_docs: int = SUMMARY_DOC_LIMIT, order: str = "position") -> DataFrame:
    """RET-10: first ``per_doc`` hits of each document, documents as first seen, ``max_docs`` of them at most."""
    in_doc = Window.partitionBy("query_id", "file_hash")
    ranked = hits.withColumns(
        {"_in_doc": F.row_number().over(in_doc.orderBy(order)), "_best": F.min(order).over(in_doc)}
    ).filter(F.col("_in_doc") <= per_doc)
    by_query = Window.partitionBy("query_id")
    ranked = ranked.withColumn("_doc", F.dense_rank().over(by_query.orderBy("_best"))).filter(F.col("_doc") <= max_docs)
    final = F.row_number().over(by_query.orderBy("_doc", "_in_doc")) - 1
    return ranked.withColumn("final_rank", final).drop("_in_doc", "_best", "_doc")


def expand_neighbors(hits: DataFrame, chunks: DataFrame, n: int = 1, order: str = "position") -> DataFrame:
    """RET-11: each hit with the ``n`` chunks before and after it in its file; a chunk is kept once, where it first shows.

    hits (query_id, file_hash, file_path, chunk_index, chunk_id, <order>, scores). The index range is
    spelled out per hit, so the lookup is an equi-join of 2n+1 small rows per hit.
    """
    scores = [c for c in ("bm25_score", "vector_score", "rrf_score", "rerank_score") if c in hits.columns]
    wanted = hits.select(
        "query_id", "file_hash", F.col("file_path").alias("_shown"), F.col(order).alias("_order"), F.col("chunk_index").alias("_hit"),
        *[F.col(s).alias(f"_{s}") for s in scores],
        F.explode(F.sequence(F.col("chunk_index") - n, F.col("chunk_index") + n)).alias("chunk_index"),
    )
    found = chunks.join(broadcast_small(wanted), ["file_hash", "chunk_index"])
    is_hit = F.col("chunk_index") == F.col("_hit")
    once = Window.partitionBy("query_id", "chunk_id").orderBy("_order", "chunk_index")
    kept = found.withColumn("_first", F.row_number().over(once)).filter(F.col("_first") == 1)
    final = F.row_number().over(Window.partitionBy("query_id").orderBy("_order", "chunk_index"))
    return kept.select(
        "query_id", "chunk_id", "file_hash", F.col("_shown").alias("file_path"), "chunk_index",
        *[c for c in ("heading_text", "content", "token_count", "char_start", "char_end") if c in chunks.columns],
        *[F.when(is_hit, F.col(f"_{s}")).alias(s) for s in scores],
        is_hit.alias("is_hit"),
        final.alias("position"),
    )


def fit_budget(hits: DataFrame, budget: int | Column = CONTEXT_TOKENS, keys: tuple[str, ...] = ("query_id",), order: tuple[str, ...] = ("position",)) -> DataFrame:
    """RET-12: adds ``in_prompt`` and ``truncated``: the longest prefix that fits, the first row always in.

    Costs are positive, so the greedy cut is a running sum against the budget. Groups are the hits of
    one query; for whole notebooks see ``generation.budget_prefix``.
    """
    group = Window.partitionBy(*keys)
    ordered = group.orderBy(*order)
    cost = F.col("token_count") + HEADER_TOKENS
    spent = F.sum(cost).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    limit = budget if isinstance(budget, Column) else F.lit(budget)
    fits = (spent <= limit) | (F.row_number().over(ordered) == 1)
    out = hits.withColumn("in_prompt", fits)
    # the first row is free of the limit but not of its cost: rows after an oversize first one never fit
    return out.withColumn("truncated", F.bool_or(~F.col("in_prompt")).over(group))


def citations(hits: DataFrame, order: str = "position") -> DataFrame:
    """RET-13: numbered from 1 in hit order, with offsets and a 200-character preview."""
    number = F.row_number().over(Window.partitionBy("query_id").orderBy(order))
    return hits.withColumn("index", number).withColumn("preview", text.preview(F.col("content")))


def material(index: Column, heading: Column, path: Column, content: Column) -> Column:
    """One numbered block of a prompt."""
    title = F.when(F.coalesce(heading, F.lit("")) == "", UNTITLED).otherwise(heading)
    return F.concat(F.lit("["), index.cast("string"), F.lit("] "), title, F.lit(" — "), path, F.lit("\n"), content, F.lit("\n"))


def chat_prompt(cited: DataFrame, queries: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """RET-14: (query_id, system_prompt, messages): materials in the prompt, past turns, the question.

    cited    ``citations`` after ``fit_budget``
    queries  (query_id, text, system_prompt nullable)
    history  (query_id, messages ARRAY<STRUCT<role, content>>), see ``conversations.history``
    """
    blocks = (
        cited.filter("in_prompt")
        .select("query_id", "index", material(F.col("index"), F.col("heading_text"), F.col("file_path"), F.col("content")).alias("block"))
        .groupBy("query_id")
        .agg(F.sort_array(F.collect_list(F.struct("index", "block"))).alias("blocks"))
    )
    custom = F.col("system_prompt") if "system_prompt" in queries.columns else F.lit(None).cast("string")
    lead = F.when(custom.isNull() | text.is_blank(custom), DEFAULT_SYSTEM_PROMPT).otherwise(text.trim_ws(custom))
    out = queries.withColumn("_lead", lead).join(blocks, "query_id", "left")
    listed = F.transform(F.coalesce("blocks", F.array().cast(blocks.schema["blocks"].dataType)), lambda b: b["block"])
    system = F.array_join(F.concat(F.array("_lead", F.lit(""), F.lit(MATERIALS)), listed), "\n")
    message = "array<struct<role: string, content: string>>"
    past = F.array().cast(message)
    if history is not None:
        out = out.join(history, "query_id", "left")
        past = F.coalesce("messages", past)
    asked = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).cast(message)
    head = F.array(F.struct(F.lit("system").alias("role"), system.alias("content"))).cast(message)
    return out.select("query_id", system.alias("system_prompt"), F.concat(head, past, asked).alias("messages"))


def summary_route(queries: DataFrame, summary_hits: DataFrame, mode: str = "auto", keywords: str = text.SUMMARY_KEYWORDS) -> DataFrame:
    """RET-15: adds ``is_summary`` and ``route``: chunk, summaries (five documents or more found), grouped (fewer)."""
    is_summary = {"on": F.lit(True), "off": F.lit(False)}.get(mode, text.is_summary_question(F.col("text"), keywords))
    found = summary_hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("_docs"))
    enough = F.coalesce("_docs", F.lit(0)) >= SUMMARY_MIN_DOCS
    return (
        queries.withColumn("is_summary", is_summary)
        .join(found, "query_id", "left")
        .withColumn("route", F.when(~F.col("is_summary"), "chunk").when(enough, "summaries").otherwise("grouped"))
        .drop("_docs")
    )


def routed_hits(routes: DataFrame, chunk_hits: DataFrame, summary_hits: DataFrame, chunks: DataFrame, top_n: int = 15) -> DataFrame:
    """RET-15: the hits each query's route gives, in one table.

    chunk_hits    hydrated, ``SUMMARY_SEARCH_K`` deep (query_id, chunk_id, file_hash, position, ...)
    summary_hits  (query_id, file_hash, rank)
    """
    route = routes.select("query_id", "route")
    cols = ["query_id", "chunk_id", "file_hash", "position"]
    plain = top_k(chunk_hits.join(route.filter("route = 'chunk'"), "query_id", "left_semi"), ["query_id"], [F.col("position")], top_n, "_rn")
    grouped = group_by_document(chunk_hits.join(route.filter("route = 'grouped'"), "query_id", "left_semi"))
    anchors = (
        chunks.filter(F.col("chunk_index") == 0).select("chunk_id", "file_hash")
        .join(broadcast_small(summary_hits.join(route.filter("route = 'summaries'"), "query_id", "left_semi")), "file_hash")
    )
    parts = [
        plain.select(*cols),
        grouped.select("query_id", "chunk_id", "file_hash", (F.col("final_rank") + 1).alias("position")),
        anchors.select("query_id", "chunk_id", "file_hash", F.col("rank").alias("position")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.join(route, "query_id")


def chunks_for_file(paths: DataFrame, content: DataFrame, chunks: DataFrame) -> DataFrame:
    """FLT-8: chunks of alive, covered paths whose content is ok; (file_path, file_hash, chunk columns)."""
    ok = content.filter(F.col("status") == "ok").select("file_hash")
    return (
        paths.select("file_path", "file_hash").join(ok, "file_hash", "left_semi").join(chunks.drop("file_path"), "file_hash")
    )


def describe_locator(loc: Column) -> Column:
    """FLT-9: where a chunk sits in its source document."""
    slide = F.concat(
        F.lit("Slide "), loc["index"].cast("string"),
        F.when(F.coalesce(loc["title"], F.lit("")) != "", F.concat(F.lit(": "), loc["title"])).otherwise(""),
        F.when(loc["is_note"], F.lit(" · notes")).otherwise(""),
    )
    rows = F.when(
        loc["row_from"].isNotNull(), F.concat(F.lit(" · rows "), loc["row_from"].cast("string"), F.lit("-"), loc["row_to"].cast("string"))
    ).otherwise("")
    sheet = F.concat(F.lit("Sheet "), loc["name"], rows)
    page = F.concat(F.lit("Page "), loc["page_from"].cast("string"), F.lit("-"), loc["page_to"].cast("string"))
    kind = loc["kind"]
    return F.when(kind == "slide", slide).when(kind == "sheet", sheet).when(kind == "page", page).otherwise("—")


def chunk_preview(chunks: DataFrame) -> DataFrame:
    """FLT-9: one display line and a preview per chunk."""
    head = F.concat(
        F.lit("#"), F.col("chunk_index").cast("string"), F.lit(" · "), "kind", F.lit(" · "), F.col("token_count").cast("string"), F.lit(" tokens")
    )
    where = describe_locator(F.col("locator")) if "locator" in chunks.columns else F.lit("—")
    return chunks.withColumns({"header": head, "where": where, "preview": text.ellipsis(F.col("content"), 200)})
