"""Generated artifacts: corpus collection, budgets, prompts, and parsing of what a model returns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .chunking import SP
from .context import HEADER_TOKENS, material
from .scans import HOT_ROWS, prefix_scan, top_k

# Context window, what is kept back for answer and prompt, and the least budget.
DEFAULT_CONTEXT, ANSWER_TOKENS, PROMPT_TOKENS, MIN_BUDGET = 128_000, 12_000, 2_000, 1_000
CITE = "Behind each statement put the numbers of the materials it rests on, as [2]. Name what the materials leave open."
MATERIALS, NO_MATERIALS = "== Materials ==", "(none)"
# What an artifact is for, and the form that its parser or reader needs; callers may pass a table of their own.
TEMPLATES = {
    "summary": "Condense the materials so that a reader can do without them.",
    "study-guide": "Turn the materials into a course for self-study. Markdown; every topic is a section headed by `##`.",
    "timeline": "Put what happens in the materials in sequence. Markdown; every event is one `- ` item that begins with when it happens, in bold.",
    "faq": "Ask what a newcomer to the materials would ask, and answer it. Markdown; every question is a heading by `###`.",
    "briefing": "Tell someone who has to decide what they need to know from the materials, and what is at stake.",
    "mind-map": "Arrange the ideas of the materials as a tree. One idea per line after `- `, two blanks more for each level down, all under one first line; numbers of materials only at the end of a line.",
    "ppt": "Present the materials. Markdown slides with a line `---` between them; a slide has a heading and short points.",
}
ASK = "Generate it from the materials above."


def collect_corpus(chunks: DataFrame, content: DataFrame, scoped_paths: DataFrame, chunking_version: int = 1) -> DataFrame:
    """GEN-1: chunks of in-scope, current content by notebook, one row per chunk id; order by ``file_path, chunk_index``.

    scoped_paths (notebook_id, file_hash). Chunk ids are unique in the chunks table, so distinct
    (notebook, hash) pairs are all there is to deduplicate.
    """
    usable = content.filter((F.col("status") == "ok") & (F.col("chunking_version") == chunking_version)).select("file_hash")
    pairs = scoped_paths.select("notebook_id", "file_hash").distinct().join(usable, "file_hash", "left_semi")
    return chunks.join(pairs, "file_hash")


def generation_budget(context_tokens: Column) -> Column:
    """GEN-2."""
    return F.greatest(F.coalesce(context_tokens, F.lit(DEFAULT_CONTEXT)) - ANSWER_TOKENS - PROMPT_TOKENS, F.lit(MIN_BUDGET))


def budget_prefix(corpus: DataFrame, budget: int, key: str = "notebook_id", order: tuple[str, ...] = ("file_path", "chunk_index", "chunk_id")) -> DataFrame:
    """GEN-2 with RET-12: per notebook the chunks that fit, in order, with ``index`` from 1 and ``truncated``.

    A chunk costs 30 tokens at least, so only the first budget/30 + 2 can matter; a notebook of any
    size is cut to those inside each task, before the exchange.
    """
    lead = top_k(corpus, [key], [F.col(c) for c in order], budget // HEADER_TOKENS + 2, "index")
    upto = Window.partitionBy(key).orderBy("index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spent = F.sum(F.col("token_count") + HEADER_TOKENS).over(upto)
    fits = lead.withColumn("_spent", spent).filter((F.col("_spent") <= budget) | (F.col("index") == 1)).drop("_spent")
    sizes = corpus.groupBy(key).agg(F.count(F.lit(1)).alias("_all"))
    kept = F.count(F.lit(1)).over(Window.partitionBy(key))
    return fits.withColumn("_kept", kept).join(sizes, key).withColumn("truncated", F.col("_kept") < F.col("_all")).drop("_kept", "_all")


def generation_prompt(fitted: DataFrame, requests: DataFrame, key: str = "notebook_id", templates: dict[str, str] | None = None) -> DataFrame:
    """GEN-3: (notebook_id, kind, system_prompt, user_prompt, truncated), one per request (notebook_id, kind); a request
    without material says so in its prompt."""
    block = material(F.col("index"), F.col("heading_text"), F.col("file_path"), F.col("content"))
    listed = (
        fitted.select(key, "index", "truncated", block.alias("block"))
        .groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct("index", "block"))).alias("b"), F.bool_or("truncated").alias("truncated"))
        .select(key, F.array_join(F.transform("b", lambda b: b["block"]), "\n").alias("materials"), "truncated")
    )
    pairs = [F.lit(x) for kv in (templates or TEMPLATES).items() for x in kv]
    template = F.try_element_at(F.create_map(*pairs), F.col("kind"))
    return requests.join(listed, key, "left").select(
        key, "kind", F.concat(template, F.lit(f"\n{CITE}\n\n{MATERIALS}\n"), F.coalesce("materials", F.lit(NO_MATERIALS))).alias("system_prompt"),
        F.lit(ASK).alias("user_prompt"), F.coalesce("truncated", F.lit(False)).alias("truncated"),
    )


NOT_AN_ITEM, UNEVEN = -1, -2  # instead of a depth
PLACED = "array<struct<node_id:int,parent_id:int,depth:int,error:string>>"


def place_nodes(depths: Sequence[int]) -> list[dict]:
    """Where each line of an outline goes, from the depths alone: under the last node one level up, as long as there is one.

    There is one root. A further line at its level becomes its child, and is said to be.
    """
    last_at: list[int] = []  # the last node of each level that is still open
    out, count = [], 0
    for depth in depths:
        row = {"node_id": None, "parent_id": None, "depth": None, "error": None}
        out.append(row)
        if depth < 0:
            row["error"] = "no list item" if depth == NOT_AN_ITEM else "uneven indent"
            continue
        if depth == 0 and count:
            row["error"], depth = "second root, put under the first", 1
        if depth > len(last_at):
            row["error"] = "no item above it"
            continue
        row |= {"node_id": count, "parent_id": last_at[depth - 1] if depth else None, "depth": depth}
        last_at[depth:] = [count]
        count += 1
    return out


def parse_outlines(outlines: DataFrame, key: str = "doc", outline: str = "outline") -> DataFrame:
    """GEN-4: (key, node_id, parent_id, depth, text, citations, line_no, error), one row per line that is not blank.

    Text, citations and indents are taken from the lines by expressions; where a line goes depends on those before it,
    which is a fold over the depths. Map-only.
    """
    placed = F.pandas_udf(lambda depths: depths.map(place_nodes), PLACED, F.PandasUDFType.SCALAR)
    lines = F.transform(F.split(F.coalesce(outline, F.lit("")), "\r?\n"), lambda line, i: F.struct((i + 1).alias("no"), line.alias("line")))
    filled = F.filter(lines, lambda x: ~text.is_blank(x["line"]))
    blanks = lambda x: F.length(F.regexp_extract(x["line"], r"\A( *)", 1))
    depth = lambda x: F.when(~x["line"].rlike(r"\A *- +\S"), NOT_AN_ITEM).when(blanks(x) % 2 == 1, UNEVEN).otherwise((blanks(x) / 2).cast("int"))
    listed = outlines.select(key, filled.alias("_lines")).withColumn("_at", placed(F.transform("_lines", depth)))
    rows = listed.select(key, F.explode(F.arrays_zip("_lines", "_at")).alias("x")).select(key, F.col("x._lines.no").alias("line_no"), F.col("x._lines.line").alias("line"), "x._at.*")
    body, marks = text.trailing_citations(F.regexp_replace("line", r"\A *- +", ""))
    node = F.col("node_id").isNotNull()
    shown = F.when(F.col("error").isin("no list item", "uneven indent"), text.trim_ws(F.col("line"))).otherwise(body)
    return rows.select(key, "node_id", "parent_id", "depth", shown.alias("text"), F.when(node, marks).alias("citations"), "line_no", "error")


def split_slides(decks: DataFrame, key: str = "doc", deck: str = "deck") -> DataFrame:
    """GEN-5: (key, slide_no, slide): split at lines of only ``---``, closed leading front matter and empty slides left out."""
    rule = rf"---[{SP}]*"
    front = rf"\A(?:[{SP}]*\n)*{rule}\n(?:(?!{rule}(?:\n|\z))[^\n]*\n)*+{rule}(?:\n|\z)"
    body = F.regexp_replace(F.regexp_replace(F.col(deck), "\r\n", "\n"), front, "")
    slides = F.transform(F.split(F.concat(F.lit("\n"), body), rf"\n{rule}(?=\n|\z)"), text.trim_ws)
    return decks.select(key, F.posexplode(F.filter(slides, lambda s: s != "")).alias("slide_no", "slide"))


def list_artifacts(artifacts: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """GEN-6: adds ``position`` per notebook, newest first."""
    newest = artifacts.withColumn("_age", -F.col("generated_at"))
    return prefix_scan(newest, ["notebook_id"], ["_age", "artifact_id"], rank="position", hot_rows=hot_rows).drop("_age")


def delete_artifacts(artifacts: DataFrame, ids: DataFrame) -> DataFrame:
    """GEN-6: without the given artifacts; unknown ids change nothing."""
    return artifacts.join(ids.select("artifact_id").distinct(), "artifact_id", "left_anti")


MERMAID_INIT = "%%{init: {'look': 'handDrawn'}}%%"


def artifact_export(kind: Column, title: Column, meta: Column, content: Column) -> Column:
    """GEN-7: the file text of an artifact; slide decks get a deck header and a directive in each diagram without one."""
    page = F.concat(F.lit("# "), title, F.lit("\n\n> "), meta, F.lit("\n\n"), content, F.lit("\n"))
    marked = F.regexp_replace(content, r"```mermaid\n(?!%%\{init)", "```mermaid\n" + MERMAID_INIT + "\n")
    deck = F.concat(F.lit("---\nmarp: true\ntheme: default\npaginate: true\n---\n\n<!-- "), meta, F.lit(" -->\n\n"), marked, F.lit("\n"))
    return F.when(kind == "ppt", deck).otherwise(page)


def export_filename(kind: Column, title: Column, ts: Column) -> Column:
    """SRC-6/TXT-11: kind, safe title and time."""
    return F.concat_ws("-", kind, text.title_slug(title), F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH-mm-ss-SSS'Z'"), F.lit(".md")))
