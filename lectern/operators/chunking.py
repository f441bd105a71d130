"""Markdown to token-bounded chunks.

The text of a file is moved once, to the partition of its hash. Lines, blocks, headings, sections and
sentences then come from regular expressions and windows inside that partition. The greedy packing, a
fold that restarts at every overflow, is the one step a window cannot express: a small pandas UDF
over token counts, which never sees the text. Windows and lists per file are bounded by the file
size limit (``scope.HARD_LIMIT``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Default chunk size and overlap in tokens.
MAX_TOKENS, OVERLAP_TOKENS = 500, 50

SP = T.WS.replace("\n", "")  # white space within a line
_NONSPACE = f"[^{T.WS}]"
_EOL = r"(?=\n|\z)"
HEADING = rf"#{{1,6}}[{SP}]+{_NONSPACE}"
ROW = rf"[{SP}]*\|[^\n]*\|[{SP}]*{_EOL}"
_DASHES = rf"[{SP}]*:?-+:?[{SP}]*"
SEPARATOR = rf"[{SP}]*\|{_DASHES}(?:\|{_DASHES})+\|[{SP}]*{_EOL}"
ITEM = rf"[{SP}]*(?:[-*+]|[0-9]+\.)[{SP}]+{_NONSPACE}"


def _fenced(mark: str) -> str:
    return rf"\n{mark}[^\n]*(?:\n(?!{mark})[^\n]*)*+(?:\n{mark}[^\n]*)?"


FENCED = f"{_fenced('```')}|{_fenced('~~~')}"
# Every line of "\n" + text belongs to exactly one match, in this order of preference. Possessive
# loops keep the matcher from recursing once per line.
BLOCKS = "|".join(
    [
        FENCED,
        rf"\n{HEADING}[^\n]*",
        rf"\n{ROW}\n{SEPARATOR}(?:\n{ROW})*+",
        rf"\n{ITEM}[^\n]*(?:\n(?:[{SP}]*\n)*+(?:{ITEM}|[{SP}]{{2,}}{_NONSPACE})[^\n]*)*+",
        rf"(?:\n[{SP}]*+{_NONSPACE}[^\n]*)++",
        rf"(?:\n[{SP}]*+{_EOL})++",
    ]
)
SENTENCE_ENDS = r"。.?？!\n"


@dataclass(frozen=True)
class ChunkerConfig:
    max_tokens: int = MAX_TOKENS
    overlap_tokens: int = OVERLAP_TOKENS


def _placed(docs: DataFrame, key: str) -> DataFrame:
    return docs.repartition(key)


def _tiles(docs: DataFrame, key: str, text: str, pattern: str, carry: Sequence[str] = ()) -> DataFrame:
    """(key, carry, pos, tile, tile_start): the matches of ``pattern`` that tile "\\n" + text, with offsets into the text."""
    found = F.regexp_extract_all(F.concat(F.lit("\n"), F.col(text)), F.lit(pattern), F.lit(0))
    rows = _placed(docs, key).select(key, *carry, F.posexplode(found).alias("pos", "tile"))
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("tile_start", (F.coalesce(F.sum(F.length("tile")).over(before), F.lit(0)) - 1).cast("int"))


def scan_lines(docs: DataFrame, key: str = "file_hash", text: str = "text") -> DataFrame:
    """CHK-1: (key, pos, line, char_start, char_end), line ends not included."""
    rows = _placed(docs, key).select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("int")
    return rows.withColumn("char_start", start).withColumn("char_end", F.col("char_start") + F.length("line"))


def heading_level(line: Column) -> Column:
    return F.length(F.regexp_extract(line, rf"\A(#{{1,6}})[{SP}]+{_NONSPACE}", 1))


def heading_title(line: Column) -> Column:
    closing = rf"[{SP}]*#*[{SP}]*\z"
    body = F.regexp_replace(line, rf"\A#{{1,6}}[{SP}]+", "")
    return T.trim_ws(F.regexp_replace(T.trim_ws(F.regexp_replace(body, closing, "")), closing, ""))


def scan_headings(docs: DataFrame, key: str = "file_hash", text: str = "text") -> DataFrame:
    """CHK-2: (key, pos, level, title, char_start, char_end) of ATX headings outside fences, ``pos`` numbering lines and fences."""
    tiles = _tiles(docs, key, text, rf"{FENCED}|\n[^\n]*")
    line = F.substring("tile", 2, 2**31 - 1)
    return tiles.filter(F.col("tile").rlike(rf"\A\n{HEADING}")).select(
        key,
        "pos",
        heading_level(line).alias("level"),
        heading_title(line).alias("title"),
        (F.col("tile_start") + 1).alias("char_start"),
        (F.col("tile_start") + F.length("tile")).alias("char_end"),
    )


def heading_path(rows: DataFrame, key: str = "file_hash") -> DataFrame:
    """CHK-3: adds ``heading_path`` to (key, pos, level, title); rows with a null level stand under the last heading.

    The latest heading of level k is still open if none of a lower level came after it and the
    current heading is at level k or deeper.
    """
    upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    current = F.last("level", ignorenulls=True).over(upto)
    steps = []
    for k in range(1, 7):
        at = F.last(F.when(F.col("level") == k, F.struct("pos", "title")), ignorenulls=True).over(upto)
        closed = F.max(F.when(F.col("level") < k, F.col("pos"))).over(upto)
        steps.append(F.when((current >= k) & (at["pos"] > F.coalesce(closed, F.lit(-1))), at["title"]))
    return rows.withColumn("heading_path", F.array_compact(F.array(*steps)))


def scan_blocks(docs: DataFrame, key: str = "file_hash", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """CHK-4: (key, pos, kind, text, level, title, tile, char_start, char_end) with exact offsets.

    ``tile`` is the block with the blank lines after it, so that tiles in a row make up the source text.
    """
    after = F.lead("tile").over(Window.partitionBy(key).orderBy("pos"))
    tiles = (
        _tiles(docs, key, text, BLOCKS, carry)
        .withColumn("gap", F.when(T.is_blank(after), after).otherwise(""))
        .filter(~T.is_blank(F.col("tile")))
    )
    tile = F.col("tile")
    kind = (
        F.when(tile.rlike(r"\A\n(?:```|~~~)"), "code")
        .when(tile.rlike(rf"\A\n{HEADING}"), "heading")
        .when(tile.rlike(rf"\A\n{ROW}\n{SEPARATOR}"), "table")
        .when(tile.rlike(rf"\A\n{ITEM}"), "list")
        .otherwise("paragraph")
    )
    body = F.regexp_replace(F.regexp_replace(tile, rf"\A[{T.WS}]+", ""), rf"[{SP}]+\z", "")
    lead = F.length(tile) - F.length(F.regexp_replace(tile, rf"\A[{T.WS}]+", ""))
    out = tiles.withColumns({"kind": kind, "text": body, "char_start": F.col("tile_start") + lead})
    is_heading = F.col("kind") == "heading"
    return out.select(
        key, *carry, "pos", "kind", "text",
        F.when(is_heading, heading_level(F.col("text"))).alias("level"),
        F.when(is_heading, heading_title(F.col("text"))).alias("title"),
        F.concat("tile", "gap").alias("tile"), "char_start", (F.col("char_start") + F.length("text")).alias("char_end"),
    )


def sections(blocks: DataFrame, key: str = "file_hash") -> DataFrame:
    """CHK-5: adds ``section`` (a heading block opens one) and ``heading_path`` to blocks."""
    upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = F.sum((F.col("kind") == "heading").cast("int")).over(upto)
    return heading_path(blocks.withColumn("section", opened.cast("int")), key)


def sentence_pieces(text: Column) -> Column:
    """Sentences with the marks that end them, tiling the text."""
    return F.regexp_extract_all(text, F.lit(rf"[^{SENTENCE_ENDS}]*[{SENTENCE_ENDS}]+|[^{SENTENCE_ENDS}]+\z"), F.lit(0))


def split_sentences(docs: DataFrame, key: str = "file_hash", text: str = "text") -> DataFrame:
    """CHK-7: (key, pos, sentence, char_start, char_end); blank pieces dropped."""
    rows = _placed(docs, key).select(key, F.posexplode(sentence_pieces(F.col(text))).alias("pos", "sentence"))
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("sentence")).over(before), F.lit(0)).cast("int")
    return (
        rows.withColumn("char_start", start)
        .withColumn("char_end", F.col("char_start") + F.length("sentence"))
        .filter(~T.is_blank(F.col("sentence")))
    )


def greedy_groups(counts: Iterable[int], limit: int) -> list[int]:
    """Group numbers of consecutive items, a new group where the sum would pass ``limit``."""
    out, group, total = [], 0, 0
    for i, n in enumerate(counts):
        if i and total + n > limit:
            group, total = group + 1, 0
        total += n
        out.append(group)
    return out


def overlapping_groups(counts: Iterable[int], limit: int) -> list[tuple[int, int, bool]]:
    """(first, last, oversize) runs of consecutive items within ``limit``; a run starts with the last item of
    the one before it, and an item over the limit stands alone. Items that count nothing are passed over.
    """
    runs: list[tuple[int, int, bool]] = []
    first = last = None
    total = 0
    for i, n in enumerate(counts):
        if n == 0:
            continue
        if first is not None and (n > limit or total + n > limit):
            runs.append((first, last, False))
            first, total = (None, 0) if n > limit else (last, last_n)
        if n > limit:
            runs.append((i, i, True))
            continue
        first = i if first is None else first
        last, last_n, total = i, n, total + n
    if first is not None:
        runs.append((first, last, False))
    return runs


def pack_blocks(blocks: DataFrame, max_tokens: int = MAX_TOKENS, keys: tuple[str, ...] = ("file_hash", "section")) -> DataFrame:
    """CHK-6: adds ``group`` to blocks (keys, pos, token_count) of at most ``max_tokens`` each."""

    @F.pandas_udf("array<int>")
    def groups(counts: pd.Series) -> pd.Series:
        return counts.map(lambda c: greedy_groups(c, max_tokens))

    rest = F.struct(*[c for c in blocks.columns if c not in keys])
    listed = blocks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", rest.alias("row")))).alias("b"))
    packed = listed.withColumn("g", groups(F.transform("b", lambda b: b["row"]["token_count"])))
    return packed.select(*keys, F.explode(F.arrays_zip("b", "g")).alias("z")).select(*keys, "z.b.row.*", F.col("z.g").alias("group"))


def pack_sentences(sentences: DataFrame, max_tokens: int = MAX_TOKENS, key: str = "file_hash") -> DataFrame:
    """CHK-8: (key, pos, char_start, char_end, oversize) runs over ``split_sentences`` with ``token_count``."""
    runs = _run_udf(max_tokens)
    listed = sentences.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("pos", "char_start", "char_end", "token_count"))).alias("s")
    )
    spans = listed.withColumn("r", runs(F.transform("s", lambda x: x["token_count"])))
    span = F.transform(
        "r",
        lambda r: F.struct(
            F.get("s", r["first"])["char_start"].alias("char_start"), F.get("s", r["last"])["char_end"].alias("char_end"), r["oversize"].alias("oversize")
        ),
    )
    return spans.select(key, F.posexplode(span).alias("pos", "x")).select(key, "pos", "x.*")


def _run_udf(max_tokens: int):
    @F.pandas_udf("array<struct<first: int, last: int, oversize: boolean>>")
    def runs(counts: pd.Series) -> pd.Series:
        return counts.map(
            lambda c: [{"first": a, "last": b, "oversize": o} for a, b, o in overlapping_groups(c, max_tokens)]
        )

    return runs


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once (a lambda body would compute it at every mention)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _indent(text: Column) -> Column:
    """Number of white-space characters before the first other one."""
    return F.length(F.regexp_extract(text, rf"\A[{T.WS}]*", 0))


def hard_windows(text: Column, max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> Column:
    """CHK-9: ARRAY<STRUCT<rel_start, rel_end>> of token windows over one sentence, each overlapping the one before.

    The text is cut into tokens with the white space before them, so lengths add up to offsets: of each step once, then over
    the steps before a window.
    """
    step = max(max_tokens - min(overlap_tokens, max_tokens // 4), 1)

    def window(pieces: Column, sizes: Column, i: Column) -> Column:
        inside = F.array_join(F.slice(pieces, i + 1, F.lit(max_tokens)), "")
        before = F.aggregate(F.slice(sizes, F.lit(1), (i / step).cast("int")), F.lit(0), lambda a, x: a + x)
        return _let(before, lambda begin: _let(inside, lambda w: F.struct((begin + _indent(w)).alias("rel_start"), (begin + F.length(w)).alias("rel_end"))))

    def windows(pieces: Column) -> Column:
        n = F.size(pieces)
        steps = F.sequence(F.lit(0), n - 1, F.lit(step))
        starts = F.filter(steps, lambda i: (i == 0) | (i - step + max_tokens < n))
        sizes = F.transform(steps, lambda i: F.length(F.array_join(F.slice(pieces, i + 1, F.lit(step)), "")))
        none = F.array().cast("array<struct<rel_start: int, rel_end: int>>")
        return F.when(n > 0, _let(sizes, lambda s: F.transform(starts, lambda i: window(pieces, s, i)))).otherwise(none)

    return _let(F.regexp_extract_all(text, F.lit(rf"[{T.WS}]*(?:{T.TOKEN})"), F.lit(0)), windows)


def hard_split(sentences: DataFrame, text: str, max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> DataFrame:
    """CHK-9 as rows: the input columns with ``window``, ``rel_start``, ``rel_end``, ``piece``."""
    rows = sentences.select("*", F.posexplode(hard_windows(F.col(text), max_tokens, overlap_tokens)).alias("window", "w"))
    return rows.select(
        *sentences.columns, "window", "w.rel_start", "w.rel_end",
        F.substr(F.col(text), F.col("w.rel_start") + 1, F.col("w.rel_end") - F.col("w.rel_start")).alias("piece"),
    )


def chunk_kind(kinds: Column) -> Column:
    """CHK-10: the one kind of a chunk's blocks (a heading counts as paragraph), else ``mixed``."""
    plain = F.array_distinct(F.transform(kinds, lambda k: F.when(k == "heading", "paragraph").otherwise(k)))
    return F.when(F.size(plain) == 1, F.get(plain, F.lit(0))).otherwise("mixed")


def attach_locator(chunks: DataFrame, locator_map: DataFrame, key: str = "file_hash") -> DataFrame:
    """CHK-11: adds ``locator``: that of the last map entry starting at or before the chunk, if it reaches it.

    An as-of lookup by one window over both row sets, so that no chunk meets all entries of its file.
    """
    entries = locator_map.select(
        key, F.col("char_start").alias("_at"), F.lit(0).alias("_side"),
        F.struct(F.col("char_end").alias("end"), F.col("locator").alias("locator")).alias("_entry"),
    )
    rows = chunks.select(key, F.col("char_start").alias("_at"), F.lit(1).alias("_side"), F.struct(*chunks.columns).alias("_chunk"))
    both = entries.unionByName(rows, allowMissingColumns=True)
    upto = Window.partitionBy(key).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_entry", F.last("_entry", ignorenulls=True).over(upto)).filter(F.col("_side") == 1)
    return found.select("_chunk.*", F.when(F.col("_at") < F.col("_entry.end"), F.col("_entry.locator")).alias("locator"))


def chunk_documents(files: DataFrame, config: ChunkerConfig = ChunkerConfig(), locator_map: DataFrame | None = None) -> DataFrame:
    """CHK-12: files (file_hash, file_path, source_id, text), one row per hash, to the ``chunks`` table.

    One exchange, by file hash; every later window and grouping stays in that partition, and a chunk's index
    is its place in its file's list.
    """
    limit = config.max_tokens
    origin = ["file_path", *(["source_id"] if "source_id" in files.columns else [])]
    blocks = sections(scan_blocks(files, carry=origin)).withColumn("tokens", T.token_count(F.col("text")))
    sentences = F.transform(
        sentence_pieces(F.col("text")), lambda s: F.struct(F.length(s).alias("size"), T.token_count(s).alias("tokens"))
    )
    listed = (
        blocks.withColumn("sentences", F.when(F.col("tokens") > limit, sentences))
        .groupBy("file_hash")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct("pos", "section", "heading_path", "tile", "text", "kind", "tokens", "sentences", "char_start", "char_end")
                )
            ).alias("b"),
            *[F.first(c).alias(c) for c in origin],
        )
    )
    none = F.array().cast("array<struct<size: int, tokens: int>>")

    def per_sentence(name: str) -> Column:
        return F.transform("b", lambda x: F.transform(F.coalesce(x["sentences"], none), lambda s: s[name]))

    packed = listed.withColumn(
        "spans", _pack_udf(limit)(
            F.transform("b", lambda x: x["section"]), F.transform("b", lambda x: x["tokens"]), per_sentence("tokens"), per_sentence("size")
        )
    )

    def chunk(block: Column, start: Column, body: Column, kinds: Column) -> Column:
        return F.struct(
            block["heading_path"].alias("heading_path"), start.cast("int").alias("char_start"), (start + F.length(body)).cast("int").alias("char_end"), body.alias("body"), chunk_kind(kinds).alias("kind")
        )

    def whole_blocks(span: Column) -> Column:
        run = F.slice("b", span["first"] + 1, span["last"] - span["first"] + 1)
        start, end = F.get("b", span["first"])["char_start"], F.get("b", span["last"])["char_end"]
        joined = F.array_join(F.transform(run, lambda x: x["tile"]), "")
        body = _let(joined, lambda j: F.substr(j, _indent(j) + 1, end - start))
        first = F.get("b", span["first"])
        return _let(body, lambda t: F.array(chunk(first, start, t, F.transform(run, lambda x: x["kind"]))))

    def part_of_block(span: Column) -> Column:
        block = F.get("b", span["first"])
        at, kinds = block["char_start"] + span["from"], F.array(block["kind"])

        def cut(part: Column) -> Column:
            windows = F.transform(
                hard_windows(part, limit, config.overlap_tokens),
                lambda w: chunk(block, at + w["rel_start"], F.substr(part, w["rel_start"] + 1, w["rel_end"] - w["rel_start"]), kinds),
            )
            return F.when(span["oversize"], windows).otherwise(F.array(chunk(block, at, part, kinds)))

        return _let(F.substr(block["text"], span["from"] + 1, span["to"] - span["from"]), cut)

    def pieces(span: Column) -> Column:
        return F.when(span["from"].isNull(), whole_blocks(span)).otherwise(part_of_block(span))

    rows = packed.select("file_hash", *origin, F.posexplode(F.flatten(F.transform("spans", pieces))).alias("chunk_index", "c"))
    content = T.trim_ws(F.col("c.body"))
    chunks = rows.select(
        F.concat_ws(":", "file_hash", F.col("chunk_index").cast("string")).alias("chunk_id"),
        "chunk_index", "file_hash", *origin, "c.heading_path", T.heading_text(F.col("c.heading_path")).alias("heading_text"),
        content.alias("content"), T.content_hash(content).alias("content_hash"), T.token_count(content).alias("token_count"),
        "c.char_start", "c.char_end", "c.kind",
    )
    return chunks if locator_map is None else attach_locator(chunks, locator_map)


def _pack_udf(limit: int):
    """Spans over a file's blocks: runs of whole blocks of a section, or for a block over the limit runs of its sentences."""

    def spans(section, tokens, sentence_tokens, sentence_sizes) -> list[dict]:
        out: list[dict] = []
        held: list[int] = []

        def close() -> None:
            for_group: dict[int, list[int]] = {}
            for i, g in zip(held, greedy_groups([tokens[i] for i in held], limit)):
                for_group.setdefault(g, []).append(i)
            out.extend({"first": g[0], "last": g[-1], "from": None, "to": None, "oversize": False} for g in for_group.values())
            held.clear()

        for i, n in enumerate(tokens):
            if held and section[held[-1]] != section[i]:
                close()
            if n <= limit:
                held.append(i)
                continue
            close()
            ends = [0]
            for size in sentence_sizes[i]:
                ends.append(ends[-1] + size)
            for a, b, oversize in overlapping_groups(sentence_tokens[i], limit):
                out.append({"first": i, "last": i, "from": ends[a], "to": ends[b + 1], "oversize": oversize})
        close()
        return out

    @F.pandas_udf("array<struct<first: int, last: int, from: int, to: int, oversize: boolean>>")
    def pack(section: pd.Series, tokens: pd.Series, sentence_tokens: pd.Series, sentence_sizes: pd.Series) -> pd.Series:
        return pd.Series([spans(*row) for row in zip(section, tokens, sentence_tokens, sentence_sizes)])

    return pack
