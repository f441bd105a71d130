"""Markdown assembly: pages, slides and tables to one text per document, with a locator for every stretch.

The *piece* tables here (one row per section or table row, with offsets) are the result at any size.
``assemble_documents`` joins the pieces of a document into one string.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, trim_ws
from ..schemas import LOCATOR
from .scans import HOT_ROWS, prefix_scan

EMPTY_TABLE = "_(空)_"


def locator(kind: str, **fields: Column) -> Column:
    """A locator struct; fields not given are null."""
    given = {"kind": F.lit(kind), **fields}
    return F.struct(*[given.get(n, F.lit(None)).alias(n) for n in LOCATOR.fieldNames()]).cast(LOCATOR)


def _with_offsets(pieces: DataFrame, keys: Sequence[str], order: Sequence[str], hot_rows: int) -> DataFrame:
    out = prefix_scan(pieces, keys, order, sums={"_end": F.length("piece").cast("bigint")}, hot_rows=hot_rows)
    return out.withColumn("char_start", F.col("_end") - F.length("piece")).withColumnRenamed("_end", "char_end")


def assemble_sections(
    df: DataFrame, doc: str, ord_: str, title: Column, body: Column, *, kind: str = "page", hot_rows: int = HOT_ROWS, extra_order: Sequence[str] = ()
) -> DataFrame:
    """ASM-1: (doc, ord, piece, char_start, char_end, locator): ``## title``, blank line, body. Pages and notes without a body
    are skipped; a slide is its title at least."""
    number = F.col(ord_).cast("int")
    where = (
        locator("page", page_from=number, page_to=number)
        if kind == "page"
        else locator("slide", index=number, title=title, is_note=F.col("is_note") if "is_note" in df.columns else F.lit(False))
    )
    filled = F.coalesce(~is_blank(body), F.lit(False))
    if kind == "slide":
        filled = filled | ~(F.col("is_note") if "is_note" in df.columns else F.lit(False))
    shown = F.when(is_blank(F.coalesce(body, F.lit(""))), F.lit("")).otherwise(F.concat(body, F.lit("\n\n")))
    pieces = df.filter(filled).select(
        doc, ord_, *extra_order, F.concat(F.lit("## "), title, F.lit("\n\n"), shown).alias("piece"), where.alias("locator")
    )
    return _with_offsets(pieces, [doc], [ord_, *extra_order], hot_rows)


def notes_sections(slides: DataFrame, notes: DataFrame, doc: str, ord_: str, *, include: bool = False) -> DataFrame:
    """ASM-5: slides (doc, ord, title, body), with their notes as sections flagged ``is_note`` when asked for."""
    cols = [doc, ord_, "title", "body"]
    out = slides.select(*cols, F.lit(False).alias("is_note"))
    if include:
        marked = F.concat(F.col("title"), F.lit(" · notes"))
        out = out.unionByName(notes.select(doc, ord_, marked.alias("title"), "body", F.lit(True).alias("is_note")))
    return out


def assemble_documents(pieces: DataFrame, doc: str, order: Sequence[str], max_text: int | None = None) -> DataFrame:
    """(doc, total_chars, text): pieces joined in order; with ``max_text``, longer documents keep a null text."""
    total = pieces.groupBy(doc).agg(F.max("char_end").alias("total_chars"))
    fitting = pieces if max_text is None else pieces.join(total.filter(F.col("total_chars") <= max_text).select(doc), doc, "left_semi")
    joined = (
        fitting.groupBy(doc)
        .agg(F.sort_array(F.collect_list(F.struct(*order, "piece"))).alias("p"))
        .select(doc, F.array_join(F.transform("p", lambda p: p["piece"]), "").alias("text"))
    )
    return total.join(joined, doc, "left")


def _cell(col: Column) -> Column:
    return F.regexp_replace(F.replace(F.coalesce(col.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), "[\r\n]+", " ")


def _row(cells: Sequence[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |\n"))


def table_to_markdown(df: DataFrame, name: str, order: str, columns: Sequence[str] | None = None, *, hidden: bool = False, sheet_no: int = 1) -> DataFrame:
    """ASM-2 pieces of one sheet: (sheet_no, part, row_order, piece, is_row): heading and header, rows, blank line."""
    columns = list(columns or df.columns)
    head = f"## {name}\n\n"
    header = head + "| " + " | ".join(c.replace("|", "\\|") for c in columns) + " |\n| " + " | ".join("---" for _ in columns) + " |\n"

    def lines(src: DataFrame, part: int, row_order: Column, piece: Column, is_row: Column) -> DataFrame:
        return src.select(
            F.lit(name).alias("sheet"), F.lit(sheet_no).alias("sheet_no"), F.lit(part).alias("part"),
            row_order.cast("bigint").alias("row_order"), piece.alias("piece"), is_row.alias("is_row"),
        )

    if hidden:
        df = df.limit(0)
    none = F.col("n") == 0
    count = df.agg(F.count(F.lit(1)).alias("n"))
    if hidden:
        count = count.filter(F.col("n") < 0)
    return (
        lines(count, 0, F.lit(0), F.when(none, head + EMPTY_TABLE + "\n").otherwise(header), ~none)
        .unionByName(lines(df, 1, F.col(order), _row([_cell(F.col(c)) for c in columns]), F.lit(True)))
        .unionByName(lines(count, 2, F.lit(0), F.lit("\n"), F.lit(False)))
    )


def workbook(sheets: Sequence[DataFrame], hot_rows: int = HOT_ROWS) -> DataFrame:
    """ASM-2: all sheets of a workbook with offsets over the whole text and a row locator per table row (header = row 1)."""
    pieces = sheets[0]
    for s in sheets[1:]:
        pieces = pieces.unionByName(s)
    pieces = pieces.withColumn("doc", F.lit(1))
    placed = prefix_scan(
        pieces, ["doc"], ["sheet_no", "part", "row_order"],
        sums={"_end": F.length("piece").cast("bigint")}, hot_rows=hot_rows,
    )
    numbered = prefix_scan(placed, ["sheet_no"], ["part", "row_order"], rank="_row", hot_rows=hot_rows)
    row = F.col("_row").cast("int")
    return numbered.select(
        "doc", "sheet", "sheet_no", "part", "row_order", "piece",
        (F.col("_end") - F.length("piece")).alias("char_start"), F.col("_end").alias("char_end"),
        F.when(F.col("is_row"), locator("sheet", name=F.col("sheet"), row_from=row, row_to=row)).alias("locator"),
    )


def lines_from_spans(spans: DataFrame, doc: str, page: str, pos: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """ASM-4: spans (doc, page, pos, str, has_eol) to (doc, page, text): lines end at ``has_eol``, are trimmed, empty ones dropped."""
    ends = F.coalesce(F.col("has_eol").cast("int"), F.lit(0))
    counted = prefix_scan(spans.withColumn("_eol", ends), [doc, page], [pos], sums={"_ends": F.col("_eol")}, hot_rows=hot_rows)
    lines = (
        counted.groupBy(doc, page, (F.col("_ends") - F.col("_eol")).alias("line_no"))
        .agg(F.sort_array(F.collect_list(F.struct(pos, "str"))).alias("s"))
        .select(doc, page, "line_no", trim_ws(F.array_join(F.transform("s", lambda s: s["str"]), "")).alias("line"))
        .filter(F.col("line") != "")
    )
    return lines.groupBy(doc, page).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n").alias("text")
    )


class _Markdown(HTMLParser):
    """Block elements become paragraphs, headings and pipe tables; strong, em and br keep their marks."""

    INLINE = {"strong": "**", "b": "**", "em": "_", "i": "_"}
    PLAIN_INLINE = {"a", "span", "code", "u", "s", "sub", "sup", "small", "mark", "label", "abbr", "font"}
    SILENT = {"script", "style", "head", "template", "noscript"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.text: list[str] = []
        self.heading = 0
        self.silent = 0
        self.rows: list[list[str]] | None = None

    def _take(self) -> str:
        out = "".join(self.text).strip()
        self.text = []
        return out

    def _flush(self) -> None:
        block = self._take()
        if block:
            self.blocks.append("#" * self.heading + " " + block if self.heading else block)
        self.heading = 0

    def handle_starttag(self, tag, attrs):
        if tag in self.SILENT:
            self.silent += 1
        elif tag in self.INLINE:
            self.text.append(self.INLINE[tag])
        elif tag == "br":
            self.text.append("\n")
        elif tag in self.PLAIN_INLINE:
            pass
        elif self.rows is not None:
            if tag == "tr":
                self.rows.append([])
            if tag in ("td", "th"):
                self.text = []
        else:
            self._flush()
            if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
                self.heading = int(tag[1])
            elif tag == "table":
                self.rows = []

    def handle_endtag(self, tag):
        if tag in self.SILENT:
            self.silent = max(self.silent - 1, 0)
        elif tag in self.INLINE:
            self.text.append(self.INLINE[tag])
        elif tag in self.PLAIN_INLINE or tag == "br":
            pass
        elif self.rows is not None and tag != "table":
            if tag in ("td", "th") and self.rows:
                self.rows[-1].append(" ".join(self._take().replace("|", "\\|").splitlines()))
        elif tag == "table":
            rows = [r for r in self.rows or [] if r]
            self.rows = None
            self.text = []
            if rows:
                width = max(map(len, rows))
                lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
                self.blocks.append("\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]]))
        else:
            self._flush()

    def handle_data(self, data):
        if not self.silent:
            self.text.append(data)


def markdown_of(html: str) -> str:
    parser = _Markdown()
    parser.feed(html)
    parser.close()
    parser._flush()
    return "\n\n".join(parser.blocks) + ("\n" if parser.blocks else "")


def html_to_markdown(df: DataFrame, html: str) -> DataFrame:
    """ASM-3: adds ``markdown``; map-only. Python parses, since HTML nesting is not a regular language."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(markdown=batch[html].map(lambda h: markdown_of(h or "")))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, markdown string")
