"""ASM-* and CHK-* checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.operators import assemble, chunking
from lectern.operators.scans import prefix_scan
from lectern.schemas import LOCATOR

from .registry import query
from .views import SQL_VIEWS, WS, Views, blank_sql, tokens_sql, trim_sql

SP = chunking.SP
SQL_VIEWS["v_turn_pieces"] = f"""SELECT conv_id AS doc, turn AS ord, '## Turn ' || turn || ' ' || role || chr(10) || chr(10) || text || chr(10) || chr(10) AS piece
  FROM conversations WHERE NOT {blank_sql('text')}"""


def turn_sections(v: Views):
    turns = v.table("conversations")
    title = F.concat(F.lit("Turn "), F.col("turn").cast("string"), F.lit(" "), "role")
    return assemble.assemble_sections(turns, "conv_id", "turn", title, F.col("text"))


@query("asm1_sections", """
SELECT doc, ord, (sum(len(piece)) OVER w)::BIGINT - len(piece) AS char_start, (sum(len(piece)) OVER w)::BIGINT AS char_end, ord AS page FROM v_turn_pieces WINDOW w AS (PARTITION BY doc ORDER BY ord)""")
def asm1(v: Views):
    return turn_sections(v).select(F.col("conv_id").alias("doc"), F.col("turn").alias("ord"), "char_start", "char_end", F.col("locator.page_from").alias("page"))


@query("asm1_documents", "SELECT doc, sum(len(piece))::BIGINT AS total_chars, string_agg(piece, '' ORDER BY ord) AS text FROM v_turn_pieces GROUP BY doc")
def asm1b(v: Views):
    return assemble.assemble_documents(turn_sections(v), "conv_id", ["turn"]).withColumnRenamed("conv_id", "doc")


def _cells(*cols: str) -> str:
    return "'| ' || " + " || ' | ' || ".join(f"regexp_replace(replace(coalesce({c}::VARCHAR, ''), '|', '\\|'), '[\\r\\n]+', ' ', 'g')" for c in cols) + " || ' |' || chr(10)"


_NATION, _REGION = ("n_nationkey", "n_name", "n_regionkey"), ("r_regionkey", "r_name")


def _head(name: str, cols) -> str:
    return f"'## {name}' || chr(10) || chr(10) || '| {' | '.join(cols)} |' || chr(10) || '| {' | '.join('---' for _ in cols)} |' || chr(10)"


@query("asm2_table_to_markdown", f"""
WITH p AS (SELECT 1 AS s, 0 AS part, 0 AS o, {_head('nation', _NATION)} AS piece UNION ALL SELECT 1, 1, n_nationkey, {_cells(*_NATION)} FROM nation UNION ALL SELECT 1, 2, 0, chr(10)
UNION ALL SELECT 2, 0, 0, {_head('region', _REGION)} UNION ALL SELECT 2, 1, r_regionkey, {_cells(*_REGION)} FROM region UNION ALL SELECT 2, 2, 0, chr(10)
UNION ALL SELECT 4, 0, 0, '## nowhere' || chr(10) || chr(10) || '_(空)_' || chr(10) UNION ALL SELECT 4, 2, 0, chr(10)),
n AS (SELECT *, (sum(len(piece)) OVER (ORDER BY s, part, o))::BIGINT AS char_end, row_number() OVER (PARTITION BY s ORDER BY part, o) AS rn FROM p)
SELECT s::BIGINT AS sheet_no, piece, char_end - len(piece) AS char_start, char_end, CASE WHEN part < 2 AND s < 4 THEN rn END AS row_from FROM n""")
def asm2(v: Views):
    nation, region = v.table("nation"), v.table("region")
    sheets = [
        assemble.table_to_markdown(nation, "nation", "n_nationkey", _NATION, sheet_no=1),
        assemble.table_to_markdown(region, "region", "r_regionkey", _REGION, sheet_no=2),
        assemble.table_to_markdown(region, "secret", "r_regionkey", _REGION, sheet_no=3, hidden=True),
        assemble.table_to_markdown(region.filter(F.col("r_name") == "nowhere"), "nowhere", "r_regionkey", _REGION, sheet_no=4),
    ]
    return assemble.workbook(sheets).select("sheet_no", "piece", "char_start", "char_end", F.col("locator.row_from").alias("row_from"))


@query("asm3_html_to_markdown")
def asm3(v: Views):
    return assemble.html_to_markdown(v.table("pages").select("page_id", "html"), "html").select("page_id", "markdown")


@query("asm4_lines_from_spans", f"""
WITH l AS (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))
SELECT doc_id, string_agg({trim_sql('line')}, chr(10) ORDER BY pos) AS text FROM l WHERE NOT {blank_sql('line')} GROUP BY doc_id""")
def asm4(v: Views):
    # every word with the space around it is a span; a line end is a span of its own
    lines = v.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    pieces = F.concat(F.regexp_extract_all("line", F.lit(rf"[{WS}]*[^{WS}]+|[{WS}]+"), F.lit(0)), F.array(F.lit("\n")))
    spans = lines.select("doc_id", "line_no", F.posexplode(pieces).alias("i", "str")).select(
        "doc_id", F.lit(1).alias("page"), (F.col("line_no") * 1_000_000 + F.col("i")).alias("pos"), "str", (F.col("str") == "\n").alias("has_eol")
    )
    return assemble.lines_from_spans(spans, "doc_id", "page", "pos").select("doc_id", "text")


@query("asm5_notes_sections", f"""
WITH s AS (SELECT conv_id AS doc, turn AS ord, 0 AS n, '## ' || role || chr(10) || chr(10) || text || chr(10) || chr(10) AS piece FROM conversations WHERE role <> 'system' AND NOT {blank_sql('text')}
UNION ALL SELECT conv_id, turn, 1, '## ' || role || ' · notes' || chr(10) || chr(10) || text || chr(10) || chr(10) FROM conversations WHERE role = 'system' AND NOT {blank_sql('text')})
SELECT doc, ord, n = 1 AS is_note, (sum(len(piece)) OVER (PARTITION BY doc ORDER BY ord, n))::BIGINT AS char_end FROM s""")
def asm5(v: Views):
    t = v.table("conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("ord"), F.col("role").alias("title"), F.col("text").alias("body"))
    both = assemble.notes_sections(t.filter("title <> 'system'"), t.filter("title = 'system'"), "doc", "ord", include=True)
    out = assemble.assemble_sections(both, "doc", "ord", F.col("title"), F.col("body"), kind="slide", extra_order=["is_note"])
    return out.select("doc", "ord", "is_note", "char_end")


@query("chk1_scan_lines", "SELECT file_hash, pos, line, char_start, char_start + len(line) AS char_end FROM v_lines")
def chk1(v: Views):
    return chunking.scan_lines(v.content)


# RE2 has neither possessive loops nor lookahead: a line that opens no fence is spelled out.
_NOT_TICKS = r"(?:\n(?:[^`\n][^\n]*|`[^`\n][^\n]*|``[^`\n][^\n]*|``?)?)*"
_FENCE = rf"\n```[^\n]*{_NOT_TICKS.replace(')?)*', ')?)*?')}(?:\n```[^\n]*|$)"
_HEADING = rf"#{{1,6}}[{SP}]+[^{WS}]"
_TITLE = rf"regexp_replace({trim_sql(rf'''regexp_replace(regexp_replace(L, '^#{{1,6}}[{SP}]+', ''), '[{SP}]*#*[{SP}]*$', '')''')}, '[{SP}]*#*[{SP}]*$', '')"


def title_sql(line: str) -> str:
    return trim_sql(_TITLE.replace("(L,", f"({line},"))


SQL_VIEWS["v_md_tiles"] = rf"""SELECT file_hash, pos, t AS tile, (coalesce(sum(len(t)) OVER (PARTITION BY file_hash ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1)::BIGINT AS tile_start
  FROM (SELECT file_hash, unnest(range(len(x))) AS pos, unnest(x) AS t FROM (SELECT file_hash, regexp_extract_all(chr(10) || text, '{_FENCE}|\n[^\n]*') AS x FROM v_md))"""
SQL_VIEWS["v_headings"] = rf"""SELECT file_hash, pos, len(regexp_extract(tile, '^\n(#+)', 1)) AS level, {title_sql('substr(tile, 2)')} AS title, tile_start + 1 AS char_start, tile_start + len(tile) AS char_end
  FROM v_md_tiles WHERE regexp_matches(tile, '^\n{_HEADING}')"""
# the path by levels: a heading of level k stays open until one of a lower or the same level
SQL_VIEWS["v_paths_of_headings"] = """SELECT file_hash, pos, level, title, (SELECT string_agg(a.title, ' > ' ORDER BY a.pos) FROM v_headings a WHERE a.file_hash = h.file_hash AND (a.pos = h.pos OR a.pos < h.pos AND a.level < h.level
    AND NOT EXISTS (FROM v_headings b WHERE b.file_hash = h.file_hash AND b.pos > a.pos AND b.pos <= h.pos AND b.level <= a.level))) AS path FROM v_headings h"""


@query("chk2_scan_headings", "SELECT * FROM v_headings")
def chk2(v: Views):
    return chunking.scan_headings(v.md)


@query("chk3_heading_path", "SELECT file_hash, pos, path FROM v_paths_of_headings")
def chk3(v: Views):
    rows = chunking.heading_path(chunking.scan_headings(v.md))
    return rows.select("file_hash", "pos", text.heading_text(F.col("heading_path")).alias("path"))


_ROW, _ITEM = rf"[{SP}]*\|[^\n]*\|[{SP}]*", rf"[{SP}]*(?:[-*+]|[0-9]+\.)[{SP}]+[^{WS}][^\n]*"
_SEP = rf"[{SP}]*\|[{SP}]*:?-+:?[{SP}]*(?:\|[{SP}]*:?-+:?[{SP}]*)+\|[{SP}]*"
_INDENTED = rf"[{SP}]{{2,}}[^{WS}][^\n]*"
_BLOCKS = "|".join([_FENCE, rf"\n{_HEADING}[^\n]*", rf"\n{_ROW}\n{_SEP}(?:\n{_ROW})*", rf"\n{_ITEM}(?:(?:\n[{SP}]*)*\n(?:{_ITEM}|{_INDENTED}))*", rf"(?:\n[{SP}]*[^{WS}][^\n]*)+", rf"\n[{SP}]*"])
SQL_VIEWS["v_md_blocks"] = rf"""SELECT file_hash, pos, tile, tile_start,
  CASE WHEN regexp_matches(tile, '^\n```') THEN 'code' WHEN regexp_matches(tile, '^\n{_HEADING}') THEN 'heading' WHEN regexp_matches(tile, '^\n{_ROW}\n{_SEP}') THEN 'table'
    WHEN regexp_matches(tile, '^\n{_ITEM}') THEN 'list' ELSE 'paragraph' END AS kind,
  regexp_replace(regexp_replace(tile, '^[{WS}]+', ''), '[{SP}]+$', '') AS text, tile_start + len(tile) - len(regexp_replace(tile, '^[{WS}]+', '')) AS char_start
  FROM (SELECT file_hash, pos, t AS tile, (coalesce(sum(len(t)) OVER (PARTITION BY file_hash ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1)::BIGINT AS tile_start
    FROM (SELECT file_hash, unnest(range(len(x))) AS pos, unnest(x) AS t FROM (SELECT file_hash, regexp_extract_all(chr(10) || text, '{_BLOCKS}') AS x FROM v_md)))
  WHERE NOT {blank_sql('tile')}"""


@query("chk4_scan_blocks", "SELECT file_hash, kind, text, char_start, char_start + len(text) AS char_end FROM v_md_blocks")
def chk4(v: Views):
    return chunking.scan_blocks(v.md).select("file_hash", "kind", "text", "char_start", "char_end")


@query("chk5_sections", f"""
WITH b AS (SELECT *, count(*) FILTER (kind = 'heading') OVER (PARTITION BY file_hash ORDER BY pos) AS section FROM v_md_blocks),
h AS (SELECT file_hash, row_number() OVER (PARTITION BY file_hash ORDER BY pos) AS section, path FROM v_paths_of_headings)
SELECT b.file_hash, b.char_start, b.kind, b.section, h.path FROM b JOIN h USING (file_hash, section)""")
def chk5(v: Views):
    s = chunking.sections(chunking.scan_blocks(v.md))
    return s.select("file_hash", "char_start", "kind", "section", text.heading_text(F.col("heading_path")).alias("path"))


@query("txt6_heading_text", "SELECT file_hash, level, title, path FROM v_paths_of_headings")
def txt6(v: Views):
    rows = chunking.heading_path(chunking.scan_headings(v.md))
    return rows.select("file_hash", "level", "title", text.heading_text(F.col("heading_path")).alias("path"))


def fold_sql(items: str, limit: int) -> str:
    """Greedy groups by recursion over (k, i, n): item ``i`` of key ``k`` counts ``n``."""
    return f"""items AS MATERIALIZED ({items}),
fold AS (SELECT k, i, n AS total, 0 AS grp FROM items WHERE i = 1
  UNION ALL SELECT x.k, x.i, CASE WHEN f.total + x.n > {limit} THEN x.n ELSE f.total + x.n END, CASE WHEN f.total + x.n > {limit} THEN f.grp + 1 ELSE f.grp END
  FROM fold f JOIN items x ON x.k = f.k AND x.i = f.i + 1)"""


@query("chk6_pack_blocks", f"""
WITH {fold_sql("SELECT file_hash AS k, chunk_index + 1 AS i, token_count AS n FROM v_chunks", 120)}
SELECT k AS file_hash, i - 1 AS pos, grp::BIGINT AS "group" FROM fold""")
def chk6(v: Views):
    lines = v.chunks.select("file_hash", F.lit(0).alias("section"), F.col("chunk_index").alias("pos"), "token_count")
    return chunking.pack_blocks(lines, 120).select("file_hash", "pos", "group")


_SENT = r"[^。.?？!\n]*[。.?？!\n]+|[^。.?？!\n]+$"
SQL_VIEWS["v_sentences"] = rf"""SELECT file_hash, pos, s AS sentence, char_start, char_start + len(s) AS char_end, len({tokens_sql('s')}) AS token_count
  FROM (SELECT file_hash, pos, s, coalesce(sum(len(s)) OVER (PARTITION BY file_hash ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start
    FROM (SELECT file_hash, unnest(range(len(x))) AS pos, unnest(x) AS s FROM (SELECT file_hash, regexp_extract_all(text, '{_SENT}') AS x FROM v_content))) WHERE NOT {blank_sql('s')}"""


def sentences(v: Views):
    return chunking.split_sentences(v.content).withColumn("token_count", text.token_count(F.col("sentence")))


@query("chk7_split_sentences", "SELECT * FROM v_sentences")
def chk7(v: Views):
    return sentences(v)


@query("chk8_pack_sentences", """
WITH items AS MATERIALIZED (SELECT file_hash AS k, row_number() OVER (PARTITION BY file_hash ORDER BY pos) AS i, char_start, char_end, token_count AS n FROM v_sentences),
-- state after item i: where the open run starts (null if none), its total; whether this item closed a run, and which
fold AS (SELECT k, i, n, CASE WHEN n > 60 THEN NULL ELSE char_start END AS a, char_end AS b, char_start AS own, CASE WHEN n > 60 THEN 0 ELSE n END AS total, NULL::BIGINT AS done_a, NULL::BIGINT AS done_b FROM items WHERE i = 1
  UNION ALL SELECT x.k, x.i, x.n, CASE WHEN x.n > 60 THEN NULL WHEN f.a IS NULL THEN x.char_start WHEN f.total + x.n > 60 THEN f.own ELSE f.a END, x.char_end, x.char_start,
    CASE WHEN x.n > 60 THEN 0 WHEN f.a IS NULL THEN x.n WHEN f.total + x.n > 60 THEN f.n + x.n ELSE f.total + x.n END,
    CASE WHEN f.a IS NOT NULL AND f.total + x.n > 60 THEN f.a END, CASE WHEN f.a IS NOT NULL AND f.total + x.n > 60 THEN f.b END
  FROM fold f JOIN items x ON x.k = f.k AND x.i = f.i + 1)
SELECT k AS file_hash, done_a AS char_start, done_b AS char_end, false AS oversize FROM fold WHERE done_a IS NOT NULL
UNION ALL SELECT k, own, b, true FROM fold WHERE n > 60
UNION ALL SELECT k, a, b, false FROM fold WHERE a IS NOT NULL AND (k, i) IN (SELECT (k, max(i)) FROM fold GROUP BY k)""")
def chk8(v: Views):
    return chunking.pack_sentences(sentences(v), 60).select("file_hash", "char_start", "char_end", "oversize")


@query("chk9_hard_split", rf"""
WITH p AS (SELECT file_hash, pos, regexp_extract_all(sentence, '[{WS}]*(?:[\p{{L}}\p{{M}}\p{{N}}_]+|[^{WS}\p{{L}}\p{{M}}\p{{N}}_])') AS pieces FROM v_sentences),
w AS (SELECT file_hash, pos, pieces, unnest(range(0, len(pieces), 6)) AS i FROM p),
k AS (SELECT *, len(array_to_string(pieces[1:i], '')) AS begin, array_to_string(pieces[i + 1:i + 8], '') AS inside FROM w WHERE i = 0 OR i - 6 + 8 < len(pieces))
SELECT file_hash, pos, (i // 6)::BIGINT AS "window", begin + len(inside) - len(regexp_replace(inside, '^[{WS}]+', '')) AS rel_start, begin + len(inside) AS rel_end, regexp_replace(inside, '^[{WS}]+', '') AS piece FROM k""")
def chk9(v: Views):
    s = chunking.split_sentences(v.content).select("file_hash", "pos", "sentence")
    return chunking.hard_split(s, "sentence", 8, 50).select("file_hash", "pos", "window", "rel_start", "rel_end", "piece")


@query("chk10_chunk_kind", f"""
WITH b AS (SELECT *, count(*) FILTER (kind = 'heading') OVER (PARTITION BY file_hash ORDER BY pos) AS section FROM v_md_blocks)
SELECT file_hash, section, CASE WHEN count(DISTINCT k) = 1 THEN min(k) ELSE 'mixed' END AS kind FROM (SELECT file_hash, section, CASE kind WHEN 'heading' THEN 'paragraph' ELSE kind END AS k FROM b) GROUP BY file_hash, section""")
def chk10(v: Views):
    s = chunking.sections(chunking.scan_blocks(v.md))
    return s.groupBy("file_hash", "section").agg(chunking.chunk_kind(F.collect_list("kind")).alias("kind"))


@query("chk11_attach_locator", f"""
WITH m AS (SELECT doc, ord, sum(len(piece)) OVER w - len(piece) AS a, sum(len(piece)) OVER w - 1 AS b FROM v_turn_pieces WINDOW w AS (PARTITION BY doc ORDER BY ord)),
t AS (SELECT doc, string_agg(piece, '' ORDER BY ord) AS text FROM v_turn_pieces GROUP BY doc),
l AS (SELECT doc, unnest(range(len(x))) AS pos, unnest(x) AS line FROM (SELECT doc, string_split(text, chr(10)) AS x FROM t)),
s AS (SELECT doc, pos, (coalesce(sum(len(line) + 1) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS char_start FROM l)
SELECT s.doc, s.pos, s.char_start, m.ord AS page FROM s LEFT JOIN m ON m.doc = s.doc AND m.a <= s.char_start AND s.char_start < m.b""")
def chk11(v: Views):
    # the last character of a section is given to nobody, so that some offsets find no entry
    pieces = turn_sections(v)
    entries = pieces.select(F.col("conv_id").alias("doc"), "char_start", (F.col("char_end") - 1).alias("char_end"), "locator")
    docs = assemble.assemble_documents(pieces, "conv_id", ["turn"]).select(F.col("conv_id").alias("doc"), "text")
    lines = chunking.scan_lines(docs, "doc").select("doc", "pos", F.col("char_start").cast("bigint").alias("char_start"))
    return chunking.attach_locator(lines, entries, "doc").select("doc", "pos", "char_start", F.col("locator.page_from").alias("page"))


def markdown_chunks(v: Views, limit: int = 100, overlap: int = 20):
    files = v.md.join(v.content.select("file_hash", "file_path"), "file_hash")
    return chunking.chunk_documents(files, chunking.ChunkerConfig(limit, overlap))


@query("chk12_chunk_documents", f"""
WITH RECURSIVE blocks AS (SELECT *, len({tokens_sql('text')}) AS n, count(*) FILTER (kind = 'heading') OVER (PARTITION BY file_hash ORDER BY pos) AS section, row_number() OVER (PARTITION BY file_hash ORDER BY pos) AS i FROM v_md_blocks),
items AS MATERIALIZED (FROM blocks),
-- greedy packing of whole blocks under 6000 tokens, restarting with every section
fold AS (SELECT file_hash, i, section, n AS total, 0 AS grp FROM items WHERE i = 1
  UNION ALL SELECT x.file_hash, x.i, x.section, CASE WHEN x.section <> f.section OR f.total + x.n > 6000 THEN x.n ELSE f.total + x.n END, CASE WHEN x.section <> f.section OR f.total + x.n > 6000 THEN f.grp + 1 ELSE f.grp END
  FROM fold f JOIN items x ON x.file_hash = f.file_hash AND x.i = f.i + 1),
c AS (SELECT file_hash, grp, section, min(char_start) AS a, max(char_start + len(text)) AS b, CASE WHEN count(DISTINCT CASE kind WHEN 'heading' THEN 'paragraph' ELSE kind END) = 1 THEN min(CASE kind WHEN 'heading' THEN 'paragraph' ELSE kind END) ELSE 'mixed' END AS kind
  FROM fold JOIN items USING (file_hash, i, section) GROUP BY file_hash, grp, section),
h AS (SELECT file_hash, row_number() OVER (PARTITION BY file_hash ORDER BY pos) AS section, path FROM v_paths_of_headings)
SELECT file_hash || ':' || grp AS chunk_id, h.path AS heading_text, {trim_sql('substr(m.text, a + 1, b - a)')} AS content, sha256({trim_sql('substr(m.text, a + 1, b - a)')}) AS content_hash, a AS char_start, b AS char_end, c.kind
FROM c JOIN h USING (file_hash, section) JOIN v_md m USING (file_hash)""")
def chk12(v: Views):
    out = markdown_chunks(v, 6000, 50)
    return out.select("chunk_id", "heading_text", "content", "content_hash", "char_start", "char_end", "kind")


@query("chk12_chunk_documents_split")
def chk12b(v: Views):
    out = markdown_chunks(v)
    return out.select("chunk_id", "heading_text", "content", "token_count", "char_start", "char_end", "kind")
