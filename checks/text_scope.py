"""TXT-*, FLT-1..9 and SRC-* checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import scope, text
from lectern.operators import assemble, context, scopes

from .registry import query
from .views import DEFAULT_EXCLUDED, NOTEBOOKS, SCOPE_SQL, WS, Views, scoped_sql, tokens_sql, trim_sql


@query("txt1_tokens", f"""
SELECT token, count(*) AS n FROM (SELECT unnest({tokens_sql('text')}) AS token FROM documents) GROUP BY token""")
def txt1(v: Views):
    return v.table("documents").select(F.explode(text.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("txt2_token_count", f"SELECT doc_id, len({tokens_sql('text')}) AS token_count FROM documents")
def txt2(v: Views):
    return v.table("documents").select("doc_id", text.token_count(F.col("text")).alias("token_count"))


@query("txt3_content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def txt3(v: Views):
    return v.table("documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


@query("txt4_trim_ws", f"SELECT doc_id, {trim_sql('text')} AS trimmed FROM documents")
def txt4(v: Views):
    return v.table("documents").select("doc_id", text.trim_ws(F.col("text")).alias("trimmed"))


@query("txt5_version_key", """
SELECT source, lang, list_reduce([ascii(c) FOR c IN string_split(k, '')], lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261)::BIGINT AS version
FROM (SELECT DISTINCT source, lang, '2|1|' || source || ':' || lang AS k FROM documents)""")
def txt5(v: Views):
    opts = v.table("documents").select("source", "lang").distinct()
    return opts.select("source", "lang", text.version_key(F.lit(1), F.concat_ws(":", "source", "lang")).alias("version"))


@query("txt7_preview", "SELECT doc_id, substr(text, 1, 200) AS preview FROM documents")
def txt7(v: Views):
    return v.table("documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


# Answers made of conversation turns, with citation marks put in by length.
ANSWER_SQL = """SELECT session_id, pos, content || ' [1]' || content || '[' || (len(content) / 97)::BIGINT || '] [x] [2] [' || pos || ']  ' AS content FROM v_turns WHERE role = 'assistant'"""


def answers(v: Views):
    n = F.round(F.length("content") / 97).cast("bigint").cast("string")
    marked = F.concat("content", F.lit(" [1]"), "content", F.lit("["), n, F.lit("] [x] [2] ["), F.col("pos").cast("string"), F.lit("]  "))
    return v.turns.filter(F.col("role") == "assistant").select("session_id", "pos", marked.alias("content"))


@query("txt8_extract_citations", rf"""
WITH a AS ({ANSWER_SQL}),
m AS (SELECT session_id, pos, (regexp_extract_all(content, '\[(\d+)\]', 1)) AS marks FROM a),
e AS (SELECT session_id, pos, unnest(range(len(marks))) AS mark_no, unnest(marks)::BIGINT AS index FROM m),
c AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY pos) AS index, pos AS cited_pos FROM v_turns)
SELECT session_id, pos, mark_no, index, cited_pos, cited_pos IS NULL AS dangling FROM e LEFT JOIN c USING (session_id, index)""")
def txt8(v: Views):
    from lectern.operators.conversations import answer_citations
    from lectern.operators.scans import prefix_scan

    a = answers(v).select(F.concat_ws("/", "session_id", F.col("pos").cast("string")).alias("answer_id"), "session_id", "pos", "content")
    cites = prefix_scan(v.turns, ["session_id"], ["pos"], rank="index").select("session_id", F.col("index"), F.col("pos").alias("cited_pos"))
    c = a.select("answer_id", "session_id").join(cites, "session_id").select("answer_id", "index", "cited_pos")
    found, dangling = answer_citations(a, c)
    both = found.select("answer_id", "mark_no", "index", "cited_pos", F.lit(False).alias("dangling")).unionByName(
        dangling.select("answer_id", "mark_no", "index", F.lit(None).cast("bigint").alias("cited_pos"), F.lit(True).alias("dangling"))
    )
    return both.join(a.select("answer_id", "session_id", "pos"), "answer_id").drop("answer_id")


@query("txt9_trailing_citations", rf"""
WITH a AS ({ANSWER_SQL})
SELECT session_id, pos, {trim_sql(rf"regexp_replace(content, '((?:[{WS}]*\[\d+\])+)[{WS}]*$', '')")} AS body,
  array_to_string(regexp_extract_all(regexp_extract(content, '((?:[{WS}]*\[\d+\])+)[{WS}]*$', 1), '\[(\d+)\]', 1), ',') AS marks FROM a""")
def txt9(v: Views):
    body, marks = text.trailing_citations(F.col("content"))
    return answers(v).select("session_id", "pos", body.alias("body"), F.array_join(marks.cast("array<string>"), ",").alias("marks"))


QUESTION_WORDS = "the|des|und|que"


@query("txt10_is_summary_question", rf"""
SELECT session_id, pos, regexp_matches(content, '(?i)(?:^|[^\p{{L}}])(?:{QUESTION_WORDS})(?:[^\p{{L}}]|$)') AS by_word, regexp_matches(content, '{text.SUMMARY_KEYWORDS}') AS by_default FROM v_turns""")
def txt10(v: Views):
    c = F.col("content")
    return v.turns.select(
        "session_id", "pos", text.is_summary_question(c, rf"(?i)(?:^|[^\p{{L}}])(?:{QUESTION_WORDS})(?:[^\p{{L}}]|$)").alias("by_word"),
        text.is_summary_question(c).alias("by_default"),
    )


@query("txt11_note_filename", rf"""
WITH h AS (SELECT session_id, pos, created_at, regexp_replace(regexp_replace(regexp_replace(substr(content, 1, 20), '[\\/:*?"<>|]', '-', 'g'), '^[{WS}.\-]+', ''), '[{WS}.\-]+$', '') AS head FROM v_turns)
SELECT session_id, pos, CASE WHEN head <> '' THEN head || ' ' ELSE '' END || strftime(make_timestamp(created_at * 1000000), '%Y-%m-%d %H-%M-%S') || '.md' AS filename FROM h""")
def txt11(v: Views):
    return v.turns.select("session_id", "pos", text.note_filename(F.col("content"), F.timestamp_seconds("created_at")).alias("filename"))


@query("txt11_title_slug", r"""SELECT page_id, substr(regexp_replace(url, '[\\/:*?"<>|]', '_', 'g'), 1, 50) AS slug FROM pages""")
def txt11b(v: Views):
    return v.table("pages").select("page_id", text.title_slug(F.col("url")).alias("slug"))


# One error message per event, its form given by the event's type and its numbers by the event's own.
ERROR_SQL = """SELECT event_id, CASE event_type
  WHEN 'view' THEN 'Your request exceeded model token limit: ' || event_id || ' (requested: ' || (event_id + user_id) || ')'
  WHEN 'click' THEN 'maximum context length is ' || event_id || ' tokens. However, your messages' || chr(10) || 'resulted in ' || user_id || ' tokens'
  WHEN 'signup' THEN 'HTTP ' || (400 + user_id) || ': error' WHEN 'purchase' THEN 'context length: ' || user_id ELSE 'Rate-Limit reached' END AS msg FROM events"""


def error_messages(v: Views):
    e, u, t = F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.col("event_type")
    msg = (
        F.when(t == "view", F.concat(F.lit("Your request exceeded model token limit: "), e, F.lit(" (requested: "), (F.col("event_id") + F.col("user_id")).cast("string"), F.lit(")")))
        .when(t == "click", F.concat(F.lit("maximum context length is "), e, F.lit(" tokens. However, your messages\nresulted in "), u, F.lit(" tokens")))
        .when(t == "signup", F.concat(F.lit("HTTP "), (F.col("user_id") + 400).cast("string"), F.lit(": error")))
        .when(t == "purchase", F.concat(F.lit("context length: "), u))
        .otherwise("Rate-Limit reached")
    )
    return v.table("events").select("event_id", msg.alias("msg"))


@query("txt12_classify_error", rf"""
WITH m AS ({ERROR_SQL}), n AS (SELECT *, 
  try_cast(regexp_extract(msg, '(?i)\b(?:token limit|context length is|context length)\W+(\d+)', 1) AS BIGINT) AS model_limit,
  try_cast(regexp_extract(msg, '(?i)\b(?:requested|resulted in)\W+(\d+)', 1) AS BIGINT) AS named FROM m)
SELECT event_id, regexp_matches(msg, '(?is)token limit|maximum context length|context_length_exceeded|context length\b') AS is_token_limit,
  model_limit, CASE WHEN model_limit IS NOT NULL THEN named END AS requested,
  regexp_matches(msg, '(?i)HTTP (429|502|503|504)|overload|rate.?limit|too many requests|engine.busy') AS is_retryable FROM n""")
def txt12(v: Views):
    return error_messages(v).select("event_id", *[c.alias(n) for n, c in text.classify_error(F.col("msg")).items()])


@query("txt13_offset_to_line_col", """
WITH o AS (SELECT c.chunk_id, t.text, least(c.char_start + c.token_count, len(t.text)) AS upto FROM v_chunks c JOIN v_content t USING (file_hash))
SELECT chunk_id, len(substr(text, 1, upto)) - len(replace(substr(text, 1, upto), chr(10), '')) AS line,
  len(string_split(substr(text, 1, upto), chr(10))[-1]) AS col FROM o""")
def txt13(v: Views):
    both = v.chunks.join(v.content.select("file_hash", "text"), "file_hash")
    line, col = text.offset_to_line_col(F.col("text"), F.col("char_start") + F.col("token_count"))
    return both.select("chunk_id", line.alias("line"), col.alias("col"))


@query("txt14_l2_normalize", """
WITH e AS (SELECT vec_id, [x::DOUBLE * (label + 1) FOR x IN embedding] AS w FROM embeddings),
u AS (SELECT vec_id, unnest(w) AS x, unnest(range(len(w))) AS i, sqrt(list_dot_product(w, w)) AS norm FROM e)
SELECT vec_id, i, round(x / norm, 6) AS x FROM u""")
def txt14(v: Views):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1))
    unit = v.table("embeddings").select("vec_id", F.posexplode(text.l2_normalize(scaled)).alias("i", "x"))
    return unit.select("vec_id", "i", F.round("x", 6).alias("x"))


@query("txt15_decode_text", "SELECT doc_id, text FROM documents")
def txt15(v: Views):
    raw = v.table("documents").select("doc_id", F.concat(F.lit(b"\xef\xbb\xbf"), F.encode("text", "UTF-8")).alias("bytes"))
    return raw.select("doc_id", text.decode_text(F.col("bytes")).alias("text"))


GLOBS = {
    "exact": ("notes/src1/en/1.md", "file_path = 'notes/src1/en/1.md'"),
    "suffix": ("*7.md", "suffix(file_path, '7.md')"),
    "prefix": ("notes/src1*", "starts_with(file_path, 'notes/src1')"),
    "star": ("notes/*/fr/*", "regexp_full_match(file_path, 'notes/[^/]*/fr/[^/]*')"),
    "globstar": ("notes/**/1*.md", "regexp_full_match(file_path, 'notes/(?:.*/)?1[^/]*\\.md')"),
    "tail": ("notes/src2/**", "regexp_full_match(file_path, 'notes/src2/.*')"),
    "meta": ("notes/src(1|2)/**", "regexp_full_match(file_path, 'notes/src\\(1\\|2\\)/.*')"),
    "hidden": ("**/.fr/**", "regexp_full_match(file_path, '.*/\\.fr/.*')"),
}


@query("flt1_glob_match", "SELECT doc_id, " + ", ".join(f"{sql} AS m_{n}" for n, (_, sql) in GLOBS.items()) + " FROM v_paths")
def flt1(v: Views):
    return v.paths.select("doc_id", *[scope.glob_match(F.col("file_path"), g).alias(f"m_{n}") for n, (g, _) in GLOBS.items()])


@query("flt2_in_source", "SELECT doc_id, " + ", ".join(f"({c}) AS in_{nb}_{s}" for (nb, s, _), c in SCOPE_SQL.items()) + " FROM v_paths")
def flt2(v: Views):
    cols = [
        scope.in_source(F.col("file_path"), s).alias(f"in_{nb.notebook_id}_{s.source_id}") for nb in NOTEBOOKS for s in nb.sources if s.enabled
    ]
    return v.paths.select("doc_id", *cols)


@query("flt3_in_scope", f"SELECT doc_id, notebook_id FROM ({scoped_sql('v_paths')})")
def flt3(v: Views):
    return scope.in_notebooks(v.paths, NOTEBOOKS).select("doc_id", "notebook_id")


@query("flt4_resolve_source", f"SELECT doc_id, notebook_id, source_id FROM ({scoped_sql('v_paths')})")
def flt4(v: Views):
    return scope.in_notebooks(v.paths, NOTEBOOKS).select("doc_id", "notebook_id", "source_id")


@query("flt5_covers_file", """
SELECT doc_id, ext = 'md' AND (starts_with(file_path, 'notes/src1//') OR starts_with(file_path, 'notes/')) AS by_nb1, ext IN ('md', 'txt') AND starts_with(file_path, 'notes/') AS by_nb2,
  ext = 'md' AND (starts_with(file_path, 'notes/src2/fr/') OR starts_with(file_path, 'notes/src7/')) AS by_nb3
FROM (SELECT *, string_split(file_path, '.')[-1] AS ext FROM v_paths)""")
def flt5(v: Views):
    return v.paths.select("doc_id", *[scope.covers_file(F.col("file_path"), nb).alias(f"by_{nb.notebook_id}") for nb in NOTEBOOKS])


@query("flt6_size_limit", """
SELECT doc_id, ext, CASE ext WHEN 'md' THEN size <= 10485760 WHEN 'docx' THEN size <= 31457280 WHEN 'xlsx' THEN size <= 52428800 ELSE true END AS allowed,
  CASE WHEN ext = 'docx' AND size >= 10485760 OR ext = 'xlsx' AND size >= 20971520 THEN 'slow' ELSE 'fast' END AS lane
FROM (SELECT doc_id, n_chars * 4000 AS size, CASE lang WHEN 'en' THEN 'md' WHEN 'de' THEN 'docx' WHEN 'fr' THEN 'xlsx' ELSE 'pdf' END AS ext FROM documents)""")
def flt6(v: Views):
    ext = F.when(F.col("lang") == "en", "md").when(F.col("lang") == "de", "docx").when(F.col("lang") == "fr", "xlsx").otherwise("pdf")
    size = F.col("n_chars") * 4000
    return v.table("documents").select("doc_id", ext.alias("ext"), scope.under_size_limit(ext, size).alias("allowed"), scope.lane(ext, size).alias("lane"))


@query("flt8_chunks_for_file", """
SELECT s.file_path, c.chunk_id, c.chunk_index, c.content FROM v_scoped s JOIN v_content t USING (file_hash) JOIN v_chunks c USING (file_hash)
WHERE s.notebook_id = 'nb3' AND t.status = 'ok'""")
def flt8(v: Views):
    alive = v.scoped.filter(F.col("notebook_id") == "nb3")
    return context.chunks_for_file(alive, v.content, v.chunks).select("file_path", "chunk_id", "chunk_index", "content")


@query("flt9_chunk_preview", """
SELECT chunk_id, '#' || chunk_index || ' · paragraph · ' || token_count || ' tokens' AS header,
  'Page ' || (chunk_index + 1) || '-' || (chunk_index + 2) AS "where", CASE WHEN len(content) > 200 THEN substr(content, 1, 200) || '…' ELSE content END AS preview FROM v_chunks""")
def flt9(v: Views):
    page = assemble.locator("page", page_from=F.col("chunk_index") + 1, page_to=F.col("chunk_index") + 2)
    return context.chunk_preview(v.chunks.withColumns({"kind": F.lit("paragraph"), "locator": page})).select("chunk_id", "header", "where", "preview")


# Two rules for each customer: a folder of its own, and a glob over all notes.
RULES_SQL = """
SELECT 'c' || c_custkey AS notebook_id, 0 AS ord, 'own' AS source_id, 'notes/src' || (c_custkey % 20) || '/' || CASE c_custkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'es/' ELSE '.fr' END AS base, NULL::VARCHAR AS suffix, c_custkey % 5 = 0 AS every FROM customer
UNION ALL SELECT 'c' || c_custkey, 1, 'glob', 'notes', (c_custkey % 500) || '.md', false FROM customer"""


def customer_rules(v: Views):
    key = F.col("c_custkey")
    name = F.concat(F.lit("c"), key.cast("string")).alias("notebook_id")
    lang = F.when(key % 3 == 0, "en").when(key % 3 == 1, "es/").otherwise(".fr")
    none = F.array().cast("array<string>")
    own = v.table("customer").select(
        name, F.lit(0).alias("ord"), F.lit("own").alias("source_id"), F.concat(F.lit("notes/src"), (key % 20).cast("string"), F.lit("/"), lang).alias("path"),
        F.lit(True).alias("recursive"), none.alias("include_globs"), F.when(key % 5 == 0, none).alias("exclude_globs"), F.lit(True).alias("enabled"),
    )
    number = (key % 500).cast("string")
    globs = F.array(F.concat(F.lit("notes/src1/**/*"), number, F.lit(".md")), F.concat(F.lit("notes/**/en/*"), number, F.lit(".md")))
    wide = v.table("customer").select(
        name, F.lit(1).alias("ord"), F.lit("glob").alias("source_id"), F.lit("notes/").alias("path"), F.lit(True).alias("recursive"),
        globs.alias("include_globs"), F.lit(None).cast("array<string>").alias("exclude_globs"), F.lit(True).alias("enabled"),
    )
    return own.unionByName(wide)


@query("flt4_scopes_table", rf"""
WITH r AS ({RULES_SQL}),
p AS (SELECT doc_id, file_path, {DEFAULT_EXCLUDED} AS dropped FROM v_paths),
m AS (SELECT doc_id, notebook_id, ord, source_id FROM p JOIN r ON starts_with(file_path, rtrim(base, '/') || '/') AND (every OR NOT dropped)
    AND (r.suffix IS NULL OR (ends_with(file_path, r.suffix) AND (starts_with(file_path, 'notes/src1/') OR regexp_full_match(file_path, 'notes/(?:.*/)?en/[^/]*')))))
SELECT doc_id, notebook_id, source_id FROM m QUALIFY row_number() OVER (PARTITION BY doc_id, notebook_id ORDER BY ord) = 1""")
def flt4_table(v: Views):
    return scopes.in_scopes(v.paths, customer_rules(v)).select("doc_id", "notebook_id", "source_id")
