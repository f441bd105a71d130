"""SUM-*, GEN-*, CNV-*, SRC-* and UDF-* checks."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from lectern import schemas, sources, udfs
from lectern.functions import text
from lectern.operators import conversations, generation, lexical, summaries

from .registry import query
from .retrieval import DIGITS, summarised
from .views import NOTEBOOKS, SQL_VIEWS, Views, blank_sql, shared_folder, trim_sql


@query("sum1_scoped_content", "SELECT file_hash FROM v_content WHERE status = 'ok' AND file_hash IN (SELECT file_hash FROM v_scoped WHERE notebook_id = 'nb1')")
def sum1(v: Views):
    return summaries.scoped_content(v.content, v.scoped.filter("notebook_id = 'nb1'")).select("file_hash")


@query("sum2_summary_candidates", "SELECT file_hash, file_hash IN (SELECT file_hash FROM v_chunks WHERE token_count > 3) AS has_text FROM v_content WHERE lang <> 'en'")
def sum2(v: Views):
    have = v.content.withColumn("summary", F.when(F.col("lang") == "en", "done"))
    worded = v.chunks.withColumn("content", F.when(F.col("token_count") > 3, F.col("content")).otherwise(" "))
    return summaries.summary_candidates(have, worded).select("file_hash", "has_text")


@query("sum3_summary_input", "SELECT file_hash, substr(string_agg(content, chr(10) ORDER BY chunk_index), 1, 6000) AS input FROM v_chunks GROUP BY file_hash")
def sum3(v: Views):
    return summaries.summary_input(v.chunks)


def first_sentence(prompt: str) -> str:
    if "http" in prompt:
        raise ValueError("HTTP 400: refused")
    return prompt.split(".")[0] + "."


@query("sum4_backfill_summaries", rf"""
WITH i AS (SELECT file_hash, substr(string_agg(content, chr(10) ORDER BY chunk_index), 1, 6000) AS input FROM v_chunks GROUP BY file_hash)
SELECT file_hash, CASE WHEN NOT contains(input, 'http') THEN {trim_sql("string_split(input, '.')[1] || '.'")} END AS summary, CASE WHEN contains(input, 'http') THEN 'HTTP 400: refused' END AS error FROM i""")
def sum4(v: Views):
    none = v.content.withColumn("summary", F.lit(None).cast("string"))
    return summaries.backfill_summaries(none, v.chunks, first_sentence, "lead", calls_at_a_time=8).select("file_hash", "summary", "error")


@query("sum4_backfill_report", """
WITH i AS (SELECT file_hash, substr(string_agg(content, chr(10) ORDER BY chunk_index), 1, 6000) AS input FROM v_chunks GROUP BY file_hash)
SELECT count(*) FILTER (NOT contains(input, 'http')) AS done, count(*) FILTER (contains(input, 'http')) AS failed, count(*) AS total, (SELECT count(*) FROM v_content) - count(*) AS skipped, max(CASE WHEN contains(input, 'http') THEN 'HTTP 400: refused' END) AS last_error FROM i""")
def sum4b(v: Views):
    none = v.content.withColumn("summary", F.lit(None).cast("string"))
    results = summaries.backfill_summaries(none, v.chunks, first_sentence, "lead", calls_at_a_time=8)
    return summaries.backfill_report(summaries.summary_candidates(none, v.chunks), results)


@query("sum5_search_summaries", "SELECT query_id, chunk_id AS file_hash, score, rank FROM v_sum_all_hits WHERE rank <= 25")
def sum5(v: Views):
    return summaries.search_summaries(v.q, summarised(v), 25, lexical.Bm25(boosts={}, digits=DIGITS))


@query("sum6_summary_coverage", "SELECT count(*) AS total, count(*) FILTER (lang = 'en') AS with_summary FROM v_content")
def sum6(v: Views):
    return summaries.summary_coverage(v.content.withColumn("summary", F.when(F.col("lang") == "en", "done").otherwise("")))


SQL_VIEWS["v_corpus_rows"] = """SELECT s.notebook_id, c.*, row_number() OVER (PARTITION BY s.notebook_id ORDER BY c.file_path, c.chunk_index, c.chunk_id) AS index
  FROM (SELECT DISTINCT notebook_id, file_hash FROM v_scoped) s JOIN v_content t USING (file_hash) JOIN v_chunks c USING (file_hash) WHERE t.status = 'ok'"""


def corpus_of(v: Views):
    return generation.collect_corpus(v.chunks, v.content, v.scoped)


@query("gen1_collect_corpus", "SELECT notebook_id, chunk_id, file_path, chunk_index FROM v_corpus_rows")
def gen1(v: Views):
    return corpus_of(v).select("notebook_id", "chunk_id", "file_path", "chunk_index")


SQL_VIEWS["v_fitted"] = """SELECT *, count(*) OVER (PARTITION BY notebook_id) < n AS truncated FROM (
  SELECT *, sum(token_count + 30) OVER (PARTITION BY notebook_id ORDER BY index) AS spent, count(*) OVER (PARTITION BY notebook_id) AS n FROM v_corpus_rows) WHERE spent <= 114000 OR index = 1"""


@query("gen2_generation_budget", "SELECT user_id, greatest(CASE WHEN min(value) < 1 THEN 128000 ELSE (count(*) * 200)::BIGINT END - 14000, 1000) AS budget FROM events GROUP BY user_id")
def gen2(v: Views):
    models = v.table("events").groupBy("user_id").agg(F.when(F.min("value") >= 1, F.count(F.lit(1)) * 200).alias("context_tokens"))
    return models.select("user_id", generation.generation_budget(F.col("context_tokens")).alias("budget"))


@query("gen2_budget_prefix", "SELECT notebook_id, chunk_id, index, truncated FROM v_fitted")
def gen2b(v: Views):
    return generation.budget_prefix(corpus_of(v), 114_000).select("notebook_id", "chunk_id", "index", "truncated")


_KINDS = {"nb1": "summary", "nb2": "timeline", "nb3": "ppt"}


@query("gen3_generation_prompt", f"""
WITH m AS (SELECT notebook_id, string_agg('[' || index || '] ' || heading_text || ' — ' || file_path || chr(10) || content || chr(10), chr(10) ORDER BY index) AS materials, bool_or(truncated) AS truncated FROM v_fitted GROUP BY notebook_id),
k AS ({" UNION ALL ".join(f"SELECT '{n}' AS notebook_id, '{k}' AS kind, '{generation.TEMPLATES[k].replace(chr(39), chr(39) * 2)}' AS template" for n, k in _KINDS.items())})
SELECT notebook_id, kind, template || chr(10) || '{generation.CITE}' || chr(10) || chr(10) || '{generation.MATERIALS}' || chr(10) || coalesce(materials, '{generation.NO_MATERIALS}') AS system_prompt, '{generation.ASK}' AS user_prompt, coalesce(truncated, false) AS truncated
FROM (FROM k UNION ALL SELECT 'nb-empty', 'faq', '{generation.TEMPLATES["faq"].replace(chr(39), chr(39) * 2)}') LEFT JOIN m USING (notebook_id)""")
def gen3(v: Views):
    kind = F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])
    requests = v.scoped.select("notebook_id").distinct().withColumn("kind", F.try_element_at(kind, F.col("notebook_id")))
    requests = requests.unionByName(v.scoped.select(F.lit("nb-empty").alias("notebook_id"), F.lit("faq").alias("kind")).distinct())
    return generation.generation_prompt(generation.budget_prefix(corpus_of(v), 114_000), requests)


# Outlines: each line of a document is an item, indented by its number of tokens (odd indents and jumps included).
def outlines(v: Views):
    lines = v.chunks.withColumn("line", F.concat(F.repeat(F.lit(" "), F.pmod(F.col("token_count"), F.lit(7))), F.lit("- "), "content", F.lit(" [3][7]")))
    lines = lines.withColumn("line", F.when(F.col("chunk_index") == 0, F.concat(F.lit("- "), "content")).otherwise(F.col("line")))
    return lines.groupBy("file_hash").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "line"))), lambda x: x["line"]), "\n").alias("outline"))


@query("gen4_parse_outlines", r"""
WITH RECURSIVE l AS (SELECT file_hash, chunk_index AS i, content, token_count % 7 AS indent,
    CASE WHEN chunk_index = 0 THEN 0 WHEN token_count % 7 % 2 = 1 THEN -2 ELSE token_count % 7 // 2 END AS d FROM v_chunks),
w AS (
  SELECT DISTINCT file_hash, (-1)::BIGINT AS i, []::BIGINT[] AS last_at, 0::BIGINT AS n, NULL::BIGINT AS node_id, NULL::BIGINT AS parent_id, NULL::BIGINT AS depth, NULL::VARCHAR AS text, NULL::VARCHAR AS error FROM l
  UNION ALL
  SELECT file_hash, i, CASE WHEN ok THEN last_at[1:dd] || [n] ELSE last_at END, n + ok::BIGINT, CASE WHEN ok THEN n END, CASE WHEN ok AND dd > 0 THEN last_at[dd] END, CASE WHEN ok THEN dd END,
    CASE WHEN d = -2 THEN '- ' || content || ' [3][7]' ELSE content END,
    CASE WHEN d = -2 THEN 'uneven indent' WHEN NOT ok THEN 'no item above it' WHEN d = 0 AND n > 0 THEN 'second root, put under the first' END
  FROM (SELECT *, d >= 0 AND dd <= len(last_at) AS ok FROM (
    SELECT l.file_hash, l.i, w.last_at, w.n, l.d, l.content, CASE WHEN l.d = 0 AND w.n > 0 THEN 1 ELSE l.d END::BIGINT AS dd FROM w JOIN l ON l.file_hash = w.file_hash AND l.i = w.i + 1)))
SELECT file_hash, i + 1 AS line_no, node_id, parent_id, depth, text, error FROM w WHERE i >= 0""")
def gen4(v: Views):
    out = generation.parse_outlines(outlines(v), "file_hash", "outline")
    return out.select("file_hash", "line_no", "node_id", "parent_id", "depth", "text", "error")


@query("gen4_outline_errors", r"""
SELECT file_hash, count(*) AS n_lines, count(*) FILTER (i > 0 AND indent IN (1, 3, 5)) AS n_odd, count(*) FILTER (i > 0 AND indent = 0) AS n_extra_roots
FROM (SELECT file_hash, chunk_index AS i, token_count % 7 AS indent FROM v_chunks) GROUP BY file_hash""")
def gen4b(v: Views):
    out = generation.parse_outlines(outlines(v), "file_hash", "outline")
    return out.groupBy("file_hash").agg(
        F.countDistinct("line_no").alias("n_lines"), F.count_if(F.col("error") == "uneven indent").alias("n_odd"), F.count_if(F.col("error").startswith("second root")).alias("n_extra_roots")
    )


SQL_VIEWS["v_decks"] = "SELECT file_hash, lang, CASE WHEN lang = 'de' THEN chr(10) || '---' || chr(10) || 'marp: true' || chr(10) || '---' || chr(10) ELSE '' END || regexp_replace(text, '\\n([A-H])', chr(10) || '---  ' || chr(10) || '\\1', 'g') || chr(10) || '---' || chr(10) || '---' AS deck FROM v_content"


def decks(v: Views):
    front = F.when(F.col("lang") == "de", "\n---\nmarp: true\n---\n").otherwise("")
    return v.content.select("file_hash", "lang", F.concat(front, F.regexp_replace("text", r"\n([A-H])", "\n---  \n$1"), F.lit("\n---\n---")).alias("deck"))


@query("gen5_split_slides", rf"""
WITH b AS (SELECT file_hash, CASE WHEN lang = 'de' THEN substr(deck, 21) ELSE deck END AS body FROM v_decks),
s AS (SELECT file_hash, unnest(range(len(x))) AS i, unnest(x) AS slide FROM (SELECT file_hash, regexp_split_to_array(body, '(?m)^---[ \t\r]*$') AS x FROM b))
SELECT file_hash, row_number() OVER (PARTITION BY file_hash ORDER BY i) - 1 AS slide_no, {trim_sql('slide')} AS slide FROM s WHERE NOT {blank_sql('slide')}""")
def gen5(v: Views):
    return generation.split_slides(decks(v), "file_hash", "deck")


SQL_VIEWS["v_artifacts"] = "SELECT 'a' || event_id AS artifact_id, 'n' || user_id AS notebook_id, event_type AS kind, epoch_us(ts) // 1000 AS generated_at FROM events"


def artifacts(v: Views):
    return v.table("events").select(
        F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("artifact_id"), F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("notebook_id"),
        F.col("event_type").alias("kind"), F.unix_millis(F.col("ts").cast("timestamp")).alias("generated_at"),
    )


@query("gen6_list_artifacts", "SELECT notebook_id, artifact_id, row_number() OVER (PARTITION BY notebook_id ORDER BY generated_at DESC, artifact_id) AS position FROM v_artifacts")
def gen6(v: Views):
    return generation.list_artifacts(artifacts(v)).select("notebook_id", "artifact_id", "position")


@query("gen6_delete_artifacts", "SELECT artifact_id FROM v_artifacts WHERE kind <> 'click'")
def gen6b(v: Views):
    gone = artifacts(v).filter("kind = 'click'").select("artifact_id")
    return generation.delete_artifacts(artifacts(v), gone.unionByName(gone.select(F.concat("artifact_id", F.lit("-")).alias("artifact_id")))).select("artifact_id")


@query("gen7_artifact_export", f"""
WITH d AS (SELECT file_hash, lang, chr(96) || chr(96) || chr(96) || 'mermaid' || chr(10) || CASE WHEN source > 'src5' THEN '%%{{init: x}}%%' || chr(10) ELSE '' END || text AS body, source FROM v_content)
SELECT file_hash, CASE WHEN lang = 'en' THEN '# ' || source || chr(10) || chr(10) || '> by m' || chr(10) || chr(10) || body || chr(10)
  ELSE '---' || chr(10) || 'marp: true' || chr(10) || 'theme: default' || chr(10) || 'paginate: true' || chr(10) || '---' || chr(10) || chr(10) || '<!-- by m -->' || chr(10) || chr(10) ||
    CASE WHEN source > 'src5' THEN body ELSE replace(body, chr(96) || chr(96) || chr(96) || 'mermaid' || chr(10), chr(96) || chr(96) || chr(96) || 'mermaid' || chr(10) || '{generation.MERMAID_INIT.replace("'", "''")}' || chr(10)) END || chr(10) END AS export FROM d""")
def gen7(v: Views):
    body = F.concat(F.lit("```mermaid\n"), F.when(F.col("source") > "src5", "%%{init: x}%%\n").otherwise(""), "text")
    kind = F.when(F.col("lang") == "en", "summary").otherwise("ppt")
    return v.content.select("file_hash", generation.artifact_export(kind, F.col("source"), F.lit("by m"), body).alias("export"))


@query("cnv1_append_turn", """
WITH last AS (SELECT session_id, max(pos) AS p FROM v_turns GROUP BY session_id),
n AS (SELECT 's' || user_id AS session_id, event_id FROM events WHERE event_type = 'view')
SELECT session_id, event_id, CASE WHEN p IS NOT NULL THEN p + row_number() OVER (PARTITION BY session_id ORDER BY event_id) END AS pos FROM n LEFT JOIN last USING (session_id)""")
def cnv1(v: Views):
    new = v.table("events").filter("event_type = 'view'").select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), F.col("event_id").alias("ord"))
    rows, unknown = conversations.append_turn(v.turns, new)
    both = rows.select("session_id", "ord", "pos").unionByName(unknown.select("session_id", "ord", F.lit(None).cast("bigint").alias("pos")))
    return both.withColumnRenamed("ord", "event_id")


@query("cnv2_sessions", "SELECT session_id, count(*) AS n_turns, count(*) FILTER (role = 'user') AS n_questions, min(created_at) AS created_at, max(created_at) AS updated_at FROM v_turns GROUP BY session_id")
def cnv2(v: Views):
    return conversations.sessions(v.turns)


@query("cnv2_delete_sessions", "SELECT session_id, pos FROM v_turns WHERE session_id NOT IN (SELECT session_id FROM v_turns WHERE role = 'system')")
def cnv2b(v: Views):
    return conversations.delete_sessions(v.turns, v.turns.filter("role = 'system'").select("session_id")).select("session_id", "pos")


@query("cnv3_history", "SELECT session_id, pos, role FROM v_turns WHERE role <> 'system' AND len(content) <= 800")
def cnv3(v: Views):
    return conversations.history(v.turns.withColumn("error", F.when(F.length("content") > 800, "too long"))).select("session_id", "pos", "role")


SQL_VIEWS["v_questions"] = """SELECT session_id, pos, content, coalesce(last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS question, role FROM v_turns"""


@query("cnv4_question_of", "SELECT session_id, pos, question FROM v_questions WHERE role = 'assistant'")
def cnv4(v: Views):
    return conversations.question_of(v.turns).select("session_id", "pos", "question")


@query("cnv5_note_markdown", rf"""
SELECT session_id, pos, '# ' || CASE WHEN {trim_sql('question')} = '' THEN '(no question)' ELSE {trim_sql('question')} END || chr(10) || chr(10) || '> ' || strftime(make_timestamp(pos * 1000000), '%Y-%m-%d %H:%M:%S') || ' — nb' || chr(10) || chr(10) || content
  || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Sources'
  || chr(10) || chr(10) || '### [1] (untitled)' || chr(10) || chr(10) || 'From [[a.md]], characters 0 to ' || pos || chr(10) || chr(10) || '> ' || substr(content, 1, 200)
  || chr(10) || chr(10) || '### [2] A > B' || chr(10) || chr(10) || 'From [[b.md]], characters 1 to 2' || chr(10) || chr(10) || '> ' || substr(question, 1, 200) || chr(10) AS note FROM v_questions WHERE role = 'assistant'""")
def cnv5(v: Views):
    asked = conversations.question_of(v.turns)

    def cite(index, path, heading, start, end, body):
        return F.struct(
            F.lit(index).alias("index"), F.lit("c").alias("chunk_id"), F.lit(path).alias("file_path"), F.lit(heading).alias("heading_text"),
            F.lit(start).alias("char_start"), end.cast("int").alias("char_end"), text.preview(body).alias("preview"),
        )

    cites = F.array(cite(2, "b.md", "A > B", 1, F.lit(2), F.col("question")), cite(1, "a.md", "", 0, F.col("pos"), F.col("content")))
    note = conversations.note_markdown(F.col("question"), F.col("content"), F.lit("nb"), F.timestamp_seconds("pos"), cites)
    return asked.select("session_id", "pos", note.alias("note"))


@query("cnv6_dedupe_names", """
WITH n AS (SELECT event_id, event_type || '-' || user_id AS stem, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS j FROM events),
-- taken: the bare name of every user under 50, and number 3 of every user
t AS (SELECT DISTINCT stem, 1 AS k FROM n WHERE split_part(stem, '-', 2)::INT < 50 UNION ALL SELECT DISTINCT stem, 3 FROM n),
c AS (SELECT stem, unnest(range(1, max(j) + 3)) AS k FROM n GROUP BY stem),
f AS (SELECT stem, k, row_number() OVER (PARTITION BY stem ORDER BY k) AS j FROM c WHERE (stem, k) NOT IN (SELECT (stem, k) FROM t))
SELECT event_id, stem || CASE WHEN k = 1 THEN '' ELSE ' (' || k || ')' END || '.md' AS unique_name FROM n JOIN f USING (stem, j)""")
def cnv6(v: Views):
    user = F.col("user_id").cast("string")
    names = v.table("events").select("event_id", "user_id", F.concat_ws("-", "event_type", user).alias("stem"))
    first = names.filter("user_id < 50").select(F.concat("stem", F.lit(".md")).alias("name"))
    third = names.select(F.concat("stem", F.lit(" (3).md")).alias("name"))
    taken = first.unionByName(third).distinct()
    wanted = names.select("event_id", F.concat("stem", F.lit(".md")).alias("name"))
    return conversations.dedupe_names(wanted, taken, "event_id").select("event_id", "unique_name")


# A response per session: one frame per turn, a broken one before, usage at the end.
def frames(v: Views):
    delta = F.concat(F.lit('data: {"choices":[{"delta":{"content":'), F.to_json(F.struct("content")).substr(F.lit(12), F.length(F.to_json(F.struct("content"))) - 12), F.lit("}}]}"))
    body = v.turns.select(F.col("session_id").alias("response_id"), (F.col("pos") * 2 + 1).alias("seq"), F.concat(F.lit("event: x\n"), delta).alias("block"))
    broken = v.turns.select(F.col("session_id").alias("response_id"), (F.col("pos") * 2).alias("seq"), F.lit('data: {"choices":[{"del').alias("block"))
    usage = v.turns.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("session_id").alias("response_id"), F.lit(1_000_000).cast("bigint").alias("seq"),
        F.concat(F.lit('data: {"choices":[],"usage":{"prompt_tokens":1,"completion_tokens":2,"total_tokens":'), F.col("n").cast("string"), F.lit("}}\ndata: [DONE]")).alias("block"),
    )
    return body.unionByName(broken).unionByName(usage)


@query("cnv7_assemble_stream", "SELECT session_id AS response_id, string_agg(content, '' ORDER BY pos) AS content, true AS done, count(*) AS total_tokens FROM v_turns GROUP BY session_id")
def cnv7(v: Views):
    return conversations.assemble_stream(frames(v))


@query("cnv8_response_text", """
SELECT session_id, pos, CASE role WHEN 'system' THEN NULL ELSE content END AS content, CASE WHEN role <> 'system' THEN pos END AS total_tokens, CASE WHEN role = 'system' THEN 'No choices in response' END AS error FROM v_turns""")
def cnv8(v: Views):
    quoted = F.to_json(F.struct("content")).substr(F.lit(12), F.length(F.to_json(F.struct("content"))) - 12)
    message = F.when(F.col("role") == "user", F.concat(F.lit('{"content":'), quoted, F.lit("}"))).otherwise(F.concat(F.lit('{"content":"","reasoning_content":'), quoted, F.lit("}")))
    full = F.concat(F.lit('{"choices":[{"message":'), message, F.lit('}],"usage":{"prompt_tokens":0,"completion_tokens":1,"total_tokens":'), F.col("pos").cast("string"), F.lit("}}"))
    bodies = v.turns.select("session_id", "pos", F.when(F.col("role") == "system", '{"choices":[]}').otherwise(full).alias("body"))
    return conversations.response_text(bodies).select("session_id", "pos", "content", "total_tokens", "error")


@query("src1_scan_files", f"SELECT replace(file_path, '.md', CASE WHEN lang = 'de' THEN '.MD' ELSE '.md' END) AS file_path, file_size FROM v_docs WHERE starts_with(file_path, 'notes/src1/') OR (regexp_full_match(file_path, '.*/en/[^/]*\\.md') OR starts_with(file_path, 'notes/src5/')) AND NOT suffix(replace(file_path, '.md', CASE WHEN lang = 'de' THEN '.MD' ELSE '.md' END), '9.md')")
def src1(v: Views):
    root = shared_folder(v)
    # one file per document, written by the tasks
    def write(batches):
        for pdf in batches:
            for path, body in zip(pdf["file_path"], pdf["text"]):
                full = os.path.join(root, path)
                os.makedirs(os.path.dirname(full), exist_ok=True)
                with open(full, "w", encoding="utf-8", newline="") as f:
                    f.write(body)
            yield pdf[["doc_id"]]

    named = v.docs.withColumn("file_path", F.when(F.col("lang") == "de", F.replace("file_path", F.lit(".md"), F.lit(".MD"))).otherwise(F.col("file_path")))
    named.select("doc_id", "file_path", "text").mapInPandas(write, "doc_id bigint").count()
    return sources.scan_files(v.spark, root, NOTEBOOKS[0]).select("file_path", "file_size")


@query("src2_read_log", "SELECT event_id AS seq, path, kind FROM v_fs_events")
def src2(v: Views):
    root = shared_folder(v)
    good = F.to_json(F.struct(F.col("event_id").alias("seq"), "path", "kind"))
    # each good line is followed by a blank one and a cut-off copy
    v.fs_events.select(F.concat(good, F.lit("\n\n"), F.expr("left(to_json(struct(event_id AS seq, path, kind)), 20)")).alias("value")).write.mode("overwrite").text(root)
    return sources.read_log(v.spark, root, schemas.table(seq=schemas.LONG, path=schemas.TEXT, kind=schemas.TEXT))


@query("src3_append_log", "SELECT path AS file_path, max(event_id) AS seq FROM v_fs_events GROUP BY path")
def src3(v: Views):
    from lectern.operators.diff import latest

    root = f"{shared_folder(v)}/log"
    rows = v.fs_events.select(F.col("path").alias("file_path"), F.col("event_id").alias("seq"), F.lit(False).alias("tombstone"))
    for kind in ("create", "modify", "delete", "rename"):
        sources.append_log(rows.join(v.fs_events.filter(F.col("kind") == kind).select(F.col("event_id").alias("seq")), "seq", "left_semi"), root)
    log = sources.read_log(v.spark, root, schemas.table(file_path=schemas.TEXT, seq=schemas.LONG, tombstone=schemas.FLAG))
    return latest(log, "file_path").select("file_path", "seq")


@query("src4_docs_round_trip", "SELECT session_id, pos, role, content FROM v_turns")
def src4(v: Views):
    root = f"{shared_folder(v)}/turns"
    sources.write_docs(v.turns, root, "role")
    return v.spark.read.schema("session_id string, pos bigint, content string, created_at bigint, role string").parquet(root).select("session_id", "pos", "role", "content")


@query("src6_export_table", "SELECT kind || '-' || notebook_id || '-' || strftime(make_timestamp(generated_at * 1000), '%Y-%m-%dT%H-%M-%S-') || lpad((generated_at % 1000)::VARCHAR, 3, '0') || 'Z.md' AS filename FROM v_artifacts")
def src6(v: Views):
    root = f"{shared_folder(v)}/export"
    name = generation.export_filename(F.col("kind"), F.col("notebook_id"), F.timestamp_millis("generated_at"))
    sources.export_table(artifacts(v).select("kind", name.alias("filename")), root, ["kind"])
    return v.spark.read.schema("filename string, kind string").json(root).select("filename")


@query("udf1_extractors", """
SELECT 'p' || page_id AS file_path, 'ok' AS outcome, NULL::VARCHAR AS error FROM pages UNION ALL
SELECT 'd' || doc_id, CASE WHEN lang = 'fr' THEN 'error' ELSE 'ok' END, CASE WHEN lang = 'fr' THEN 'no extractor for .fr' END FROM documents""")
def udf1(v: Views):
    pages = v.table("pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("file_path"), F.lit("HTML").alias("ext"), F.encode("html", "UTF-8").alias("content"))
    docs = v.docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file_path"), F.when(F.col("lang") == "fr", "fr").otherwise("md").alias("ext"), F.encode("text", "UTF-8").alias("content"))
    return udfs.extract(pages.unionByName(docs)).select("file_path", "outcome", "error")


@query("udf4_complete", f"SELECT session_id, pos, CASE WHEN len(content) <= 800 THEN {trim_sql('reverse(content)')} END AS answer, CASE WHEN len(content) > 800 THEN 'too long' END AS error FROM v_turns")
def udf4(v: Views):
    def backwards(prompt: str) -> str:
        if len(prompt) > 800:
            raise ValueError("too long")
        return prompt[::-1]

    out = v.turns.select("session_id", "pos", udfs.complete(backwards)(F.col("content")).alias("r"))
    return out.select("session_id", "pos", F.col("r.text").alias("answer"), "r.error")


@query("udf2_embed_queries", "SELECT query_id, 64::BIGINT AS dims FROM v_q")
def udf2(v: Views):
    return udfs.embed_queries(v.q, "multilingual-e5-small", udfs.hashing_embedder()).select("query_id", F.size("qvec").alias("dims"))


@query("udf3_score_pairs", "SELECT a.session_id, a.pos, len(a.question) / (1 + len(a.content)) AS score FROM v_questions a WHERE role = 'assistant'")
def udf3(v: Views):
    def ratio(queries: list[str], texts: list[str]) -> list[float]:
        return [len(q) / (1 + len(t)) for q, t in zip(queries, texts)]

    asked = conversations.question_of(v.turns)
    return asked.select("session_id", "pos", udfs.score_pairs(ratio)(F.col("question"), F.col("content")).alias("score"))
