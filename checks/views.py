"""Inputs of the checks: views over the given tables, once as DataFrames and once as SQL.

Snapshots, labels of state and scopes are read off the tables' own attributes (language, source,
labels), and every view covers its whole table.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern import session
from lectern.functions import scope, text
from lectern.operators import chunking, lexical

WS = text.WS
TOKEN = rf"[{text.WORD}]+|[^{WS}{text.WORD}]"


def q(s: str) -> str:
    return s.replace("'", "''")


def tokens_sql(x: str) -> str:
    return rf"regexp_extract_all(regexp_replace({x}, '(\p{{Han}})', ' \1 ', 'g'), '{q(TOKEN)}')"


def trim_sql(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^[{WS}]+', ''), '[{WS}]+$', '')"


def blank_sql(x: str) -> str:
    return f"(NOT regexp_matches({x}, '[^{WS}]'))"


NOTEBOOKS = (
    scope.Notebook(
        "nb1",
        (
            scope.Source("s1", "notes/src1/"),
            scope.Source("s2", "notes", include_globs=("**/en/*.md", "notes/src5/**"), exclude_globs=("*9.md",)),
            scope.Source("s0", "notes", enabled=False),
        ),
    ),
    scope.Notebook("nb2", (scope.Source("all", "notes"),), ("md", "txt")),
    scope.Notebook("nb3", (scope.Source("flat", "notes/src2/fr", recursive=False), scope.Source("two", "notes/src7", include_globs=("notes/src7/*/1*",)))),
)

_under = "starts_with(file_path, '{}')".format
DEFAULT_EXCLUDED = r"(suffix(file_path, '.tmp') OR file_path = '*.tmp' OR starts_with(file_path, '.') OR regexp_matches(file_path, '(^|/)\.'))"
SCOPE_SQL = {
    ("nb1", "s1", 1): f"{_under('notes/src1/')} AND NOT {DEFAULT_EXCLUDED}",
    ("nb1", "s2", 2): rf"{_under('notes/')} AND (regexp_full_match(file_path, '.*/en/[^/]*\.md') OR regexp_full_match(file_path, 'notes/src5/.*')) AND NOT suffix(file_path, '9.md')",
    ("nb2", "all", 1): f"{_under('notes/')} AND NOT {DEFAULT_EXCLUDED}",
    ("nb3", "flat", 1): f"{_under('notes/src2/fr/')} AND NOT contains(substr(file_path, 15), '/') AND NOT {DEFAULT_EXCLUDED}",
    ("nb3", "two", 2): f"{_under('notes/src7/')} AND regexp_full_match(file_path, 'notes/src7/[^/]*/1[^/]*') AND NOT {DEFAULT_EXCLUDED}",
}


def scoped_sql(table: str) -> str:
    """One row per file and notebook that covers it, with its first source."""
    rows = "\nUNION ALL\n".join(
        f"SELECT *, '{nb}' AS notebook_id, '{src}' AS source_id, {n} AS _ord FROM {table} WHERE {cond}" for (nb, src, n), cond in SCOPE_SQL.items()
    )
    return f"SELECT * EXCLUDE (_ord) FROM ({rows}) QUALIFY row_number() OVER (PARTITION BY notebook_id, file_path ORDER BY _ord) = 1"


SQL_VIEWS: dict[str, str] = {
    "v_docs": """SELECT doc_id, 'notes/' || source || '/' || lang || '/' || doc_id || '.md' AS file_path, sha256(text) AS file_hash,
  doc_id * 1000 AS source_mtime, octet_length(encode(text))::BIGINT AS file_size, text, lang, source,
  quality, toxic FROM documents LEFT JOIN labels USING (doc_id)""",
    "v_paths": r"""SELECT doc_id, CASE lang WHEN 'de' THEN replace(file_path, '.md', '.tmp') WHEN 'fr' THEN replace(file_path, '/fr/', '/.fr/') ELSE file_path END AS file_path,
  file_path AS plain_path, file_size FROM v_docs""",
    "v_scoped": scoped_sql("v_docs"),
    # one row per distinct text, described by its first path
    "v_content": """SELECT file_hash, file_path, file_size, text, lang, source, 1::BIGINT AS chunking_version,
  CASE WHEN lang = 'es' THEN 1 ELSE 2 END::BIGINT AS parser_version,
  CASE WHEN toxic = 1 THEN 'error' WHEN quality = 0 THEN 'skipped' ELSE 'ok' END AS status
  FROM v_docs QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY file_path) = 1""",
    "v_snap_old": """SELECT file_path, file_hash, source_mtime, file_size, CASE WHEN lang = 'es' THEN 1 ELSE 2 END AS parser_version
  FROM v_docs WHERE coalesce(toxic, 0) <> 1""",
    "v_snap_new": """SELECT CASE WHEN source IN ('src3', 'src13') THEN replace(file_path, 'notes/', 'notes/moved/') ELSE file_path END AS file_path,
  CASE WHEN lang = 'de' THEN sha256(text || ' x') ELSE file_hash END AS file_hash,
  CASE WHEN lang IN ('de', 'fr') THEN source_mtime + 1 ELSE source_mtime END AS source_mtime,
  CASE WHEN lang = 'de' THEN file_size + 2 ELSE file_size END AS file_size,
  CASE WHEN lang = 'de' THEN text || ' x' ELSE text END AS text
  FROM v_docs WHERE NOT (coalesce(quality, 1) = 0 AND coalesce(toxic, 0) = 0)""",
    "v_lines": """SELECT file_hash, file_path, lang, source, pos, l[pos + 1] AS line,
  coalesce(sum(len(l[pos + 1]) + 1) OVER (PARTITION BY file_hash ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start
  FROM (SELECT file_hash, file_path, lang, source, l, unnest(range(len(l))) AS pos FROM (SELECT *, string_split(text, chr(10)) AS l FROM v_content))""",
    # chunks that SQL can make too: one per line with text
    "v_chunks": f"""SELECT file_hash || ':' || chunk_index AS chunk_id, * FROM (
  SELECT file_hash, file_path, source || ' > ' || lang AS heading_text, {trim_sql('line')} AS content,
    row_number() OVER (PARTITION BY file_hash ORDER BY pos) - 1 AS chunk_index,
    char_start + len(line) - len(regexp_replace(line, '^[{WS}]+', '')) AS char_start, len({tokens_sql('line')}) AS token_count
  FROM v_lines WHERE NOT {blank_sql('line')})""",
    "v_q": "SELECT item_id AS query_id, text FROM benchmark",
    "v_md": r"""SELECT file_hash, '# ' || source || chr(10) || chr(10) || '## ' || lang || ' ##' || chr(10) || chr(10) ||
  regexp_replace(regexp_replace(regexp_replace(text, '\n([AEIOU][^\n ]*)', chr(10) || chr(10) || '## \1' || chr(10) || chr(10) || '\1', 'g'),
    '\n([T-Z][^\n ]*)', chr(10) || '```' || chr(10) || '# \1' || chr(10) || '```' || chr(10) || '\1', 'g'),
    '\n([B-D][^\n ]*)', chr(10) || chr(10) || '#### \1 #' || chr(10) || '- \1' || chr(10) || '  * \1' || chr(10) || chr(10) || '| \1 | b |' || chr(10) || '|---|:-:|' || chr(10) || '| \1 | c |' || chr(10) || chr(10), 'g') AS text
  FROM v_content""",
    "v_fs_events": """SELECT event_id, ts, user_id, 'notes/src' || user_id || '/en/' || (props::JSON ->> 'k') || '.md' AS path,
  CASE WHEN event_type = 'signup' THEN 'notes/src' || user_id || '/de/' || (props::JSON ->> 'k') || '.md' END AS old_path,
  CASE event_type WHEN 'view' THEN 'create' WHEN 'purchase' THEN 'delete' WHEN 'signup' THEN 'rename' ELSE 'modify' END AS kind FROM events""",
    "v_turns": """SELECT 's' || conv_id AS session_id, turn AS pos, role, text AS content, conv_id * 1000 + turn AS created_at FROM conversations""",
    # vectors of the distinct texts' first document; query vectors of the item's number
    "v_vectors": """SELECT file_hash || ':0' AS chunk_id, file_hash, 'm' || label AS model_id, embedding AS vec
  FROM (SELECT file_hash, min(doc_id) AS vec_id FROM v_docs GROUP BY file_hash) JOIN embeddings USING (vec_id)""",
    "v_qvec": "SELECT item_id AS query_id, embedding AS qvec FROM benchmark JOIN embeddings ON vec_id = item_id",
}


class Views:
    """The same views as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # the tables' times carry no zone

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def docs(self) -> DataFrame:
        path = F.concat(F.lit("notes/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
        return self.table("documents").join(self.table("labels"), "doc_id", "left").select(
            "doc_id", path.alias("file_path"), text.content_hash(F.col("text")).alias("file_hash"), (F.col("doc_id") * 1000).alias("source_mtime"),
            F.octet_length("text").cast("bigint").alias("file_size"), "text", "lang", "source", "quality", "toxic",
        )

    @cached_property
    def paths(self) -> DataFrame:
        shown = F.when(F.col("lang") == "de", F.replace("file_path", F.lit(".md"), F.lit(".tmp"))).when(
            F.col("lang") == "fr", F.replace("file_path", F.lit("/fr/"), F.lit("/.fr/"))
        ).otherwise(F.col("file_path"))
        return self.docs.select("doc_id", shown.alias("file_path"), F.col("file_path").alias("plain_path"), "file_size")

    @cached_property
    def scoped(self) -> DataFrame:
        return scope.in_notebooks(self.docs, NOTEBOOKS)

    @cached_property
    def content(self) -> DataFrame:
        row = F.min_by(F.struct("file_path", "file_size", "text", "lang", "source", "quality", "toxic"), "file_path")
        return self.docs.groupBy("file_hash").agg(row.alias("r")).select(
            "file_hash", "r.file_path", "r.file_size", "r.text", "r.lang", "r.source", F.lit(1).cast("bigint").alias("chunking_version"),
            F.when(F.col("r.lang") == "es", 1).otherwise(2).cast("bigint").alias("parser_version"),
            F.when(F.col("r.toxic") == 1, "error").when(F.col("r.quality") == 0, "skipped").otherwise("ok").alias("status"),
        )

    @cached_property
    def snap_old(self) -> DataFrame:
        return self.docs.filter(F.coalesce("toxic", F.lit(0)) != 1).select(
            "file_path", "file_hash", "source_mtime", "file_size", F.when(F.col("lang") == "es", 1).otherwise(2).alias("parser_version")
        )

    @cached_property
    def snap_new(self) -> DataFrame:
        de, touched = F.col("lang") == "de", F.col("lang").isin("de", "fr")
        changed = F.when(de, F.concat("text", F.lit(" x"))).otherwise(F.col("text"))
        kept = self.docs.filter(~((F.coalesce("quality", F.lit(1)) == 0) & (F.coalesce("toxic", F.lit(0)) == 0)))
        moved = F.when(F.col("source").isin("src3", "src13"), F.replace("file_path", F.lit("notes/"), F.lit("notes/moved/"))).otherwise(F.col("file_path"))
        return kept.select(
            moved.alias("file_path"), text.content_hash(changed).alias("file_hash"),
            F.when(touched, F.col("source_mtime") + 1).otherwise(F.col("source_mtime")).alias("source_mtime"),
            F.when(de, F.col("file_size") + 2).otherwise(F.col("file_size")).alias("file_size"), changed.alias("text"),
        )

    @cached_property
    def chunks(self) -> DataFrame:
        about = self.content.select("file_hash", "file_path", F.concat_ws(" > ", "source", "lang").alias("heading_text"))
        lines = chunking.scan_lines(self.content.select("file_hash", "text")).filter(~text.is_blank(F.col("line")))
        index = F.row_number().over(Window.partitionBy("file_hash").orderBy("pos")) - 1
        lead = F.length(F.regexp_extract("line", rf"\A[{text.WS}]*", 0))
        rows = lines.select(
            "file_hash", index.alias("chunk_index"), text.trim_ws(F.col("line")).alias("content"), (F.col("char_start") + lead).alias("char_start"),
            text.token_count(F.col("line")).alias("token_count"),
        )
        return session.kept(rows.join(about, "file_hash").withColumn("chunk_id", F.concat_ws(":", "file_hash", F.col("chunk_index").cast("string"))))

    @cached_property
    def q(self) -> DataFrame:
        return self.table("benchmark").select(F.col("item_id").alias("query_id"), "text")

    @cached_property
    def md(self) -> DataFrame:
        t = F.regexp_replace("text", r"\n([AEIOU][^\n ]*)", "\n\n## $1\n\n$1")
        t = F.regexp_replace(t, r"\n([T-Z][^\n ]*)", "\n```\n# $1\n```\n$1")
        t = F.regexp_replace(t, r"\n([B-D][^\n ]*)", "\n\n#### $1 #\n- $1\n  * $1\n\n| $1 | b |\n|---|:-:|\n| $1 | c |\n\n")
        head = F.concat(F.lit("# "), "source", F.lit("\n\n## "), "lang", F.lit(" ##\n\n"))
        return self.content.select("file_hash", F.concat(head, t).alias("text"))

    @cached_property
    def fs_events(self) -> DataFrame:
        k = F.get_json_object("props", "$.k")

        def path(lang: str):
            return F.concat(F.lit("notes/src"), F.col("user_id").cast("string"), F.lit(f"/{lang}/"), k, F.lit(".md"))

        t = F.col("event_type")
        return self.table("events").select(
            "event_id", "ts", "user_id", path("en").alias("path"), F.when(t == "signup", path("de")).alias("old_path"),
            F.when(t == "view", "create").when(t == "purchase", "delete").when(t == "signup", "rename").otherwise("modify").alias("kind"),
        )

    @cached_property
    def turns(self) -> DataFrame:
        return self.table("conversations").select(
            F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"), F.col("turn").alias("pos"), "role",
            F.col("text").alias("content"), (F.col("conv_id") * 1000 + F.col("turn")).alias("created_at"),
        )

    @cached_property
    def vectors(self) -> DataFrame:
        first = self.docs.groupBy("file_hash").agg(F.min("doc_id").alias("vec_id"))
        return first.join(self.table("embeddings"), "vec_id").select(
            F.concat("file_hash", F.lit(":0")).alias("chunk_id"), "file_hash", F.concat(F.lit("m"), F.col("label").cast("string")).alias("model_id"),
            F.col("embedding").alias("vec"),
        )

    @cached_property
    def qvec(self) -> DataFrame:
        return self.table("benchmark").join(self.table("embeddings"), F.col("item_id") == F.col("vec_id")).select(
            F.col("item_id").alias("query_id"), F.col("embedding").alias("qvec")
        )

    @cached_property
    def postings(self) -> DataFrame:
        return lexical.postings_table(self.chunks)

    @cached_property
    def corpus(self) -> DataFrame:
        return lexical.corpus_stats(lexical.doc_stats(self.chunks))


def shared_folder(v: Views) -> str:
    """A new folder below the cluster's shared one; a temporary one where it names none."""
    base = session.shared_folder(v.spark)
    return f"{base.rstrip('/')}/lectern-{uuid.uuid4().hex}" if base else tempfile.mkdtemp(prefix="lectern-")
