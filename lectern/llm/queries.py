"""The registered query of each operator, and its SQL where DuckDB can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, dedup, fim, fingerprint, html, language, mixing, near, negatives, packing, repeats, token_counts, toxicity
from .base import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), held_out(F.col("doc_id"))
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").where(~fold))
    return toxicity.score(docs, model).select("doc_id", fold.alias("held_out"), "score", "predicted")


@query("op2_html")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


@query("op3_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op4_mixing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(table(spark, sf_dir, "documents")).taken()


@query("op5_suffix_repeats")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""


@query("op6_exact_dedup", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower half of the ids is the snapshot, the upper half the incoming batch."""
    docs = table(spark, sf_dir, "documents")
    return dedup.exact_duplicates(docs, dedup.older_half(docs))


OP7_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, 'user'), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY place) OVER
    (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING)) AS h, max(place) OVER (PARTITION BY conv_id) AS n_turns FROM t),
ends AS (SELECT h, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE place = n_turns GROUP BY h),
best AS (SELECT conv_id, n_copies FROM ends WHERE h NOT IN (SELECT h FROM p WHERE place < n_turns))
SELECT conv_id, place, n_turns, n_copies, role, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered
FROM p JOIN best USING (conv_id)
"""


@query("op7_chat_format", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


@query("op8_fingerprint")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compared(table(spark, sf_dir, "documents"))


@query("op9_near_duplicates")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_language")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), held_out(F.col("doc_id"))
    return language.identify(docs, language.learn(docs.where(~fold))).select("doc_id", fold.alias("held_out"), "lang_pred", "score")


OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS c2,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
    WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
v AS (SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b FROM u),
w AS (SELECT *, substr(text, 1, a) AS p, substr(text, a + 1, b - a) AS m, substr(text, b + 1) AS s FROM v)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM w
"""


@query("op11_fill_in_middle", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    restored = fim.restored(F.col("output"), F.col("form"))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"),
    )


@query("op12_token_counts")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 1024)


OP13_SQL = r"""
WITH t AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
e AS (SELECT id, label, list_transform(x, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS DOUBLE)) AS v FROM t),
p AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 100 = 0),
pos AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM p WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, p.id AS negative_id, positive_score, p.score AS negative_score
FROM pos JOIN p USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY p.score DESC, p.id) QUALIFY row_number() OVER w <= 5
"""


@query("op13_hard_negatives", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.usable(table(spark, sf_dir, "embeddings"), label=label)
    return negatives.mine(rows, rows.where("id % 100 = 0"))
