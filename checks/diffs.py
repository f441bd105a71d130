"""CDC-*, AGG-*, STR-* and log checks."""

from __future__ import annotations

from pyspark.sql import functions as F


from lectern.operators import diff, stats

from lectern.streaming import changes

from .registry import query
from .views import NOTEBOOKS, SQL_VIEWS, Views, scoped_sql

SQL_VIEWS["v_log"] = "SELECT path AS file_path, sha256(path || kind) AS file_hash, event_id AS seq, kind = 'delete' AS tombstone FROM v_fs_events"
SQL_VIEWS["v_alive"] = "SELECT file_path, arg_max(file_hash, seq) AS file_hash, max(seq) AS seq FROM v_log GROUP BY file_path HAVING NOT arg_max(tombstone, seq)"
SQL_VIEWS["v_diff"] = """WITH f AS (SELECT coalesce(o.file_path, n.file_path) AS file_path, o.file_hash AS old_hash, n.file_hash AS new_hash,
    o.source_mtime AS old_mtime, o.file_size AS old_size, o.parser_version, n.source_mtime, n.file_size, o.file_path IS NOT NULL AS in_old, n.file_path IS NOT NULL AS in_new
  FROM v_snap_old o FULL JOIN v_snap_new n ON o.file_path = n.file_path),
kept AS (SELECT CASE WHEN source_mtime = old_mtime AND file_size = old_size THEN CASE WHEN parser_version = 2 THEN 'UNCHANGED' ELSE 'STALE_PARSER' END
    WHEN new_hash = old_hash THEN 'MTIME_ONLY' ELSE 'CONTENT_CHANGED' END AS classification, * FROM f WHERE in_old AND in_new),
gone AS (SELECT file_path, old_hash AS h, row_number() OVER (PARTITION BY old_hash ORDER BY file_path) AS rn FROM f WHERE NOT in_new),
come AS (SELECT file_path, new_hash AS h, source_mtime, file_size, row_number() OVER (PARTITION BY new_hash ORDER BY file_path) AS rn FROM f WHERE NOT in_old)
SELECT classification, file_path, NULL::VARCHAR AS old_path, old_hash, CASE WHEN classification = 'CONTENT_CHANGED' THEN new_hash END AS new_hash, source_mtime, file_size FROM kept
UNION ALL SELECT CASE WHEN c.h IS NULL THEN 'DELETED' WHEN g.h IS NULL THEN 'NEW_PATH' ELSE 'RENAMED' END, coalesce(c.file_path, g.file_path),
  CASE WHEN c.h IS NOT NULL THEN g.file_path END, g.h, c.h, c.source_mtime, c.file_size FROM gone g FULL JOIN come c ON g.h = c.h AND g.rn = c.rn"""


def log(v: Views):
    return v.fs_events.select(
        F.col("path").alias("file_path"), F.sha2(F.concat("path", "kind"), 256).alias("file_hash"), F.col("event_id").alias("seq"), (F.col("kind") == "delete").alias("tombstone")
    )


def alive(v: Views):
    return diff.latest(log(v), "file_path")


def old_state(v: Views):
    return v.snap_old.withColumn("is_current", F.col("parser_version") == 2)


def snapshot_diff(v: Views):
    return diff.diff_snapshots(old_state(v), v.snap_new)


def old_content(v: Views):
    """Content rows behind the old snapshot, all processed at the current version but the Spanish ones."""
    return v.snap_old.groupBy("file_hash").agg(
        F.min("file_size").alias("file_size"), F.min("parser_version").cast("bigint").alias("parser_version"), F.lit(1).cast("bigint").alias("chunking_version"),
        F.lit("ok").alias("status"), F.lit(0).cast("bigint").alias("seq"), F.lit(0).cast("bigint").alias("indexed_at"),
    )


def old_paths(v: Views):
    return v.snap_old.select(
        "file_path", "file_hash", "source_mtime", F.lit(0).cast("bigint").alias("observed_at"), F.lit(0).cast("bigint").alias("seq"), F.lit(False).alias("tombstone")
    )


@query("cdc1_latest", "SELECT * FROM v_alive")
def cdc1(v: Views):
    return alive(v).select("file_path", "file_hash", "seq")


@query("cdc2_paths_by_hash", "SELECT file_hash, file_path, min(file_path) OVER h AS first_path, count(*) OVER h AS n_paths FROM v_docs WINDOW h AS (PARTITION BY file_hash)")
def cdc2(v: Views):
    return diff.paths_by_hash(v.docs).join(diff.copies(v.docs), "file_hash")


@query("cdc3_diff_snapshots", "SELECT * FROM v_diff")
def cdc3(v: Views):
    return snapshot_diff(v)


@query("cdc4_pair_renames", """
WITH g AS (SELECT file_path, file_hash, row_number() OVER (PARTITION BY file_hash ORDER BY file_path) AS rn FROM v_docs WHERE lang IN ('en', 'de')),
c AS (SELECT 'new/' || file_path AS file_path, file_hash, row_number() OVER (PARTITION BY file_hash ORDER BY file_path) AS rn FROM v_docs WHERE lang IN ('en', 'fr'))
SELECT coalesce(g.file_hash, c.file_hash) AS file_hash, g.file_path AS old_path, c.file_path AS new_path FROM g FULL JOIN c ON g.file_hash = c.file_hash AND g.rn = c.rn""")
def cdc4(v: Views):
    gone = v.docs.filter(F.col("lang").isin("en", "de"))
    arrived = v.docs.filter(F.col("lang").isin("en", "fr")).withColumn("file_path", F.concat(F.lit("new/"), "file_path"))
    return diff.pair_renames(gone, arrived).select("file_hash", "old_path", "new_path")


@query("cdc5_stale_versions", """
SELECT file_hash, lang, NOT coalesce(status IN ('ok', 'error') AND parser_version <> CASE lang WHEN 'en' THEN 2 WHEN 'es' THEN 2 WHEN 'fr' THEN 3 END, false) AS is_current FROM v_content""")
def cdc5(v: Views):
    # one expected version per language; German has no extractor
    expected = v.docs.select(F.col("lang").alias("ext")).distinct().filter(F.col("ext") != "de").withColumn("expected_version", F.when(F.col("ext") == "fr", 3).otherwise(2))
    return diff.stale_versions(v.content, expected, "lang").select("file_hash", "lang", "is_current")


@query("cdc6_new_content", """
SELECT file_hash, min(file_path) AS file_path FROM v_snap_new WHERE file_hash NOT IN (SELECT file_hash FROM v_content WHERE status = 'ok') GROUP BY file_hash""")
def cdc6(v: Views):
    return diff.new_content(v.snap_new, v.content).select("file_hash", "file_path")


def applied(v: Views):
    from lectern.plans.index import products_of
    from lectern.session import cut_lineage

    changes_ = cut_lineage(snapshot_diff(v))
    products = products_of(v.snap_new, changes_, old_content(v), 2)
    return diff.apply_changes(old_paths(v), old_content(v), changes_, products, seq=1, now=1)


@query("cdc7_apply_changes", "SELECT file_path, file_hash, source_mtime FROM v_snap_new WHERE trim(text) <> ''")
def cdc7(v: Views):
    after = diff.latest(old_paths(v).unionByName(applied(v)["paths"]), "file_path")
    return after.select("file_path", "file_hash", "source_mtime")


@query("cdc7_content_after_run", """
WITH o AS (SELECT file_hash, min(parser_version) AS v FROM v_snap_old GROUP BY file_hash)
SELECT DISTINCT n.file_hash, CASE WHEN o.v IS NULL OR n.file_hash IN (SELECT old_hash FROM v_diff WHERE classification = 'STALE_PARSER') THEN 2 ELSE o.v END::BIGINT AS parser_version
FROM v_snap_new n LEFT JOIN o USING (file_hash)""")
def cdc7b(v: Views):
    after = diff.latest(old_content(v).withColumn("tombstone", F.lit(False)).unionByName(applied(v)["content"].drop("error_message")), "file_hash")
    return after.select("file_hash", "parser_version")


@query("cdc8_product_outcome", """
WITH r AS (SELECT d.file_path, CASE WHEN toxic = 1 THEN 'error' WHEN quality = 0 THEN 'skipped' WHEN lang = 'fr' THEN 'transient' WHEN lang = 'de' THEN 'rejected' ELSE 'ok' END AS route FROM v_docs d)
SELECT file_path, route, route IN ('ok', 'skipped', 'error') AS writes_content, route IN ('ok', 'skipped') AS writes_path,
  CASE route WHEN 'transient' THEN 'transient' WHEN 'error' THEN 'persistent' WHEN 'rejected' THEN 'race' END AS error_class FROM r""")
def cdc8(v: Views):
    outcome = F.when(F.col("toxic") == 1, "error").when(F.col("quality") == 0, "skipped").when(F.col("lang") == "fr", "transient").otherwise("ok")
    produced = F.when(F.col("lang") == "de", F.sha2(F.concat("text", F.lit(" x")), 256)).otherwise(F.col("file_hash"))
    products = v.docs.select("file_path", F.col("file_hash").alias("expected_hash"), produced.alias("file_hash"), outcome.alias("outcome"))
    return diff.product_outcome(products).select("file_path", "route", "writes_content", "writes_path", "error_class")


@query("cdc9_error_digest", """
SELECT 'n' || user_id AS notebook_id, CASE WHEN value < 20 THEN 'transient' ELSE 'persistent' END AS error_class, event_id, row_number() OVER (
  PARTITION BY user_id, value < 20 ORDER BY event_id DESC) AS rank FROM events WHERE event_type = 'error' QUALIFY rank <= 20""")
def cdc9(v: Views):
    errors = v.table("events").filter(F.col("event_type") == "error").select(
        F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("notebook_id"), F.when(F.col("value") < 20, "transient").otherwise("persistent").alias("error_class"),
        F.col("event_id").alias("ts"), F.lit("").alias("file_path"), "event_id",
    )
    return diff.error_digest(errors).select("notebook_id", "error_class", "event_id", "rank")


@query("cdc10_error_gate", """
WITH b AS (SELECT (event_id // 5000)::BIGINT AS run_id, ((event_id - event_id // 5000 * 5000) // 50)::BIGINT AS batch_id, count(*) AS n, count(*) FILTER (event_type IN ('error', 'view', 'click') AND value > 15) AS e FROM events GROUP BY ALL)
SELECT run_id, batch_id, done, errors, done >= 5 AND errors / done > 0.5 AS abort FROM (
  SELECT run_id, batch_id, (sum(n) OVER w)::BIGINT AS done, (sum(e) OVER w)::BIGINT AS errors FROM b WINDOW w AS (PARTITION BY run_id ORDER BY batch_id))""")
def cdc10(v: Views):
    run = F.floor(F.col("event_id") / 5000)
    outcomes = v.table("events").select(
        run.alias("run_id"), (F.col("event_id") - run * 5000).alias("pos"), (F.col("event_type").isin("error", "view", "click") & (F.col("value") > 15)).alias("is_error")
    )
    return diff.error_gate(outcomes)


@query("cdc11_invalidate", """
SELECT DISTINCT file_hash, true AS tombstone FROM v_content WHERE file_hash IN (SELECT file_hash FROM v_docs WHERE toxic = 1)""")
def cdc11(v: Views):
    return diff.invalidate(v.content, v.docs, v.docs.filter(F.col("toxic") == 1), seq=9).select("file_hash", "tombstone")


@query("cdc11_dirty_notebooks", """
SELECT 'nb1' AS notebook_id WHERE EXISTS (FROM v_docs WHERE lang = 'fr') UNION ALL SELECT 'nb2' WHERE EXISTS (FROM v_docs WHERE lang = 'fr')
UNION ALL SELECT 'nb3' WHERE EXISTS (FROM v_docs WHERE lang = 'fr' AND (starts_with(file_path, 'notes/src2/fr/') OR starts_with(file_path, 'notes/src7/')))""")
def cdc11b(v: Views):
    return diff.dirty_notebooks(v.docs.filter(F.col("lang") == "fr"), NOTEBOOKS)


@query("cdc12_compact", "SELECT file_path, file_hash FROM v_alive")
def cdc12(v: Views):
    from lectern.sources import compact

    return compact(compact(log(v), "file_path"), "file_path").select("file_path", "file_hash")


@query("cdc12_should_compact", """
SELECT user_id, bytes, lines, last, bytes > 10485760 OR CASE WHEN last IS NULL THEN lines > 1000 ELSE lines > last * 2 END AS compact FROM (
  SELECT user_id, count(*) * 100000 AS bytes, count(*) * 20 AS lines, CASE WHEN user_id < 100 THEN count(*) FILTER (event_type = 'error') * 40 END AS last FROM events GROUP BY user_id)""")
def cdc12b(v: Views):
    n, errors = F.count(F.lit(1)), F.count_if(F.col("event_type") == "error")
    sizes = v.table("events").groupBy("user_id").agg(
        (n * 100000).alias("bytes"), (n * 20).alias("lines"), F.when(F.col("user_id") < 100, errors * 40).alias("lines_at_last")
    )
    return diff.should_compact(sizes).withColumnRenamed("lines_at_last", "last")


@query("cdc13_orphans", "SELECT file_hash FROM v_content WHERE file_hash NOT IN (SELECT file_hash FROM v_snap_new)")
def cdc13(v: Views):
    return diff.orphans(v.content, v.snap_new).select("file_hash")


@query("cdc14_version_stale", f"""
WITH n AS (SELECT 'nb' || label AS notebook_id, CASE WHEN avg(vec_id) > 250 THEN 'dirty' ELSE 'idle' END AS status, CASE WHEN label <> 2 THEN (label // 3)::BIGINT END AS last_index_version FROM embeddings GROUP BY label),
s AS (SELECT DISTINCT notebook_id, true AS found FROM ({scoped_sql('v_docs')}))
SELECT notebook_id, status, last_index_version, stale AS version_stale, status = 'dirty' OR stale AS needs_reindex FROM (
  SELECT n.*, coalesce(last_index_version < 1, true) AND coalesce(found, false) AS stale FROM n LEFT JOIN s USING (notebook_id))""")
def cdc14(v: Views):
    nbs = v.table("embeddings").groupBy("label").agg(F.avg("vec_id").alias("a")).select(
        F.concat(F.lit("nb"), F.col("label").cast("string")).alias("notebook_id"), F.when(F.col("a") > 250, "dirty").otherwise("idle").alias("status"),
        F.when(F.col("label") != 2, F.floor(F.col("label") / 3)).alias("last_index_version"),
    )
    return diff.version_stale(nbs, v.scoped)


@query("agg1_scope_stats", """
SELECT notebook_id, count(*) AS file_count, (SELECT count(*) FROM v_chunks c WHERE c.file_hash IN (SELECT file_hash FROM v_scoped i WHERE i.notebook_id = s.notebook_id)) AS chunk_count
FROM v_scoped s GROUP BY notebook_id""")
def agg1(v: Views):
    return stats.scope_stats(v.scoped, v.chunks)


@query("agg2_run_report", "SELECT classification, count(*) AS n_files FROM v_diff GROUP BY classification")
def agg2(v: Views):
    return stats.run_report(snapshot_diff(v))


@query("agg3_notebook_status", """
WITH r AS (SELECT user_id, max(event_id) AS seq, arg_max(event_type, event_id) AS t FROM events WHERE event_type <> 'click' GROUP BY user_id),
c AS (SELECT user_id, max(event_id) AS ts FROM events WHERE event_type = 'click' GROUP BY user_id)
SELECT 'n' || u.user_id AS notebook_id, CASE WHEN t = 'signup' THEN 'indexing' WHEN t = 'error' THEN 'error' WHEN c.ts > coalesce(r.seq, -1) THEN 'dirty' ELSE 'idle' END AS status
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN r USING (user_id) LEFT JOIN c USING (user_id)""")
def agg3(v: Views):
    e = v.table("events").withColumn("notebook_id", F.concat(F.lit("n"), F.col("user_id").cast("string")))
    t = F.col("event_type")
    runs = e.filter(t != "click").select(
        "notebook_id", F.col("event_id").alias("seq"), F.when(t == "signup", "running").otherwise("done").alias("state"), F.col("event_id").alias("finished_at"), F.when(t == "error", t).alias("error")
    )
    clicks = e.filter(t == "click").select("notebook_id", F.col("event_id").alias("ts"))
    return stats.notebook_status(e.select("notebook_id").distinct(), runs, clicks)


@query("str1_debounce", """
WITH s AS (SELECT user_id, epoch_us(ts) // 1000 AS ts_ms, event_id, path FROM v_fs_events),
m AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER w < 7200000 THEN 0 ELSE 1 END AS starts FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts_ms, event_id)),
f AS (SELECT *, (sum(starts) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id))::BIGINT AS firing FROM m)
SELECT user_id, firing, min(ts_ms) AS started, max(ts_ms) AS ended, count(*) AS n_events, count(DISTINCT path) AS n_paths FROM f GROUP BY user_id, firing""")
def str1(v: Views):
    e = v.fs_events.select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), "event_id", "path")
    return changes.firings(changes.debounce(e, "user_id", 7_200_000), "user_id")


@query("str2_explode_renames", "SELECT event_id, kind, path FROM v_fs_events UNION ALL SELECT event_id, kind, old_path FROM v_fs_events WHERE old_path IS NOT NULL")
def str2(v: Views):
    return changes.explode_renames(v.fs_events).select("event_id", "kind", "path")


SQL_VIEWS["v_touched"] = "SELECT event_id, ts, path AS file_path FROM v_fs_events UNION ALL SELECT event_id, ts, old_path FROM v_fs_events WHERE old_path IS NOT NULL"


@query("str3_affected_notebooks", f"SELECT notebook_id, count(*) AS n_changes, count(DISTINCT file_path) AS n_paths FROM ({scoped_sql('v_touched').replace('PARTITION BY notebook_id, file_path', 'PARTITION BY notebook_id, event_id, file_path')}) GROUP BY notebook_id")
def str3(v: Views):
    hit = changes.affected_notebooks(v.fs_events, NOTEBOOKS)
    return hit.groupBy("notebook_id").agg(F.count(F.lit(1)).alias("n_changes"), F.countDistinct("path").alias("n_paths"))
