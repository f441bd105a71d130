"""Snapshot diff and change application: set-based deltas of append-only ``paths`` and ``content`` logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scope
from ..session import cut_lineage
from .scans import HOT_ROWS, broadcast_small, prefix_scan, top_k

CHUNKING_VERSION = 1
# Fixed values of change application: newest errors kept, and the gate on the error rate.
ERROR_KEEP = 20
GATE_RATE, GATE_MIN, GATE_BATCH = 0.5, 5, 50
COMPACT_BYTES, COMPACT_LINES, COMPACT_GROWTH = 10 * 1024 * 1024, 1000, 2


def latest(log: DataFrame, key: str | Sequence[str], seq: str = "seq") -> DataFrame:
    """CDC-1: last write per key; a tombstone hides the key until a later write revives it.

    ``max_by`` combines map-side, so a key with very many writes costs one row per task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    row = F.max_by(F.struct(*log.columns), F.col(seq)).alias("_row")
    return log.groupBy(*keys).agg(row).select("_row.*").filter(~F.coalesce("tombstone", F.lit(False)))


def paths_by_hash(paths: DataFrame) -> DataFrame:
    """CDC-2: the reverse index as rows (file_hash, file_path): a hash may have any number of copies."""
    return paths.select("file_hash", "file_path").distinct()


def copies(paths: DataFrame) -> DataFrame:
    """CDC-2, summarised: smallest path and number of paths per hash."""
    return paths_by_hash(paths).groupBy("file_hash").agg(
        F.min("file_path").alias("first_path"), F.count(F.lit(1)).alias("n_paths")
    )


def pair_renames(gone: DataFrame, arrived: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """CDC-4: equal hashes pair up in path order on both sides; ``old_path``/``new_path`` null where none is left.

    Ranking both sides within the hash gives the greedy dictionary-order pairs. Ranks are taken
    bucket-wise, because one text may have copies without end; (hash, rank) then has two rows at most.
    """
    cols = ["file_path", "file_hash", "source_mtime", "file_size"]
    sides = gone.select(*cols, F.lit("old").alias("side")).unionByName(arrived.select(*cols, F.lit("new").alias("side")))
    ranked = prefix_scan(sides, ["file_hash", "side"], ["file_path"], rank="_rn", hot_rows=hot_rows)

    def of(side: str, col: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(col)))

    return (
        ranked.groupBy("file_hash", "_rn")
        .agg(
            of("old", "file_path").alias("old_path"),
            of("new", "file_path").alias("new_path"),
            of("new", "source_mtime").alias("source_mtime"),
            of("new", "file_size").alias("file_size"),
        )
        .drop("_rn")
    )


def diff_snapshots(old: DataFrame, new: DataFrame, in_scope: Column | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """CDC-3: one row per change.

    old  alive paths (file_path, file_hash, source_mtime, file_size nullable, is_current nullable)
    new  scanned files (file_path, file_hash, source_mtime, file_size)
    """
    if in_scope is not None:
        old = old.filter(in_scope)
    o = old.select(
        "file_path",
        F.col("file_hash").alias("old_hash"),
        F.col("source_mtime").alias("old_mtime"),
        F.col("file_size").alias("old_size"),
        F.coalesce(F.col("is_current"), F.lit(True)).alias("is_current") if "is_current" in old.columns else F.lit(True).alias("is_current"),
        F.lit(True).alias("in_old"),
    )
    n = new.select("file_path", F.col("file_hash").alias("new_hash"), "source_mtime", "file_size", F.lit(True).alias("in_new"))
    both = o.join(n, "file_path", "full")

    same_stat = (F.col("source_mtime") == F.col("old_mtime")) & F.coalesce(F.col("old_size") == F.col("file_size"), F.lit(True))
    kept = both.filter(F.col("in_old") & F.col("in_new")).select(
        F.when(same_stat & F.col("is_current"), "UNCHANGED")
        .when(same_stat, "STALE_PARSER")
        .when(F.col("new_hash") == F.col("old_hash"), "MTIME_ONLY")
        .otherwise("CONTENT_CHANGED")
        .alias("classification"),
        "file_path",
        F.lit(None).cast("string").alias("old_path"),
        "old_hash",
        F.when(~same_stat & (F.col("new_hash") != F.col("old_hash")), F.col("new_hash")).alias("new_hash"),
        "source_mtime",
        "file_size",
    )
    # paths on one side only: few after the first run, and looked at twice more
    loose = cut_lineage(both.filter(F.col("in_old").isNull() | F.col("in_new").isNull()))
    gone = loose.filter(F.col("in_new").isNull()).select(
        "file_path", F.col("old_hash").alias("file_hash"), F.col("old_mtime").alias("source_mtime"), F.col("old_size").alias("file_size")
    )
    arrived = loose.filter(F.col("in_old").isNull()).select("file_path", F.col("new_hash").alias("file_hash"), "source_mtime", "file_size")
    moved = pair_renames(gone, arrived, hot_rows).select(
        F.when(F.col("new_path").isNull(), "DELETED")
        .when(F.col("old_path").isNull(), "NEW_PATH")
        .otherwise("RENAMED")
        .alias("classification"),
        F.coalesce("new_path", "old_path").alias("file_path"),
        F.when(F.col("new_path").isNotNull(), F.col("old_path")).alias("old_path"),
        F.when(F.col("old_path").isNotNull(), F.col("file_hash")).alias("old_hash"),
        F.when(F.col("new_path").isNotNull(), F.col("file_hash")).alias("new_hash"),
        "source_mtime",
        "file_size",
    )
    return kept.unionByName(moved)


def stale_versions(content: DataFrame, expected: DataFrame, ext: str = "ext") -> DataFrame:
    """CDC-5: adds ``is_current``; only ok/error rows of a known extension can be out of date.

    ``expected`` (ext, expected_version) has one row per registered extractor and option set.
    """
    known = expected.select(F.col("ext").alias(ext), "expected_version")
    stale = F.col("status").isin("ok", "error") & (F.col("parser_version") != F.col("expected_version"))
    return (
        content.join(broadcast_small(known), ext, "left")
        .withColumn("is_current", ~F.coalesce(stale, F.lit(False)))
        .drop("expected_version")
    )


def new_content(files: DataFrame, content: DataFrame, chunking_version: int = CHUNKING_VERSION) -> DataFrame:
    """CDC-6: one file (the smallest path) per hash that is not yet processed at the current version."""
    done = content.filter((F.col("status") == "ok") & (F.col("chunking_version") == chunking_version)).select("file_hash")
    todo = files.groupBy("file_hash").agg(F.min("file_path").alias("file_path"), F.min_by("file_size", "file_path").alias("file_size"))
    return todo.join(done, "file_hash", "left_anti")


def product_outcome(products: DataFrame) -> DataFrame:
    """CDC-8: what each processed file may write, given (file_path, expected_hash, file_hash, outcome, ...).

    transient   nothing, listed as a transient error
    error       content row, no path, listed as a persistent error
    skipped     content row and path
    ok          content row and path; a hash that moved meanwhile is rejected
    """
    raced = (F.col("outcome") == "ok") & (F.col("file_hash") != F.col("expected_hash"))
    route = F.when(raced, "rejected").otherwise(F.col("outcome"))
    return products.withColumn("route", route).withColumns(
        {
            "writes_content": F.col("route").isin("ok", "skipped", "error"),
            "writes_path": F.col("route").isin("ok", "skipped"),
            "error_class": F.when(F.col("route") == "transient", "transient")
            .when(F.col("route") == "error", "persistent")
            .when(F.col("route") == "rejected", "race"),
        }
    )


def apply_changes(
    paths: DataFrame,
    content: DataFrame,
    diff: DataFrame,
    products: DataFrame,
    *,
    seq: int,
    now: int,
    chunking_version: int = CHUNKING_VERSION,
) -> dict[str, DataFrame]:
    """CDC-7: the rows one indexing run appends.

    paths, content  current alive state (``latest`` of both logs)
    products        (file_hash expected by the diff as ``expected_hash``, file_hash, outcome, parser_version,
                    error_message), one row per new hash, see ``new_content``

    Returns ``paths`` and ``content`` deltas plus ``errors``. Content left without any path is
    tombstoned; what an index must drop follows from that state by ``left_anti``.
    """
    routed = product_outcome(products)
    usable = (
        content.filter((F.col("status") == "ok") & (F.col("chunking_version") == chunking_version))
        .select("file_hash")
        .unionByName(routed.filter("writes_path").select(F.col("expected_hash").alias("file_hash")))
        .distinct()
    )

    def path_rows(df: DataFrame, path: str, hash_: str, mtime: Column, tombstone: bool) -> DataFrame:
        return df.select(
            F.col(path).alias("file_path"),
            F.col(hash_).alias("file_hash"),
            mtime.cast("bigint").alias("source_mtime"),
            F.lit(now).cast("bigint").alias("observed_at"),
            F.lit(seq).cast("bigint").alias("seq"),
            F.lit(tombstone).alias("tombstone"),
        )

    kind = F.col("classification")
    mtime = F.col("source_mtime")
    fresh = diff.filter(kind.isin("NEW_PATH", "CONTENT_CHANGED"))
    accepted = fresh.join(usable.withColumnRenamed("file_hash", "new_hash"), "new_hash", "left_semi")
    new_paths = (
        path_rows(diff.filter(kind == "MTIME_ONLY"), "file_path", "old_hash", mtime, False)
        .unionByName(path_rows(diff.filter(kind == "RENAMED"), "old_path", "old_hash", F.lit(0), True))
        .unionByName(path_rows(diff.filter(kind == "RENAMED"), "file_path", "new_hash", mtime, False))
        .unionByName(path_rows(diff.filter(kind == "DELETED"), "file_path", "old_hash", F.lit(0), True))
        .unionByName(path_rows(accepted, "file_path", "new_hash", mtime, False))
    )

    alive = latest(paths.select(new_paths.columns).unionByName(new_paths), "file_path")
    touched = diff.filter(kind.isin("DELETED", "CONTENT_CHANGED")).select(F.col("old_hash").alias("file_hash")).distinct()
    dropped = orphans(content.join(touched, "file_hash", "left_semi"), alive)
    stamp = {"seq": F.lit(seq).cast("bigint"), "indexed_at": F.lit(now).cast("bigint")}
    gone_rows = dropped.withColumns({**stamp, "tombstone": F.lit(True)})

    # a parser's new version rewrites the row: what was made from the content by other means stays with it
    carried = [c for c in ("summary", "summary_model_id") if c in content.columns]
    kept = content.select(F.col("file_hash").alias("expected_hash"), *carried)
    written = routed.filter("writes_content").join(kept, "expected_hash", "left").select(
        F.col("expected_hash").alias("file_hash"),
        "file_size",
        F.lit(chunking_version).cast("bigint").alias("chunking_version"),
        F.col("parser_version").cast("bigint").alias("parser_version"),
        F.lit(now).cast("bigint").alias("indexed_at"),
        F.col("route").alias("status"),
        "error_message",
        F.lit(seq).cast("bigint").alias("seq"),
        F.lit(False).alias("tombstone"),
        *carried,
    )
    return {
        "paths": new_paths,
        "content": written.unionByName(gone_rows, allowMissingColumns=True),
        "errors": routed.filter(F.col("error_class").isNotNull()),
    }


def orphans(content: DataFrame, paths: DataFrame) -> DataFrame:
    """CDC-13: content without an alive path."""
    return content.join(paths.select("file_hash"), "file_hash", "left_anti")


def error_digest(errors: DataFrame, n: int = ERROR_KEEP) -> DataFrame:
    """CDC-9: newest ``n`` errors per notebook and class."""
    return top_k(errors, ["notebook_id", "error_class"], [F.desc("ts"), F.desc("file_path")], n)


def error_gate(
    outcomes: DataFrame, *, rate: float = GATE_RATE, minimum: int = GATE_MIN, batch: int = GATE_BATCH, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """CDC-10: (run_id, batch_id, done, errors, abort) at each batch boundary of (run_id, pos, is_error)."""
    per_batch = outcomes.groupBy("run_id", F.floor(F.col("pos") / batch).alias("batch_id")).agg(
        F.count(F.lit(1)).alias("_done"), F.sum(F.col("is_error").cast("bigint")).alias("_errors")
    )
    sums = {"done": F.col("_done"), "errors": F.col("_errors")}
    return (
        prefix_scan(per_batch, ["run_id"], ["batch_id"], sums=sums, hot_rows=hot_rows)
        .drop("_done", "_errors")
        .withColumn("abort", (F.col("done") >= minimum) & (F.col("errors") / F.col("done") > rate))
    )


def invalidate(content: DataFrame, paths: DataFrame, chosen: DataFrame, *, seq: int) -> DataFrame:
    """CDC-11: tombstone rows for the content of the chosen ``file_path`` rows."""
    hashes = paths.join(chosen.select("file_path"), "file_path", "left_semi").select("file_hash").distinct()
    return content.join(hashes, "file_hash", "left_semi").withColumns({"tombstone": F.lit(True), "seq": F.lit(seq).cast("bigint")})


def dirty_notebooks(chosen: DataFrame, notebooks: Sequence[scope.Notebook]) -> DataFrame:
    """CDC-11: notebooks that cover any of the chosen files."""
    path = F.col("file_path")
    owners = F.array(*[F.when(scope.covers_file(path, nb), F.lit(nb.notebook_id)) for nb in notebooks])
    return chosen.select(F.explode(F.array_compact(owners)).alias("notebook_id")).distinct()


def should_compact(stats: DataFrame) -> DataFrame:
    """CDC-12: adds ``compact`` to (log, bytes, lines, lines_at_last nullable)."""
    lines, last = F.col("lines"), F.col("lines_at_last")
    grown = F.when(last.isNull(), lines > COMPACT_LINES).otherwise(lines > last * COMPACT_GROWTH)
    return stats.withColumn("compact", (F.col("bytes") > COMPACT_BYTES) | grown)


def version_stale(notebooks: DataFrame, scoped_paths: DataFrame, current: int = CHUNKING_VERSION) -> DataFrame:
    """CDC-14: notebooks to reindex: dirty, or indexed at an older version with any path in scope.

    notebooks (notebook_id, status, last_index_version nullable); scoped_paths (notebook_id, ...).
    """
    has_paths = scoped_paths.select("notebook_id").distinct().withColumn("_any", F.lit(True))
    old = F.coalesce(F.col("last_index_version") < current, F.lit(True))
    return (
        notebooks.join(has_paths, "notebook_id", "left")
        .withColumn("version_stale", old & F.coalesce("_any", F.lit(False)))
        .withColumn("needs_reindex", (F.col("status") == "dirty") | F.col("version_stale"))
        .drop("_any")
    )
