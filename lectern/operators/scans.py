"""Ordered scans (ranks, running sums, last values) within groups of any size.

A plain window holds a whole group in one task. Where a group may hold a large share of all
rows, ``prefix_scan`` cuts it into ordered buckets first, scans each bucket on its own and
carries the bucket totals over: the same result, spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

HOT_ROWS = 1_000_000  # a group over this is cut into buckets
SLOTS = 256  # buckets per cut group
FAN_IN = 1_024  # tasks whose best rows meet first, see top_k
MAX_BYTES = 64 << 20  # of a side that is sent to all tasks


def _order_key(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def _hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int) -> DataFrame:
    """The keys of groups over ``hot_rows``, each of them; rows are counted before they move."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select(*keys)


def _split_points(df: DataFrame, hot: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(keys, _cuts): quasi-random order keys of each hot group, by hash, so that a rerun finds the same ones.

    Only rows of hot groups are looked at, and each of them is one of ``SLOTS`` rows per task before it moves.
    """
    mix = F.xxhash64(*order)
    probe = df.join(broadcast_small(hot), keys, "left_semi").groupBy(*keys, F.pmod(mix, F.lit(SLOTS)).alias("_slot"))
    cuts = probe.agg(F.min_by(_order_key(order), mix).alias("_cut"))
    return cuts.groupBy(*keys).agg(F.sort_array(F.collect_list("_cut")).alias("_cuts"))


def prefix_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    rank: str | None = None,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ordered-scan columns to ``df``; ``keys`` + ``order`` must identify a row.

    rank   name of a 1-based row number
    sums   name -> expression: running sum up to and including the row
    lasts  name -> expression: last non-null value before the row

    The keys are counted first, before any row moves. Without a hot group the scan is one plain window; with one, ``df`` is
    read again for cut points and bucket totals of the hot groups. Any number of groups may be hot.
    """
    keys, order = list(keys), list(order)
    sums, lasts = dict(sums or {}), dict(lasts or {})
    if rank:
        sums[rank] = F.lit(1)
    whole = df.columns
    staged = df.select(
        "*", *[e.alias(f"_s_{n}") for n, e in sums.items()], *[e.alias(f"_l_{n}") for n, e in lasts.items()]
    )
    hot = cut_lineage(_hot_keys(df, keys, hot_rows))
    if hot.isEmpty():
        group = Window.partitionBy(*keys).orderBy(*order)
        upto = group.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        above = group.rowsBetween(Window.unboundedPreceding, -1)
        return df.select(
            *whole,
            *[F.sum(e).over(upto).alias(n) for n, e in sums.items()],
            *[F.last(e, ignorenulls=True).over(above).alias(n) for n, e in lasts.items()],
        )
    key, cuts = _order_key(order), cut_lineage(_split_points(df.select(*keys, *order), hot, keys, order))
    staged = staged.join(broadcast_small(cuts), keys, "left").withColumn(
        "_bucket", F.coalesce(F.size(F.filter("_cuts", lambda cut: cut <= key)), F.lit(0))
    )

    totals = (
        staged.filter(F.col("_cuts").isNotNull())
        .groupBy(*keys, "_bucket")
        .agg(
            *[F.sum(f"_s_{n}").alias(f"_ts_{n}") for n in sums],
            *[F.max_by(f"_l_{n}", F.when(F.col(f"_l_{n}").isNotNull(), key)).alias(f"_tl_{n}") for n in lasts],
            F.count(F.lit(1)).alias("_rows"),
        )
    )
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys,
        "_bucket",
        *[F.sum(f"_ts_{n}").over(before).alias(f"_cs_{n}") for n in sums],
        *[F.last(f"_tl_{n}", ignorenulls=True).over(before).alias(f"_cl_{n}") for n in lasts],
    )

    group = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    upto = group.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = group.rowsBetween(Window.unboundedPreceding, -1)
    local = staged.select(
        *[c for c in staged.columns if c != "_cuts"],
        *[F.sum(f"_s_{n}").over(upto).alias(f"_ls_{n}") for n in sums],
        *[F.last(f"_l_{n}", ignorenulls=True).over(above).alias(f"_ll_{n}") for n in lasts],
    )
    return local.join(broadcast_small(carry), [*keys, "_bucket"], "left").select(
        *whole,
        *[(F.col(f"_ls_{n}") + F.coalesce(f"_cs_{n}", F.lit(0))).alias(n) for n in sums],
        *[F.coalesce(f"_ll_{n}", f"_cl_{n}").alias(n) for n in lasts],
    )


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key with their 1-based rank, in two levels.

    A task passes on at most ``k`` rows per key (Spark limits before the exchange, up to the threshold that ``session.DEFAULTS``
    raises). The rows of up to ``FAN_IN`` groups of tasks meet first, then their best: of T tasks no task gets more than
    ``k`` times T / FAN_IN rows of a key, then ``k`` times FAN_IN.
    """
    part = df.withColumn("_part", F.spark_partition_id() % FAN_IN)
    near = part.withColumn("_near", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))).where(F.col("_near") <= k)
    best = Window.partitionBy(*keys).orderBy(*order)
    return near.drop("_part", "_near").withColumn(rank, F.row_number().over(best)).where(F.col(rank) <= k)


def _bytes(df: DataFrame) -> Column:
    """Bytes of a row, about."""
    total = F.lit(16)
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "varchar", "char", "binary"):
            total = total + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif kind in ("array", "map", "struct"):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0))
        else:
            total = total + 8
    return total


def small_enough(df: DataFrame, max_rows: int, max_bytes: int = MAX_BYTES) -> bool:
    """True when ``df`` has at most ``max_rows`` rows and about ``max_bytes`` bytes; looks at no more rows than that."""
    seen = df.select(_bytes(df).cast("bigint").alias("b")).limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b")).first()
    return seen.n <= max_rows and (seen.b or 0) <= max_bytes


def broadcast_small(df: DataFrame, max_rows: int = 1_000_000, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Hint a broadcast only after counting rows and bytes; a larger side is left to a shuffled, skew-handled join."""
    return F.broadcast(df) if small_enough(df, max_rows, max_bytes) else df


class BestRows:
    """The best ``k`` ids of each query over the batches of one task, ties by id: what the task passes on."""

    def __init__(self, n_queries: int, k: int) -> None:
        self.k = k
        self.floor = np.full(n_queries, -np.inf)  # a later score below this cannot count
        self.rows = pd.DataFrame({"q": np.array([], dtype="int64"), "chunk_id": [], "score": np.array([], dtype="float64")})

    def offer(self, scores: np.ndarray, ids: np.ndarray, above: float = -np.inf) -> None:
        """``scores`` is queries by ids; only scores over ``above`` count."""
        keep = (scores >= self.floor[:, None]) & (scores > above)
        if scores.shape[1] > self.k:
            at = scores.shape[1] - self.k
            keep &= scores >= np.partition(scores, at, axis=1)[:, at][:, None]
        q, c = np.nonzero(keep)
        if not len(q):
            return
        new = pd.DataFrame({"q": q, "chunk_id": ids[c], "score": scores[q, c]})
        pool = pd.concat([self.rows, new]) if len(self.rows) else new
        best = pool.sort_values(["q", "score", "chunk_id"], ascending=[True, False, True]).groupby("q", sort=False)
        self.rows = best.head(self.k)
        full = self.rows.groupby("q", sort=False)["score"].agg(["size", "min"])
        full = full[full["size"] == self.k]
        self.floor[full.index.to_numpy()] = full["min"].to_numpy()

    def result(self, query_ids: np.ndarray) -> pd.DataFrame:
        out = self.rows
        return pd.DataFrame({"query_id": query_ids[out["q"].to_numpy()], "chunk_id": out["chunk_id"].to_numpy(), "score": out["score"].to_numpy()})
