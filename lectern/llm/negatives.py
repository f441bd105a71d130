"""Hard-negative mining: for each anchor and each of its best positives, the best rows of other labels just below it.

Scores are inner products of integers, so they are exact in any order. Anchors are dealt to rounds of bounded size by a hash
of their id, and a round's anchors are broadcast as matrices; all rows are scored against them where they lie, in products of
bounded size. Two passes over the rows make a round:

* positives: each task passes on its best rows of an anchor's own label, and a first shuffle finds the best of all;
* negatives: their scores bound what can count for an anchor. A task passes on what lies in the window of one of its
  positives, the first few of each window: all that it could add to the result.

Both kinds are pairs with the key (anchor, descending score, positives first, id). They are shuffled by anchor and sorted
within partitions (a secondary sort), so one pass over the sorted stream gives the result: a positive opens a window, a
negative is emitted for each open window that it lies in and that is not full. An anchor's pairs are never held; the state is
its few open windows. A positive precedes negatives of equal score, for which its window must be open already.

Rows without an id, label or vector, or with a null or not finite component, take no part. A vector without components scores
0. Vectors of unequal length are compared as if zeros followed the shorter one. Rows that repeat an id are ranked each on their
own, ties between them by nothing else; a row with the anchor's id is never its positive or negative, and anchors that repeat
give their rows each. Only the three columns are read, so further columns may have any name. Empty tables give no rows.
Scores must fit a long (checked, ``ValueError``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .base import lists

ROUND_BYTES = 32 << 20  # of anchor vectors in one broadcast
CELLS = 2_000_000  # scores that a task holds at once
KEPT_ROWS = 200_000  # pairs that a task gathers before it drops those that others beat
PAIRS = "a bigint, score bigint, kind int, id bigint"
POSITIVE, NEGATIVE = 0, 1


@dataclass(frozen=True)
class Mining:
    """How many positives and negatives, and the window: low% to high% of the positive's score."""

    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100
    scale: int = 256


def usable(rows: DataFrame, how: Mining = Mining(), id_column: str = "vec_id", vector_column: str = "embedding", label: Column | str = "label") -> DataFrame:
    """(id, label, v): the rows that take part, their components scaled and rounded down."""
    label = F.col(label) if isinstance(label, str) else label
    parts = rows.select(F.col(id_column).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.transform(vector_column, lambda x: x.cast("double")).alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return parts.where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite).select("id", "label", F.transform("x", lambda x: F.floor(x * how.scale).cast("bigint")).alias("v"))


class Anchors:
    """The anchors of a round as one matrix of the smallest exact type, and the numbers of those of each label."""

    def __init__(self, table: pa.Table, dim: int, dtype: str) -> None:
        self.ids = table["id"].to_numpy()
        self.labels = table["label"].to_numpy()
        self.matrix = matrix(table["v"], dim, dtype)

    def __len__(self) -> int:
        return len(self.ids)


def matrix(column: pa.ChunkedArray | pa.Array, dim: int, dtype: str) -> np.ndarray:
    values, n = lists(column)
    out = np.zeros((len(n), dim), dtype)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = values
    return out


def exact_type(largest: int, dim: int) -> str:
    """A type in which sums of ``dim`` products up to ``largest`` squared are exact."""
    bound = largest * largest * max(dim, 1)
    if bound >= 1 << 63:
        raise ValueError("scores do not fit a long")
    return "float32" if bound < 1 << 24 else "float64" if bound < 1 << 53 else "int64"


def first_of_group(group: np.ndarray, k: int) -> np.ndarray:
    """Mask of the first ``k`` rows of each run of equal values."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    return np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)])) < k


class Pairs:
    """The pairs that a task gathers, cut to those that can count whenever many have come."""

    def __init__(self, keep) -> None:
        self.keep, self.held, self.n, self.limit = keep, [], 0, KEPT_ROWS

    def offer(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.held.append((anchor, score, ids))
        self.n += len(anchor)
        if self.n > self.limit:
            self._cut()
            self.limit = max(KEPT_ROWS, 2 * self.n)

    def _cut(self) -> None:
        a, s, i = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((i, -s, a))
        a, s, i = a[order], s[order], i[order]
        stays = self.keep(a, s)
        self.held, self.n = [(a[stays], s[stays], i[stays])], int(np.count_nonzero(stays))

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.held:
            self._cut()
            return self.held[0]
        return tuple(np.zeros(0, np.int64) for _ in range(3))


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, dtype: str, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, matrix) of at most ``rows`` rows each."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part.column("id").to_numpy(), part.column("label").to_numpy(), matrix(part.column("v"), dim, dtype)


def _scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left @ right.T).astype(np.int64)


def _batch(anchor: np.ndarray, score: np.ndarray, ids: np.ndarray, kind: int) -> pa.RecordBatch:
    columns = [pa.array(anchor.astype(np.int64)), pa.array(score), pa.array(np.full(len(anchor), kind, np.int32)), pa.array(ids)]
    return pa.RecordBatch.from_arrays(columns, names=["a", "score", "kind", "id"])


def positive_pairs(rows: DataFrame, anchors, how: Mining) -> DataFrame:
    """Pairs of each anchor with rows of its label: the first ``how.positives`` of each task."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Anchors = anchors.value
        order = np.argsort(known.labels, kind="stable")
        labels, first = np.unique(known.labels[order], return_index=True)
        last = np.r_[first[1:], len(order)]
        pairs = Pairs(lambda a, s: first_of_group(a, how.positives))
        for ids, row_labels, v in _blocks(batches, known.matrix.shape[1], known.matrix.dtype.str, 4_096):
            for label in np.intersect1d(labels, row_labels):
                at = int(np.searchsorted(labels, label))
                mine = np.flatnonzero(row_labels == label)
                step = max(1, CELLS // len(mine))
                for k in range(first[at], last[at], step):
                    who = order[k : min(k + step, last[at])]
                    scores = _scores(known.matrix[who], v[mine])
                    other = known.ids[who][:, None] != ids[mine][None, :]
                    if len(mine) > how.positives + 1:  # ties at the edge are kept, all of them
                        edge = np.partition(np.where(other, scores, np.iinfo(np.int64).min), len(mine) - how.positives, axis=1)[:, len(mine) - how.positives]
                        other &= scores >= edge[:, None]
                    q, r = np.nonzero(other)
                    pairs.offer(who[q], scores[q, r], ids[mine][r])
        yield _batch(*pairs.result(), POSITIVE)

    return rows.mapInArrow(best, PAIRS)


def negative_pairs(rows: DataFrame, anchors, windows, how: Mining) -> DataFrame:
    """Pairs of each anchor with rows of other labels in the windows of its positives: the first ones of each window and task."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Anchors = anchors.value
        lows, highs = windows.value  # anchor x positive, an empty window where there is none
        who = np.flatnonzero((lows <= highs).any(axis=1))
        floor, top = np.where(lows <= highs, lows, np.iinfo(np.int64).max).min(axis=1), np.where(lows <= highs, highs, np.iinfo(np.int64).min).max(axis=1)

        def first(a: np.ndarray, s: np.ndarray) -> np.ndarray:
            stays = np.zeros(len(a), bool)
            for p in range(lows.shape[1]):
                inside = np.flatnonzero((s >= lows[a, p]) & (s <= highs[a, p]))
                stays[inside[first_of_group(a[inside], how.negatives)]] = True
            return stays

        pairs = Pairs(first)
        for ids, labels, v in _blocks(batches, known.matrix.shape[1], known.matrix.dtype.str, 4_096):
            step = max(1, CELLS // len(ids))
            for k in range(0, len(who), step):
                some = who[k : k + step]
                scores = known.matrix[some] @ v.T
                q, r = np.nonzero((scores >= floor[some][:, None]) & (scores <= top[some][:, None]))
                different = (known.labels[some][q] != labels[r]) & (known.ids[some][q] != ids[r])
                q, r = q[different], r[different]
                pairs.offer(some[q], scores[q, r].astype(np.int64), ids[r])
        yield _batch(*pairs.result(), NEGATIVE)

    return rows.mapInArrow(best, PAIRS)


def secondary_sort(pairs: DataFrame) -> DataFrame:
    """All pairs of an anchor in one partition, in the order of (anchor, descending score, kind, id)."""
    return pairs.repartition("a").sortWithinPartitions("a", F.desc("score"), "kind", "id")


def first_positives(pairs: DataFrame, k: int) -> DataFrame:
    """(a, score) of the first ``k`` positives of each anchor."""
    order = Window.partitionBy("a").orderBy(F.desc("score"), "id")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("a", "place", "score")


def walk(sorted_pairs: DataFrame, anchors, how: Mining) -> DataFrame:
    """The result from the sorted stream: open windows are all that is held."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        ids_of, anchor, opened, windows = anchors.value.ids, None, 0, []
        for batch in batches:
            out: list[tuple] = []
            for a, score, kind, row in zip(*[batch.column(c).to_pylist() for c in ("a", "score", "kind", "id")]):
                if a != anchor:
                    anchor, opened, windows = a, 0, []
                if kind == POSITIVE:
                    opened += 1
                    if opened <= how.positives:
                        windows.append([score, row, 0])
                    continue
                for w in windows:
                    if w[2] < how.negatives and how.low * w[0] <= 100 * score <= how.high * w[0]:
                        w[2] += 1
                        out.append((int(ids_of[a]), w[1], w[2], row, w[0], score))
            columns = list(zip(*out)) if out else [()] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return sorted_pairs.mapInArrow(stream, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")


def _windows(best: pa.Table, n: int, how: Mining) -> tuple[np.ndarray, np.ndarray]:
    """(lowest, highest) score of the window of each positive, anchor x positive; empty where there is no positive."""
    lows, highs = np.full((n, how.positives), 1, np.int64), np.zeros((n, how.positives), np.int64)
    a, place, score = (best[c].to_numpy() for c in ("a", "place", "score"))
    exact = score.astype(object)
    lows[a, place - 1] = (-(-how.low * exact // 100)).astype(np.int64)
    highs[a, place - 1] = (how.high * exact // 100).astype(np.int64)
    return lows, highs


def mine(rows: DataFrame, anchors: DataFrame, how: Mining = Mining()) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score); both inputs as ``usable`` gives them."""
    sc = rows.sparkSession.sparkContext
    size = F.max(F.aggregate("v", F.lit(0).cast("bigint"), lambda m, x: F.greatest(m, x, -1 - x)))
    shape = [df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), size.alias("largest")).first() for df in (rows, anchors)]
    dim, largest = (max(getattr(s, c) or 0 for s in shape) for c in ("dim", "largest"))
    dtype = exact_type(largest + 1, dim)
    rounds = max(1, -(-shape[1].n * (dim + 2) * 8 // ROUND_BYTES))
    out = None
    for r in range(rounds):
        chosen = anchors.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == r).select("id", "label", "v")
        block = sc.broadcast(Anchors(chosen.toArrow(), dim, dtype))  # at most about ROUND_BYTES
        positives = cut_lineage(positive_pairs(rows, block, how))
        windows = sc.broadcast(_windows(first_positives(positives, how.positives).toArrow(), len(block.value), how))
        pairs = positives.unionByName(negative_pairs(rows, block, windows, how))
        found = walk(secondary_sort(pairs), block, how)
        if rounds > 1:  # a round's broadcasts go before the next one's come
            found = cut_lineage(found)
            block.destroy(), windows.destroy()
        out = found if out is None else out.unionByName(found)
    return out
