"""Exact duplicates against immutable snapshots, screened by binary fuse filters.

Texts are equal when they are the same bytes after every run of blanks, tabs and line ends became one blank. A snapshot is
one row per distinct text: its digest, smallest id and number of rows, in shards by digest, each with a static binary fuse
filter over its digests (about 18 bits a text). An incoming batch is grouped by digest first, so a text with endless copies
is one row from then on. Each shard's filter screens the batch's digests; only those it lets through are looked up in the
exact buckets, and the texts behind both sides are compared byte by byte. Digests that no snapshot holds form groups of
their own among the batch's rows.

Only digests move; texts move for the few digests found in a snapshot. A filter holds one shard, never the whole snapshot.
Null texts count as empty, and empty texts are equal. A row without an id can be a copy but never the one that stays,
unless its whole group has no id. Rows that repeat with the same id and text: the first stays, the others are copies.
Only the id and text columns are read. Empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .base import free_name, text_of

SHARD_ROWS = 50_000  # about so many digests in a filter
BROADCAST_ROWS = 1_000_000  # ids of 8 bytes: up to so many are sent to the tasks, more are joined by a shuffle


def normalised(text: Column) -> Column:
    return F.regexp_replace(text_of(text), "[\\x20\\x09-\\x0D]+", " ")


class FuseFilter:
    """A static 3-wise binary fuse filter with 16-bit fingerprints over distinct 64-bit keys."""

    def __init__(self, seed: int, segment: int, segments: int, table: np.ndarray) -> None:
        self.seed, self.segment, self.segments, self.table = seed, segment, segments, table

    @staticmethod
    def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
        h = keys + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = (h ^ (h >> np.uint64(33))) * np.uint64(m)
        return h ^ (h >> np.uint64(33))

    @staticmethod
    def _slots(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
        base = ((h >> np.uint64(32)) * np.uint64(segments * segment) >> np.uint64(32)).astype(np.int64)
        low = (h & np.uint64(0xFFFFFFFF)).astype(np.int64)
        mask = segment - 1
        return np.stack([base, (base + segment) ^ ((low >> 14) & mask), (base + 2 * segment) ^ (low & mask)])

    @staticmethod
    def _print(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFFFF)).astype(np.uint16)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        keys = np.unique(keys)
        n = len(keys)
        segment = 1 << min(18, max(2, int(math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25))))
        size = round(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))) + 32
        segments = max(1, -(-size // segment) - 2)
        for seed in range(1, 1_000):
            if seed % 20 == 0:
                segments += 1 + segments // 10
            h = cls._mix(keys, seed)
            slots = cls._slots(h, segment, segments)
            order = cls._peel(slots, (segments + 2) * segment)
            if order is not None:
                break
        else:
            raise RuntimeError("no seed peels the keys")
        table, prints = np.zeros((segments + 2) * segment, np.uint16), cls._print(h)
        for keys_at, slot_at in reversed(order):
            s = slots[:, keys_at]
            table[slot_at] = prints[keys_at] ^ table[s[0]] ^ table[s[1]] ^ table[s[2]]
        return cls(seed, segment, segments, table)

    @staticmethod
    def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Rounds of (keys, the slot each is alone in); None if a core is left."""
        n = slots.shape[1]
        degree = np.bincount(slots.ravel(), minlength=size)
        owners = np.zeros(size, np.int64)
        for row in slots:
            np.bitwise_xor.at(owners, row, np.arange(n))
        rounds, left, alone = [], n, np.flatnonzero(degree == 1)
        while len(alone):
            keys, first = np.unique(owners[alone], return_index=True)
            rounds.append((keys, alone[first]))
            left -= len(keys)
            for row in slots[:, keys]:
                np.subtract.at(degree, row, 1)
                np.bitwise_xor.at(owners, row, keys)
            touched = np.unique(slots[:, keys])
            alone = touched[degree[touched] == 1]
        return rounds if left == 0 else None

    def __contains__(self, key: int) -> bool:
        return bool(self.has(np.array([key], np.uint64))[0])

    def has(self, keys: np.ndarray) -> np.ndarray:
        h = self._mix(keys, self.seed)
        s = self._slots(h, self.segment, self.segments)
        return self._print(h) == self.table[s[0]] ^ self.table[s[1]] ^ self.table[s[2]]


def _keys(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join([bytes(d[:8]) for d in digests]), ">u8").astype(np.uint64)


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, digest, n): rows counted by id and text; the digest is SHA-256 of the normalised text."""
    rows = docs.select(F.col(id_column).alias("id"), F.unhex(F.sha2(normalised(F.col(text_column)), 256)).alias("digest"))
    return rows.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("n"))


def groups(rows: DataFrame) -> DataFrame:
    """(digest, id, n): one row per distinct text with its smallest id."""
    return rows.groupBy("digest").agg(F.min("id").alias("id"), F.sum("n").alias("n"))


def filters(snapshot: DataFrame, shards: int) -> DataFrame:
    """(shard, seed, segment, segments, table): the filters of a snapshot's shards."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        f = FuseFilter.build(_keys(rows["digest"]))
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "seed": [f.seed], "segment": [f.segment], "segments": [f.segments], "table": [f.table.tobytes()]})

    return snapshot.select(shard_of("digest", shards).alias("shard"), "digest").groupBy("shard").applyInPandas(build, "shard int, seed int, segment int, segments int, table binary")


def shard_of(digest: str, shards: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(shards)).cast("int")


def screen(batch: DataFrame, built: DataFrame, shards: int) -> DataFrame:
    """The rows of ``batch`` (digest, ...) whose digest passes the filter of its shard."""
    rows = batch.withColumn("shard", shard_of("digest", shards))

    def passed(rows: pd.DataFrame, built: pd.DataFrame) -> pd.DataFrame:
        if not len(built) or not len(rows):
            return rows.iloc[:0]
        b = built.iloc[0]
        f = FuseFilter(int(b["seed"]), int(b["segment"]), int(b["segments"]), np.frombuffer(b["table"], np.uint16))
        return rows[f.has(_keys(rows["digest"]))]

    return rows.groupBy("shard").cogroup(built.groupBy("shard")).applyInPandas(passed, rows.schema).drop("shard")


def verified(found: DataFrame, docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The rows of ``found`` (digest, id, old_id) whose two texts are the same bytes.

    Only the texts of these ids are needed: few ids are sent to the tasks, so that no text moves for the others; many are joined.
    Texts of rows without an id are found by their digests.
    """
    ids = found.select(F.explode(F.array("id", "old_id")).alias("want")).where("want is not null").distinct()
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = docs.select(F.col(id_column).alias("want"), normalised(F.col(text_column)).alias("body"))
    digest = F.unhex(F.sha2("body", 256)).alias("digest")
    texts = rows.join(F.broadcast(ids) if few else ids, "want", "left_semi").select("want", "body", digest)
    unnamed = found.where("id is null or old_id is null").select("digest")
    if not unnamed.isEmpty():
        few = unnamed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        texts = texts.unionByName(rows.where("want is null").select("want", "body", digest).join(F.broadcast(unnamed) if few else unnamed, "digest", "left_semi"))
    texts = texts.dropDuplicates(["want", "digest"])
    new = texts.select(F.col("want").alias("_id"), F.col("digest").alias("_digest"), "body")
    new = found.join(new, F.col("digest").eqNullSafe(F.col("_digest")) & F.col("id").eqNullSafe(F.col("_id"))).drop("_id", "_digest")
    old = texts.select(F.col("want").alias("_id"), F.col("digest").alias("_digest"), F.col("body").alias("old_body"))
    return new.join(old, F.col("digest").eqNullSafe(F.col("_digest")) & F.col("old_id").eqNullSafe(F.col("_id"))).where("body = old_body").select("digest")


def exact_duplicates(docs: DataFrame, is_snapshot: Column | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``is_snapshot`` tells the rows that an earlier, immutable snapshot holds from those of the incoming batch, by the columns
    of ``docs``; none means that all are incoming.
    """
    snapshot = F.coalesce(is_snapshot, F.lit(False)) if is_snapshot is not None else F.lit(False)
    marked = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), snapshot.alias("old"))
    rows = cut_lineage(digests(marked.where("old"), "id").withColumn("old", F.lit(True)).unionByName(digests(marked.where("not old"), "id").withColumn("old", F.lit(False))))
    old, new = groups(rows.where("old")), groups(rows.where("not old"))
    shards = max(1, -(-rows.where("old").count() // SHARD_ROWS))
    positive = screen(new, filters(old, shards), shards)
    exact = positive.select("digest", "id").join(old.select("digest", F.col("id").alias("old_id")), "digest")
    same = verified(cut_lineage(exact), marked, "id", "text").withColumn("same", F.lit(True))
    sides = old.withColumn("old", F.lit(True)).unionByName(new.withColumn("old", F.lit(False)))
    table = sides.groupBy("digest").agg(
        F.min(F.when(F.col("old"), F.col("id"))).alias("old_id"), F.sum(F.when(F.col("old"), F.col("n"))).alias("old_n"),
        F.min(F.when(~F.col("old"), F.col("id"))).alias("new_id"), F.sum(F.when(~F.col("old"), F.col("n"))).alias("new_n"),
    ).join(same, "digest", "left")
    one = F.col("same") | F.col("old_n").isNull() | F.col("new_n").isNull()  # else the bytes differ: two groups with one digest
    total = F.coalesce(F.col("old_n"), F.lit(0)) + F.coalesce(F.col("new_n"), F.lit(0))
    out = rows.join(table.withColumn("one", F.coalesce(one, F.lit(False))), "digest").select(
        "id", "digest", "old", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("nth"),  # rows that repeat come back as often
        F.when(F.col("one"), F.least("old_id", "new_id")).when(F.col("old"), F.col("old_id")).otherwise(F.col("new_id")).alias("keep_id"),
        F.when(F.col("one"), total).when(F.col("old"), F.col("old_n")).otherwise(F.col("new_n")).cast("long").alias("group_size"),
        (F.col("one") & ~F.col("old") & F.col("old_id").eqNullSafe(F.col("id")) & F.col("old_n").isNotNull()).alias("again"),
    )
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1) & ~F.col("again")
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def older_half(docs: DataFrame, id_column: str = "doc_id") -> Column:
    """True up to the middle between the smallest and the largest id: a snapshot taken before the rest arrived."""
    ends = docs.agg(F.min(id_column).alias("a"), F.max(id_column).alias("b")).first()
    return F.col(id_column) <= F.lit(0 if ends.a is None else ends.a + (ends.b - ends.a) // 2)


def unique_rows(docs: DataFrame, is_snapshot: Column | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, as they are, that stay; of rows that repeat with the same id and text, one.

    Further columns may have any names. An empty table gives an empty one.
    """
    found = exact_duplicates(docs, is_snapshot, id_column, text_column)
    row = free_name(docs, "_row")
    named = found.select(_row_name(F.col("doc_id"), F.col("text_sha256")).alias(row), "kept")
    by_row = cut_lineage(named.groupBy(row).agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n")))
    gone, twice = by_row.where("not stays").select(row), by_row.where("stays and n > 1").select(row)
    rows = docs.withColumn(row, _row_name(F.col(id_column), F.sha2(normalised(F.col(text_column)), 256)))
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(gone) if few else gone, row, "left_anti")
    if not twice.isEmpty():
        rows = rows.join(twice, row, "left_anti").unionByName(rows.join(twice, row, "left_semi").dropDuplicates([row]))
    return rows.drop(row)


def _row_name(doc_id: Column, digest: Column) -> Column:
    return F.concat_ws("/", F.coalesce(doc_id.cast("string"), F.lit("")), digest)
