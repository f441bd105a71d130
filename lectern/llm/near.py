"""Similarity join of texts on word shingles by chosen paths, with an exact check.

A text is the set of its hashed five-word shingles; texts with the same set are copies and count once. Of each set a
consistent sample is kept (the hashes under ``sample`` / size: about ``sample`` shingles), so similar sets have similar
samples. Paths split the sets recursively: a set takes the shared tokens that a hash of the path and the token chooses,
about ``first`` at the root and ``deeper`` below, as many runs at once. A pair of similarity 0.8 shares at least 0.8 of
them on average and is lost with a probability of about exp(-0.8 * first), 7 in 100 000 (4 in 10 000 if all its tokens are
so common that its paths are split twice). Buckets of up to ``small`` sets are
brute-forced; larger ones are split further, unless their sets are alike anyway (``alike`` on average, by one minimal token each) or ``depth`` is reached: those are brute-forced in blocks of ``block`` sets, pairs of blocks spread over tasks.

Brute force on samples (estimate at least ``loose``, five deviations under the threshold) leaves candidates. Their connected
components are small families; only now the whole texts of candidates are read again, and every pair of a family is compared
exactly, in blocks. A task returns for each set its number of links and the smallest set it is connected to, never pairs.

So: no pair rows, no all-pairs, no cap on buckets or partners. A family as large as a share of the corpus costs its square in
comparisons (the number of links is asked for), in tasks of bounded size.

Nulls and texts without words have no shingles: they are copies of each other without links. A text of one to four words has
one shingle, all its words. Rows that repeat are copies. The class of a text is the smallest doc_id connected to it; sets
that only rows without a doc_id have, or rows whose doc_id also stands on another set, take a negative number made from their content, and so does
a class of such sets alone. Ids are below 2^62. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import cut_lineage
from .base import free_name, giving_back, list_array, lists, runs, slices, text_of
from .components import components
from .shingles import mixed, shingle_sets

BROADCAST_ROWS = 1_000_000  # ids of 8 bytes, with the hash of a text or without
ONE = float(1 << 64)
MADE_UP = 1 << 62  # names made from content are above it, ids below


@dataclass(frozen=True)
class Paths:
    threshold: float = 0.8
    sample: int = 96
    first: float = 12.0
    deeper: float = 3.0
    stays: int = 8
    depth: int = 4
    small: int = 64
    alike: float = 0.5
    loose: float = 0.6
    sample_block: int = 1024  # sets of a block when samples are compared
    block: int = 512  # and when whole sets are


def digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sums of hashes that name each set by its content."""
    d1 = np.array([mixed(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
    return d1, np.array([mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)


def samples(docs: DataFrame, p: Paths) -> DataFrame:
    """(id, key, d1, d2, n, sample): a hash of each row's text, digest and size of its set, and the upper half of its sampled shingles, in order."""
    rows = docs.select(F.col("doc_id").alias("id"), text_of(F.col("text")).alias("text"), _key("text"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = shingle_sets(part.column("text").to_pylist())
            kept = [s if len(s) <= p.sample else s[: np.searchsorted(s, np.uint64(p.sample / len(s) * ONE))] for s in sets]
            d1, d2 = digests(sets)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("key"), pa.array(d1), pa.array(d2), pa.array([len(s) for s in sets], pa.int64()), list_array((np.concatenate(kept) >> np.uint64(32)).astype(np.uint32).view(np.int32), np.array([len(k) for k in kept]))],
                names=["id", "key", "d1", "d2", "n", "sample"],
            )

    return rows.mapInArrow(giving_back(take), StructType([StructField("id", rows.schema["id"].dataType), *StructType.fromDDL("key bigint, d1 bigint, d2 bigint, n bigint, sample array<int>").fields]))


def _key(text: str) -> Column:
    return F.xxhash64(text_of(F.col(text))).alias("key")


def _unsigned(below: Column, limit: Column) -> Column:
    """Whether a hash, read as a fraction of all hashes, is below ``limit``; hashes are mixed anew, so it may be any."""
    return F.shiftrightunsigned(below, 11) < limit * float(1 << 53)


def first_paths(sets: DataFrame, p: Paths) -> DataFrame:
    chosen = F.filter("sample", lambda t: _unsigned(F.xxhash64(t), F.lit(p.first) / F.least(F.col("n"), F.lit(p.sample))))
    return sets.select("id", F.explode(chosen).alias("path"))


def with_samples(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, n, sample, path) of members (id, path); a set's sample moves once for all its paths."""
    of_set = members.groupBy("id").agg(F.collect_list("path").alias("paths"))  # as many as a set chooses
    return of_set.join(sets.select("id", "n", "sample"), "id").select("id", "n", "sample", F.explode("paths").alias("path"))


def probed(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, path, token) of members (id, path): the token of the set's sample with the least hash on the path."""
    least = F.array_min(F.transform("sample", lambda t: F.struct(F.xxhash64(F.lit("probe"), "path", t).alias("h"))))
    return with_samples(members, sets).select("id", "path", least["h"].alias("token"))


def alike_paths(seen: DataFrame, sizes: DataFrame, p: Paths) -> DataFrame:
    """(path, size, main) of the buckets whose sets are alike on average: the share of pairs with the same probe token (``seen``) estimates
    their similarity. The token that most sets have tells the main family."""
    counts = seen.groupBy("path", "token").agg(F.count(F.lit(1)).alias("m"))
    pairs = counts.groupBy("path").agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("pairs"), F.max(F.struct("m", "token"))["token"].alias("main"))
    return pairs.join(sizes, "path").where(F.col("pairs") >= p.alike * F.col("size") * F.col("size")).select("path", "size", "main")


def next_paths(members: DataFrame, sets: DataFrame, p: Paths, level: int) -> DataFrame:
    """(id, path): the children of each hot path that its members choose."""
    chosen = F.filter("sample", lambda t: _unsigned(F.xxhash64(F.lit(level), "path", t), F.lit(p.deeper) / F.least(F.col("n"), F.lit(p.sample))))
    rows = with_samples(members, sets).select("id", "path", F.explode(chosen).alias("t"))
    return rows.select("id", F.xxhash64("path", "t").alias("path"))


def leaves(sets: DataFrame, p: Paths) -> DataFrame:
    """(id, path, size): the buckets to brute-force, each of two sets at least.

    A set of the main family of large buckets of alike sets is in many of them with the same others, so it stays in ``stays`` of those
    only, by a hash of the path: enough to connect the family, whose pairs are all compared later. Other sets of such a bucket,
    with another probe token than most, stay in all.
    """
    members, found, families = cut_lineage(first_paths(sets, p)), None, None
    for level in range(1, p.depth + 1):
        sizes = cut_lineage(members.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
        sized = members.join(sizes, "path").select("id", "path", "size")
        cold = sized.where(F.col("size") <= p.small) if level < p.depth else sized
        found = cold if found is None else found.unionByName(cold)
        hot = sizes.where(F.col("size") > p.small)
        if level == p.depth or hot.isEmpty():
            break
        seen = cut_lineage(probed(sized.where(F.col("size") > p.small).select("id", "path"), sets))
        alike = cut_lineage(alike_paths(seen, hot, p))
        family = seen.join(alike, "path").select("id", "path", "size", (F.col("token") == F.col("main")).alias("main"))
        families = family if families is None else families.unionByName(family)
        members = cut_lineage(next_paths(seen.join(alike, "path", "left_anti").select("id", "path"), sets, p, level))
    if families is None:
        return found
    nth = F.row_number().over(Window.partitionBy("id", "main").orderBy(F.xxhash64("path")))  # of the paths of one set
    return found.unionByName(families.withColumn("nth", nth).where((F.col("nth") <= p.stays) | ~F.col("main")).drop("nth", "main"))


def blocked(rows: DataFrame, key: str, size: Column, block: int) -> DataFrame:
    """Rows dealt to pairs of blocks of their bucket: ``pair`` names bucket and pair, ``side`` is 0, 1, or 2 for both.

    A bucket of one block is one pair; of b blocks, each row goes to b pairs.
    """
    n = F.greatest(F.lit(1), F.ceil(size / block)).cast("int")
    rows = rows.withColumn("_n", n).withColumn("_mine", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    side = F.when(F.col("_mine") == F.col("_other"), 2).when(F.col("_mine") < F.col("_other"), 0).otherwise(1)
    pair = F.xxhash64(F.lit("pair"), key, F.least("_mine", "_other"), F.greatest("_mine", "_other"))
    return rows.withColumn("side", side).withColumn("pair", pair).drop("_n", "_mine", "_other")


def overlaps(tokens: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each set: how many of its tokens each set of the group has."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    _, code = np.unique(tokens, return_inverse=True)
    order = np.argsort(code, kind="stable")
    posting, begin = owner[order], np.concatenate([[0], np.cumsum(np.bincount(code))])
    ends = np.cumsum(lengths)
    for i in range(len(lengths)):
        mine = code[ends[i] - lengths[i] : ends[i]]
        df = begin[mine + 1] - begin[mine]
        at = np.repeat(begin[mine] - np.cumsum(df) + df, df) + np.arange(df.sum())
        yield i, np.bincount(posting[at], minlength=len(lengths))


def smallest_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index connected to each of ``n`` nodes by the edges (a, b)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def candidate_edges(rows: DataFrame, p: Paths) -> DataFrame:
    """(a, b): each set tied to the smallest of its bucket that a chain of estimates connects it with."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "pair"):
            ids, n, side = (group.column(c).to_numpy() for c in ("id", "n", "side"))
            order = np.argsort(ids, kind="stable")
            tokens, lengths = lists(group.column("sample").take(pa.array(order)))
            ids, n, side, tokens = ids[order], n[order], side[order], tokens.view(np.uint32)
            starts = np.cumsum(lengths) - lengths
            left, right = [], []
            for i, shared in overlaps(tokens, lengths):
                # of each pair the larger set looks at the smaller: all its sample lies under the common limit
                other = (shared > 0) & ((n < n[i]) | ((n == n[i]) & (np.arange(len(n)) < i))) & (n >= p.threshold * n[i]) & ((side == 2) | (side != side[i]) | (side[i] == 2))
                if not other.any():
                    continue
                if n[i] > p.sample:
                    limit = np.uint32(int(p.sample / n[i] * ONE) >> 32)
                    under = np.add.reduceat((tokens < limit).astype(np.int64), starts)
                else:
                    under = lengths
                near = np.flatnonzero(other & (shared >= p.loose * (lengths[i] + under - shared)))
                left.append(np.full(len(near), i))
                right.append(near)
            if left:
                a, b = np.concatenate(left), np.concatenate(right)
                low = smallest_reached(len(ids), a, b)
                tied = np.flatnonzero(low != np.arange(len(ids)))
                if len(tied):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[tied]), pa.array(ids[low[tied]])], names=["a", "b"])

    return rows.select("pair", "id", "n", "side", "sample").repartition("pair").sortWithinPartitions("pair").mapInArrow(giving_back(compare), "a bigint, b bigint")


def exact_links(rows: DataFrame, p: Paths) -> DataFrame:
    """(id, links, low): per pair of blocks, a set's links and the smallest set it is connected to."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "pair"):
            ids, side = group.column("id").to_numpy(), group.column("side").to_numpy()
            order = np.argsort(ids, kind="stable")
            tokens, n = lists(group.column("tokens").take(pa.array(order)))
            ids, side = ids[order], side[order]
            links, left, right = np.zeros(len(ids), np.int64), [], []
            for i, shared in overlaps(tokens, n):
                near = (shared >= p.threshold * (n[i] + n - shared) - 1e-9) & (shared > 0) & ((side == 2) | (side != side[i]))
                near[i] = False
                links[i] = near.sum()
                b = np.flatnonzero(near)
                left.append(np.full(len(b), i))
                right.append(b)
            low = smallest_reached(len(ids), np.concatenate(left), np.concatenate(right))
            some = np.flatnonzero(links)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(ids[low[some]])], names=["id", "links", "low"])

    return rows.select("pair", "id", "side", "tokens").repartition("pair").sortWithinPartitions("pair").mapInArrow(giving_back(compare), "id bigint, links bigint, low bigint")


def token_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, family, size, tokens) of the sets in ``wanted`` (id, node, family, size, d1, d2), from their whole texts. Rows without an id are
    found by the content of their sets."""
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = docs.select(F.col("doc_id").alias("id"), text_of(F.col("text")).alias("text"))
    rows = texts.join(F.broadcast(wanted) if few else wanted, "id").select("node", "family", "size", "d1", "text")
    unnamed = wanted.where("id is null").drop("id")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            d1, d2 = digests(shingle_sets(part.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(d1), pa.array(d2), part.column("text")], names=["d1", "d2", "text"])

    if not unnamed.isEmpty():
        known = texts.where("id is null").select("text").mapInArrow(digest, "d1 bigint, d2 bigint, text string")
        rows = rows.unionByName(known.join(F.broadcast(unnamed) if few else unnamed, ["d1", "d2"]).select("node", "family", "size", "d1", "text"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = shingle_sets(part.column("text").to_pylist())
            d1, _ = digests(sets)
            keep = np.flatnonzero(d1 == part.column("d1").to_numpy())  # an id may stand on several texts
            if len(keep):
                part, sets = part.take(pa.array(keep)), [sets[i] for i in keep]
                tokens = list_array(np.concatenate(sets).view(np.int64), np.array([len(s) for s in sets]))
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("family"), part.column("size"), tokens], names=["id", "family", "size", "tokens"])

    return rows.mapInArrow(giving_back(take), "id bigint, family bigint, size bigint, tokens array<bigint>").dropDuplicates(["id"])


def _shown(name: Column) -> Column:
    """Made-up names are the largest numbers within, so that a class is named by an id if it has one, and negative in results."""
    return F.when(name >= MADE_UP, -name).otherwise(name)


def near_duplicates(docs: DataFrame, p: Paths = Paths()) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, rep_id (the smallest id with the same shingles), n_links (different texts at the threshold)."""
    return _found(docs, p).select("doc_id", "class_id", "rep_id", "n_links")


def _found(docs: DataFrame, p: Paths) -> DataFrame:
    """The rows of ``near_duplicates`` with the key of the text and the smallest (id, key) that has the same shingles."""
    rows = cut_lineage(samples(docs, p))
    made_up = F.xxhash64("d1", "d2").bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(MADE_UP)
    of_set = cut_lineage(rows.groupBy("d1", "d2").agg(F.min("id").alias("first"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "key")))["key"].alias("first_key"), F.max("n").alias("n")).withColumn("node", F.coalesce(F.col("first").cast("long"), made_up)))
    # one row with the node's id has its set's sample; sets without an id are held by rows without one
    same = F.col("id").eqNullSafe(F.col("first"))
    sets = rows.join(of_set.drop("n"), ["d1", "d2"]).where(same).dropDuplicates(["d1", "d2"])
    # an id that stands on several texts names its sets by their content
    sets = cut_lineage(sets.select("d1", "d2", "n", "sample", "first", "first_key", "node"))
    twice = sets.groupBy("node").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("node")
    sets = sets.join(F.broadcast(twice).withColumn("again", F.lit(True)) if twice.limit(10_001).count() <= 10_000 else twice.withColumn("again", F.lit(True)), "node", "left")
    sets = cut_lineage(sets.withColumn("id", F.when(F.col("again"), made_up).otherwise(F.col("node"))).drop("again", "node"))

    bucketed = cut_lineage(leaves(sets.where("n > 0"), p))
    edges = candidate_edges(blocked(bucketed, "path", F.col("size"), p.sample_block).join(sets.select("id", "n", "sample"), "id"), p)
    families = components(edges)
    sizes = families.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    named = families.join(sizes, "label").select(F.col("node").alias("id"), F.col("label").alias("family"), "size")
    wanted = cut_lineage(named.join(sets.select("id", "d1", "d2", "first"), "id").select(F.col("first").alias("id"), F.col("id").alias("node"), "family", "size", "d1", "d2"))
    found = cut_lineage(exact_links(blocked(token_sets(docs, wanted), "family", F.col("size"), p.block), p))
    classes = components(found.select(F.col("id").alias("a"), F.col("low").alias("b"))).withColumnRenamed("node", "id")
    links = found.groupBy("id").agg(F.sum("links").alias("links")).join(classes, "id", "left")
    result = sets.select("d1", "d2", "id", "first", "first_key").join(links, "id", "left")
    named = result.select("d1", "d2", "first", "first_key", _shown(F.col("id")).alias("rep_id"), _shown(F.coalesce("label", "id")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))
    return rows.select(F.col("id").alias("doc_id"), "key", "d1", "d2").join(named, ["d1", "d2"]).drop("d1", "d2")


def one_of_each(docs: DataFrame, p: Paths = Paths()) -> DataFrame:
    """The rows of ``docs``, as they are, one of each class: of the set that names the class, the row with the smallest id and key of its text.

    Rows without an id pass, as no class can name them; a class that a set of such rows names keeps those only.
    Further columns may have any names. An empty table gives an empty one.
    """
    found = _found(docs, p).where("doc_id is not null")
    stays = (F.col("rep_id") == F.col("class_id")) & (F.col("doc_id") == F.col("first")) & (F.col("key") == F.col("first_key"))
    by_row = cut_lineage(found.groupBy("doc_id", "key").agg(F.max(stays).alias("stays"), F.count(F.lit(1)).alias("n")))
    gone, twice = by_row.where("not stays").select("doc_id", "key"), by_row.where("stays and n > 1").select("doc_id", "key")
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    key = free_name(docs, "_key")
    rows = docs.withColumn(key, F.struct("doc_id", _key("text")))
    rows = rows.join(F.broadcast(_as_key(gone, key)) if few else _as_key(gone, key), key, "left_anti")
    if not twice.isEmpty():
        again = _as_key(twice, key)
        rows = rows.join(again, key, "left_anti").unionByName(rows.join(again, key, "left_semi").dropDuplicates([key]))
    return rows.drop(key)


def _as_key(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(F.struct("doc_id", "key").alias(name))
