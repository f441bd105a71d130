"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sizes are words. Targets are water-filled: sources share the mix by weight, none over ``most`` times its size. Each source's
documents lie in hashed blocks; a source draws its blocks in a hashed order, first once, then again, until its target is
met to the word: of the block that crosses the target the documents are taken in a hashed order, the last one in part.
The draws of all sources are dealt to output shards by a binary tree: a node holds the exact number of draws of every
source, and its left half gets a multivariate hypergeometric share of them (source by source, each conditioned on those
before, by inversion). A leaf is a shard; the shards take consecutive stretches of a source's drawing order, which is a
random one, so they are disjoint. In a shard, documents are ordered by a hash.

All randomness is a hash of the seed, so reruns agree. Documents move once, by (source, block), without their text; a hot
source is spread over its blocks. The tree holds one number per source, shard and level, never a document.
Only DataFrame functions are used.

Null texts and texts of blanks have size 0 and are never taken; so is every document of a source of size 0. A null source is
a source of its own, last in order. Rows that repeat count each on their own. Columns besides doc_id, source and text are
passed on by ``mix`` untouched, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .base import text_of

BLANK = r"\x20\x09-\x0D"
BROADCAST_ROWS = 1_000_000  # draws, of about 60 bytes


@dataclass(frozen=True)
class Recipe:
    weights: tuple[float, ...] = (5, 2, 1)  # by source in order, repeating
    share: float = 1.5  # the mix's size in parts of all sizes
    most: int = 2  # no source, and no document, is taken more often
    blocks: int = 4096  # of a source
    shard_words: int = 5_000_000  # about, of an output shard
    seed: int = 17


def words(text: Column) -> Column:
    return F.regexp_count(text_of(text), F.lit(f"[^{BLANK}]+")).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """The text up to its ``n``-th word, blanks before and between kept."""
    return F.array_join(F.slice(F.split(text, f"(?<=[^{BLANK}])(?=[{BLANK}])"), F.lit(1), n.cast("int")), "")


def targets(sizes: DataFrame, recipe: Recipe) -> DataFrame:
    """(key, source_size, nth, target) from (key, source, source_size): one row per source."""
    s = sizes.withColumn("nth", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in recipe.weights]), (F.col("nth") - 1) % len(recipe.weights) + 1)
    s = s.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(recipe.most)).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", "nth")
    everything = Window.partitionBy()
    above, below = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * recipe.share - F.coalesce(F.sum("cap").over(above), F.lit(0.0))) / F.sum("w").over(below)
    s = s.withColumn("level", level).withColumn("rank", F.row_number().over(order))
    free = F.min(F.when(F.col("level") < F.col("ratio"), F.struct("rank", "level"))).over(everything)  # the first source that its cap does not bind
    s = s.withColumn("water", free["level"])
    return s.select("key", "source_size", "nth", F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("water"))).alias("target"))


def uniform(*of: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*of), 11) / float(1 << 53)


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``marked`` among ``total`` are in ``drawn`` draws without replacement: the quantile ``u``.

    Sums the exact probabilities, up to a factor, from 12 deviations below the mode to 12 above; what lies beyond is smaller
    than a double can tell.
    """
    low, high = F.greatest(F.lit(0), drawn - (total - marked)), F.least(drawn, marked)
    mode = F.floor((drawn + 1.0) * (marked + 1.0) / (total + 2.0))
    n = F.greatest(total, F.lit(1)).cast("double")
    spread = F.sqrt(drawn * (marked / n) * ((total - marked) / n) * ((total - drawn) / F.greatest(n - 1, F.lit(1.0)))) * 12 + 12
    return bound(
        F.struct(F.greatest(low, F.floor(mode - spread)).cast("long").alias("a"), F.least(high, F.ceil(mode + spread)).cast("long").alias("b")),
        lambda r: _quantile(total, marked, drawn, u, r["a"], r["b"]),
    )


def _quantile(total: Column, marked: Column, drawn: Column, u: Column, a: Column, b: Column) -> Column:
    def step(acc: Column, k: Column) -> Column:
        next_over_this = (marked - k).cast("double") * (drawn - k) / ((k + 1.0) * (total - marked - drawn + k + 1))
        return acc["p"] * next_over_this

    span = F.sequence(a, b)
    mass = F.aggregate(span, F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum")), lambda acc, k: F.struct(step(acc, k).alias("p"), (acc["sum"] + acc["p"]).alias("sum")), lambda acc: acc["sum"])
    return bound(
        mass,
        lambda m: F.aggregate(
            span,
            F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"), F.lit(None).cast("long").alias("k")),
            lambda acc, k: F.struct(
                step(acc, k).alias("p"), (acc["sum"] + acc["p"]).alias("sum"),
                F.coalesce(acc["k"], F.when(acc["sum"] + acc["p"] >= u * m, k)).alias("k"),
            ),
            lambda acc: F.coalesce(acc["k"], b),
        ),
    )


def split_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(nth, shard, q): the quotas (nth, q) of the sources, dealt to ``shards`` (a power of two) shards of equal capacity."""
    node = quotas.agg(F.sort_array(F.collect_list(F.struct("nth", F.col("q").cast("long").alias("q")))).alias("quota"), F.sum("q").cast("long").alias("all"))
    node = node.select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "quota", "all").where("all is not null")
    empty = F.array().cast("array<struct<nth:int,q:bigint>>")
    for level in range(int(math.log2(shards))):
        if level == 8:
            node = node.repartition("lo")  # 256 nodes: from here on the levels run side by side
        mid = F.floor((F.col("lo") + F.col("hi")) / 2)
        room = F.floor(F.col("all") * mid / shards) - F.floor(F.col("all") * F.col("lo") / shards)
        in_node = F.floor(F.col("all") * F.col("hi") / shards) - F.floor(F.col("all") * F.col("lo") / shards)
        lo, hi = F.col("lo"), F.col("hi")
        left = F.aggregate(
            "quota",
            F.struct(in_node.cast("long").alias("total"), room.cast("long").alias("room"), empty.alias("left")),
            lambda acc, x: bound(
                hypergeometric(acc["total"], x["q"], acc["room"], uniform(F.lit(seed), lo, hi, x["nth"])),
                lambda k: F.struct(
                    (acc["total"] - x["q"]).alias("total"), (acc["room"] - k).alias("room"),
                    F.concat(acc["left"], F.array(F.struct(x["nth"].alias("nth"), k.alias("q")))).alias("left"),
                ),
            ),
            lambda acc: acc["left"],
        )
        node = node.withColumn("left", left).withColumn("mid", mid.cast("long"))
        right = F.zip_with("quota", "left", lambda x, y: F.struct(x["nth"].alias("nth"), (x["q"] - y["q"]).alias("q")))
        halves = F.array(
            F.struct(F.col("lo").alias("lo"), F.col("mid").alias("hi"), F.col("left").alias("quota")),
            F.struct(F.col("mid").alias("lo"), F.col("hi").alias("hi"), right.alias("quota")),
        )
        node = node.select("all", F.explode(halves).alias("half")).select("half.*", "all")
    return node.select(F.col("lo").alias("shard"), F.explode("quota").alias("x")).select("shard", "x.nth", "x.q").where("q > 0")


class Mix:
    """The plan of a mix: ``rows`` (one per document, without text), ``targets`` (one per source), ``draws`` (one per block drawn)."""

    def __init__(self, docs: DataFrame, recipe: Recipe = Recipe()) -> None:
        seed = F.lit(recipe.seed)
        self.recipe = recipe
        self.rows = cut_lineage(docs.select(*self._of_document(recipe, "doc_id", "source", "text")).drop("source"))
        by_block = self.rows.groupBy("key", "block").agg(F.sum("size").alias("words"))
        sizes = by_block.groupBy("key").agg(F.sum("words").alias("source_size"))
        source = F.when(F.col("key") != "n", F.substring("key", 2, 1 << 30))
        self.targets = cut_lineage(targets(sizes.select("key", source.alias("source"), "source_size"), recipe))
        order = Window.partitionBy("key").orderBy(F.xxhash64(seed, "key", "block"), "block")
        blocks = by_block.where("words > 0").select(
            "*", (F.row_number().over(order) - 1).alias("place"),
            (F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words")).alias("before"),
            F.count(F.lit(1)).over(Window.partitionBy("key")).alias("n_blocks"),
        )
        lap = F.explode(F.sequence(F.lit(0), F.lit(recipe.most - 1))).alias("lap")
        draws = blocks.join(self.targets, "key").select("*", lap)
        left = F.round("target").cast("long") - F.col("lap") * F.col("source_size") - F.col("before")
        draws = draws.withColumn("take", F.least("words", F.greatest(F.lit(0), left))).where("take > 0")
        draws = draws.select("key", "block", "nth", (F.col("lap") * F.col("n_blocks") + F.col("place")).alias("draw"), "take", (F.col("take") == F.col("words")).alias("whole"))
        all_words = self.rows.agg(F.sum("size")).first()[0] or 0
        self.shards = 1 << max(2, math.ceil(math.log2(max(1, all_words * recipe.share / recipe.shard_words))))
        leaves = split_tree(draws.groupBy("nth").agg(F.count(F.lit(1)).alias("q")), self.shards, recipe.seed)
        upto = F.sum("q").over(Window.partitionBy("nth").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        dealt = leaves.withColumn("to", upto).select("nth", "shard", F.explode(F.sequence(F.col("to") - F.col("q"), F.col("to") - 1)).alias("draw"))
        self.draws = cut_lineage(draws.join(dealt, ["nth", "draw"]))

    @staticmethod
    def _of_document(recipe: Recipe, doc_id: str, source: str, text: str) -> list[Column]:
        key = F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))
        seed, size = F.lit(recipe.seed), words(F.col(text))
        return [
            F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), key.alias("key"), size.alias("size"),
            F.pmod(F.xxhash64(seed, F.lit("block"), F.col(doc_id)), F.lit(recipe.blocks)).cast("int").alias("block"),
            F.xxhash64(seed, F.lit("order"), F.col(doc_id), F.xxhash64(text)).alias("mixed"),
        ]

    def _last_block(self) -> DataFrame:
        """(key, block, doc_id, mixed, nth_copy, part): the words taken of each document in the block that crosses the target."""
        rows = self.rows.join(self.draws.where("not whole").select("key", "block", "take"), ["key", "block"])
        order = Window.partitionBy("key", "block").orderBy("mixed", "doc_id", "size")
        before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
        part = F.least("size", F.greatest(F.lit(0), F.col("take") - before))
        return rows.withColumn("part", part)

    def taken(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken): one row per document."""
        times = self.draws.groupBy("key", "block").agg(F.sum(F.col("whole").cast("long")).alias("times"), F.max(~F.col("whole")).alias("crosses"))
        rows = self.rows.join(times, ["key", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))
        plain = rows.where("crosses is null or not crosses").select("key", "doc_id", "size", (F.col("times") * F.col("size")).alias("taken"))
        last = self._last_block().join(times, ["key", "block"]).select("key", "doc_id", "size", (F.col("times") * F.col("size") + F.col("part")).alias("taken"))
        return plain.unionByName(last).join(self.targets, "key").select("doc_id", "size", "source_size", "target", "taken")

    def mixed(self, docs: DataFrame) -> DataFrame:
        """The documents of the mix with all their columns, once per draw, by shard and in a hashed order within it.

        The one document per source that is taken in part holds its first words only.
        """
        whole = docs.select(F.struct("*").alias("_doc")).select("_doc", *self._of_document(self.recipe, "_doc.doc_id", "_doc.source", "_doc.text")).drop("source")
        draws = self.draws.select("key", "block", "shard", "draw", "whole")
        few = draws.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # then texts move once only, to their shards
        drawn = whole.join(F.broadcast(draws) if few else draws, ["key", "block"]).where("size > 0")
        part = self._last_block().groupBy("key", "block", "doc_id", "mixed").agg(F.collect_list("part").alias("parts"))
        # rows that repeat share id, text and place: each takes one of their parts
        nth = F.row_number().over(Window.partitionBy("key", "block", "doc_id", "mixed").orderBy("size"))
        last = drawn.where("not whole").withColumn("nth", nth).join(part, ["key", "block", "doc_id", "mixed"]).withColumn("n", F.get("parts", F.col("nth") - 1)).where("n > 0")
        cut = F.when(F.col("n") < F.col("size"), first_words(F.col("_doc.text"), F.col("n"))).otherwise(F.col("_doc.text"))
        last = last.withColumn("_doc", F.col("_doc").withField("text", cut))
        rows = drawn.where("whole").select("_doc", "shard", "draw", "mixed").unionByName(last.select("_doc", "shard", "draw", "mixed"))
        place = F.xxhash64(F.lit(self.recipe.seed), F.lit("place"), "draw", "mixed")
        return rows.repartition(self.shards, "shard").sortWithinPartitions("shard", place).select("_doc.*")
