"""Chat formatting: logged conversations that another one continues are collapsed, the maximal ones are rendered.

A conversation logged after every turn appears as many rows sets, each a prefix of the next. A turn's place is its rank by
(turn, role, text) within its conversation. Each turn carries a rolling hash of its prefix: running sums of four 31-bit
slices of a hash of (place, role, text), so all prefixes of all conversations are as many rows as there are turns. A
conversation goes if its whole hash is the hash of a proper prefix of another (anti-join), and of equal conversations the one
with the smallest id stays. Prefixes are reduced to distinct ones, and equal conversations to one, before the join, so that a
first turn or a conversation with endless copies is one row on either side.

Rendering is a map over turns: one row per turn of a maximal conversation, in the order of ``place``, so that a conversation of
any length never has to fit into one row or task. Null roles render as ``user``, null texts as empty; turns without a
conversation id are left out, since nothing tells which belong together. Rows that repeat are turns of their own. Tables
without rows give none. Only the four columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scans import prefix_scan
from .base import text_of

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SLICE = 0x7FFFFFFF
HASH = ["h1", "h2", "h3", "h4"]


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, place, n_turns as far, h1 to h4): the rolling hash of the conversation up to each turn."""
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), text_of(F.col("text")).alias("text"))
    rows = rows.where("conv_id is not null")
    # equal rows of a conversation are told apart by nothing but their number, so they are counted and dealt out again
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")
    order = ["turn", "role", "text", "copy"]
    rows = prefix_scan(rows, ["conv_id"], order, rank="place").withColumn("one", F.xxhash64("place", "role", "text")).withColumn("two", F.xxhash64(F.lit("second"), "text", "role", "place"))
    parts: dict[str, Column] = {
        "h1": F.col("one").bitwiseAND(F.lit(SLICE)), "h2": F.shiftrightunsigned("one", 32).bitwiseAND(F.lit(SLICE)),
        "h3": F.col("two").bitwiseAND(F.lit(SLICE)), "h4": F.shiftrightunsigned("two", 32).bitwiseAND(F.lit(SLICE)),
    }
    return prefix_scan(rows, ["conv_id"], order, sums=parts).select("conv_id", "turn", "role", "text", "place", *HASH)


def maximal(prefix: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that no other one continues; ``n_copies`` are logged with the same turns."""
    lengths = prefix.groupBy("conv_id").agg(F.max("place").alias("n_turns"), F.max_by(F.struct(*HASH), "place").alias("whole"))
    distinct = lengths.groupBy("whole").agg(F.min("conv_id").alias("conv_id"), F.max("n_turns").alias("n_turns"), F.count(F.lit(1)).alias("n_copies"))
    longer = prefix.select("conv_id", "place", *HASH).join(lengths.select("conv_id", "n_turns"), "conv_id").where("place < n_turns")
    proper = longer.groupBy(*HASH).agg(F.count(F.lit(1)).alias("_seen"))
    ends = distinct.select("conv_id", "n_turns", "n_copies", *[F.col(f"whole.{h}").alias(h) for h in HASH])
    return ends.join(proper, HASH, "left_anti").select("conv_id", "n_turns", "n_copies")


def render(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, place, n_turns, n_copies, role, rendered): the maximal conversations, turn by turn."""
    prefix = prefixes(turns)
    body = F.concat(F.lit(OPEN), F.col("role"), F.lit("\n"), F.col("text"), F.lit(CLOSE + "\n"))
    return prefix.join(maximal(prefix), "conv_id").select("conv_id", F.col("place").cast("long").alias("place"), F.col("n_turns").cast("long").alias("n_turns"), "n_copies", "role", body.alias("rendered"))
