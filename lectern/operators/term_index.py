"""Postings written by term, with a dictionary of the terms.

A search reads the dictionary and the buckets its terms lie in. A bucket is a directory, so others are pruned before a file is
opened; inside a file, rows are sorted by term, so that row groups can be skipped. A term with more postings than
``run_rows`` is dealt by chunk over as many buckets as it needs, so neither a write nor a read holds one term in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import freed
from .scans import broadcast_small

RUN_ROWS = 4_000_000  # postings of a bucket, about, and the most of one term in one bucket
TASK_ROWS = 1_000_000  # postings that one task writes, about
MIN_BUCKETS = 64
PASS_ROWS = 8_000_000  # postings that are moved to their buckets at once, about
MAX_PASSES = 4  # over the postings, which each of them reads again
MAX_BUCKETS = 4_096  # directories of an index; beyond it buckets grow, and each is written by several tasks
FILES = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#chunk_id": "false"}


def _slices(df: Column, buckets: int, run_rows: int) -> Column:
    return F.least(F.ceil(df / run_rows), F.lit(buckets)).cast("int")


def _slice(slices: Column) -> Column:
    """By the id without its last two characters, so that chunks of a file stay together and their ids are written as differences."""
    return F.pmod(F.xxhash64(F.expr("substring(chunk_id, 1, length(chunk_id) - 2)")), slices)


def _passes(rows: int) -> int:
    return min(MAX_PASSES, max(1, math.ceil(rows / PASS_ROWS)))


def pass_of(number: Column, passes: int) -> Column:
    return F.pmod(number, F.lit(passes))


def passes_for(gains: DataFrame) -> int:
    """Passes in which the postings of the matched terms are moved."""
    return _passes(gains.select("field", "term", "df").distinct().agg(F.sum("df")).first()[0] or 0)


def build_dictionary(postings: DataFrame, buckets: int, run_rows: int = RUN_ROWS) -> DataFrame:
    """LEX-1: (field, term, df, bucket, slices, buckets): the postings of a term lie in ``slices`` buckets from ``bucket`` on, round ``buckets``."""
    return postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df")).select(
        "field", "term", "df",
        F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"),
        _slices(F.col("df"), buckets, run_rows).alias("slices"),
        F.lit(buckets).alias("buckets"),
    )


def write_dictionary(postings: DataFrame, root: str, *, run_rows: int = RUN_ROWS, min_buckets: int = MIN_BUCKETS) -> int:
    """Write ``root/dictionary`` alone, all that expansions and document frequencies need; returns the number of postings.

    ``postings`` is read twice: for its size and its terms.
    """
    total = postings.count()
    buckets = min(MAX_BUCKETS, max(min_buckets, math.ceil(total / run_rows)))
    build_dictionary(postings, buckets, run_rows).sort("term", "field").write.mode("overwrite").parquet(f"{root}/dictionary")
    return total


def write_term_index(postings: DataFrame, root: str, *, run_rows: int = RUN_ROWS, min_buckets: int = MIN_BUCKETS) -> None:
    """Write ``root/dictionary`` and ``root/postings`` (directories ``bucket=``). A repeated run replaces both; readers
    are moved to a new ``root`` once it is whole.

    ``postings`` is read for its size, its terms and once for each of at most ``MAX_PASSES`` passes, which move the postings of some
    of the buckets each: what is on the way at once is a share of the index. Pass a written table or a checkpoint if it is costly.
    Most of a posting is its chunk's id, which no other posting of the term has: the files write ids as differences to the one before.
    """
    spark = postings.sparkSession
    total = write_dictionary(postings, root, run_rows=run_rows, min_buckets=min_buckets)
    buckets = min(MAX_BUCKETS, max(min_buckets, math.ceil(total / run_rows)))
    dictionary = read_dictionary(spark, root)
    hot = broadcast_small(dictionary.where("slices > 1").select("field", "term", "slices"))
    first, slice_ = F.pmod(F.xxhash64("term"), F.lit(buckets)), _slice(F.coalesce("slices", F.lit(1)))
    parts = max(1, math.ceil(total / buckets / TASK_ROWS))  # tasks that write a bucket
    passes = min(_passes(total), buckets)
    cores = spark.sparkContext.defaultParallelism
    tasks = min(math.ceil(buckets / passes) * parts, max(cores, math.ceil(total / passes / TASK_ROWS)))  # a task may write many small buckets
    placed = postings.join(hot, ["field", "term"], "left").select(
        *postings.columns, F.pmod(first + slice_, F.lit(buckets)).cast("int").alias("bucket"), F.pmod(F.xxhash64("chunk_id", "term"), F.lit(parts)).alias("part")
    )
    for i in range(passes):
        some = placed.where(pass_of(F.col("bucket"), passes) == i) if passes > 1 else placed
        rows = some.repartition(tasks, "bucket", "part").sortWithinPartitions("bucket", "field", "term", "chunk_id").drop("part")
        with freed(spark):
            rows.write.mode("append" if i else "overwrite").options(**FILES).partitionBy("bucket").parquet(f"{root}/postings")


def read_dictionary(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("field string, term string, df bigint, bucket int, slices int, buckets int").parquet(f"{root}/dictionary")


def read_postings(spark: SparkSession, root: str) -> DataFrame:
    """(field, term, chunk_id, tf, len, bucket)."""
    return spark.read.schema("field string, term string, chunk_id string, tf int, len int, bucket int").parquet(f"{root}/postings")


def buckets_of(terms: DataFrame) -> list[int]:
    """Numbers of the buckets that dictionary rows name: at most ``MAX_BUCKETS`` integers come to the driver."""
    at = terms.select(F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("i"), "bucket", "buckets")
    return sorted(r.b for r in at.select(F.pmod(F.col("bucket") + F.col("i"), F.col("buckets")).alias("b")).distinct().collect())


def in_buckets(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings in the buckets of the terms; the other directories are pruned."""
    return postings.where(F.col("bucket").isin(buckets_of(terms))).drop("bucket")
