import random

import pytest
from pyspark.sql import functions as F

from lectern.operators.scans import prefix_scan, small_enough, top_k


@pytest.mark.parametrize("partitions", [1, 8])
def test_prefix_scan_equals_a_loop_for_a_group_with_most_rows(spark, partitions):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", i, rng.randrange(10), rng.choice([None, i])) for i in range(600)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o int, x int, m int").repartition(partitions)
    out = prefix_scan(df, ["k"], ["o"], rank="rn", sums={"total": F.col("x")}, lasts={"prev": F.col("m")}, hot_rows=50).collect()
    assert len(out) == len(rows)
    for key in {r[0] for r in rows}:
        total, last = 0, None
        for n, want in enumerate(sorted(r for r in rows if r[0] == key), 1):
            got = next(r for r in out if r.o == want[1])
            total += want[2]
            assert (got.rn, got.total, got.prev) == (n, total, last)
            last = want[3] if want[3] is not None else last


def test_top_k_limits_inside_the_tasks(spark):
    df = spark.range(5000).select(F.floor(F.col("id") / 100_000).alias("k"), "id").repartition(8)
    for k in (3, 4000):  # below and above Spark's own threshold for the early limit
        out = top_k(df, ["k"], [F.desc("id")], k)
        assert sorted((r["rank"], r.id) for r in out.collect()) == [(i, 5000 - i) for i in range(1, k + 1)]
        assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_many_hot_groups(spark):
    df = spark.range(60_000).select((F.col("id") % 1_200).alias("k"), F.xxhash64("id").alias("o"), F.lit(1).alias("x"))
    out = prefix_scan(df, ["k"], ["o"], rank="rn", hot_rows=20)
    assert out.groupBy("k").agg(F.countDistinct("rn").alias("d"), F.max("rn").alias("m")).where("d <> 50 or m <> 50").count() == 0


def test_top_k_over_many_tasks(spark):
    df = spark.range(0, 20_000, 1, 97).select(F.lit(1).alias("k"), F.col("id"))
    assert [r.id for r in top_k(df, ["k"], [F.desc("id")], 1_500).orderBy("rank").collect()] == list(range(19_999, 18_499, -1))


def test_broadcasts_are_bounded_in_bytes(spark):
    df = spark.range(100).select(F.repeat(F.lit("x"), 1000).alias("t"))
    assert small_enough(df, 100) and not small_enough(df, 99) and not small_enough(df, 100, 50_000)
