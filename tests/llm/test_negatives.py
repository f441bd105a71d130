"""Hard negatives against plain nested loops on small tables with ties, odd rows, hot labels and several rounds."""

import math

import numpy as np
import pytest

from lectern.llm import negatives
from lectern.llm.negatives import Mining

SCHEMA = "vec_id bigint, embedding array<float>, label int, a string, score string, kind int, id string, v int, x int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "s", 1, "i", 2, 3) for r in rows], SCHEMA).repartition(4)


def plain(rows, anchor_of, how):
    ok = [(i, l, [math.floor(how.scale * float(np.float32(c))) for c in v]) for i, v, l in rows if None not in (i, v, l) and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for i, l, v in ok:
        if not anchor_of(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m == l) for j, m, w in ok if j != i)
        for ps, p, _ in [s for s in scored if s[2]][: how.positives]:
            near = [(s, j) for s, j, same in scored if not same and how.low * -ps <= 100 * -s <= how.high * -ps]
            out += [(i, p, n + 1, j, -ps, -s) for n, (s, j) in enumerate(near[: how.negatives])]
    return sorted(out)


def mined(spark, rows, anchor_of, how=Mining()):
    use = negatives.usable(frame(spark, rows), how)
    return sorted(tuple(r) for r in negatives.mine(use, use.where(anchor_of), how).collect())


def vectors(n, seed, dim=8, labels=3, coarse=None):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)) if coarse is None else rng.integers(-coarse, coarse + 1, (n, dim)) / 4
    hot = rng.random(n) < 0.4
    return [(i, [float(c) for c in v[i]], 1 if hot[i] else int(rng.integers(0, labels))) for i in range(n)]


ODD = [
    (None, [1.0] * 8, 1), (1001, None, 1), (1002, [1.0, None] * 4, 1), (1003, [float("nan")] + [1.0] * 7, 1), (1004, [float("inf")] * 8, 2), (1005, [1.0] * 8, None),
    (1010, [], 1), (1020, [0.5, 0.5], 1), (1030, [0.5] * 12, 2), (1040, [-1.0] * 8, 77), (1050, [0.0] * 8, 2), (-10, [0.3] * 8, 1),
]


@pytest.mark.parametrize("how", [Mining(), Mining(positives=2, negatives=3, low=50, high=95, scale=16)])
def test_equals_nested_loops(spark, how):
    rows = vectors(300, 1) + ODD
    assert mined(spark, rows, "id % 10 = 0", how) == plain(rows, lambda i: i % 10 == 0, how) != []


def test_ties_everywhere(spark):
    rows = vectors(200, 2, dim=2, coarse=2)
    assert mined(spark, rows, "id % 7 = 0") == plain(rows, lambda i: i % 7 == 0, Mining())


def test_one_text_for_all_and_small_pieces(spark, monkeypatch):
    rows = [(i, [0.5, 0.25], i % 3) for i in range(400)]
    monkeypatch.setattr(negatives, "CELLS", 500)
    monkeypatch.setattr(negatives, "KEPT_ROWS", 100)
    assert mined(spark, rows, "id % 50 = 0") == plain(rows, lambda i: i % 50 == 0, Mining())


def test_rounds_change_nothing(spark, monkeypatch):
    rows = vectors(300, 3) + ODD
    monkeypatch.setattr(negatives, "ROUND_BYTES", 1_500)
    assert mined(spark, rows, "id % 10 = 0") == plain(rows, lambda i: i % 10 == 0, Mining())


def test_rows_that_repeat(spark):
    rows = vectors(60, 4)
    rows += [rows[10], rows[10], rows[33]]
    got = mined(spark, rows, "id = 20")
    assert got == plain(rows, lambda i: i == 20, Mining())
    twice = mined(spark, rows, "id = 10")
    once = plain([r for r in rows if r[0] != 10] + [rows[10]], lambda i: i == 10, Mining())
    assert twice == sorted(once * 3)


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=3) * 1e5], int(rng.integers(0, 2))) for i in range(120)]
    assert mined(spark, rows, "id % 6 = 0") == plain(rows, lambda i: i % 6 == 0, Mining())
    with pytest.raises(ValueError):
        mined(spark, [(0, [1e30], 1), (1, [1e30], 2)], "id = 0")


@pytest.mark.parametrize("largest,dim,want", [(100, 64, "float32"), (1 << 20, 64, "float64"), (1 << 28, 64, "int64"), (0, 0, "float32")])
def test_smallest_exact_type(largest, dim, want):
    assert negatives.exact_type(largest, dim) == want


def test_no_rows_no_anchors(spark):
    assert mined(spark, [], "id = 1") == []
    assert mined(spark, vectors(20, 5), "id < 0") == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 2)], "id = 0") == []


def test_pairs_are_sorted_within_partitions(spark):
    rows = negatives.usable(frame(spark, vectors(100, 8)))
    plan = negatives.mine(rows, rows.where("id % 10 = 0"))._jdf.queryExecution().toString()
    assert "hashpartitioning(a" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
