"""Fill-in-middle: the boundary set against plain positions, the rows against plain string slicing, the exact round trip."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import fim

SCHEMA = "doc_id bigint, text string, n bigint, form string, output string, h1 string, raw int"


def rows_of(texts):
    return [(i, t, None, "f", "o", "h", 1) for i, t in enumerate(texts)]


@pytest.mark.parametrize("density", [0.0, 0.001, 0.05, 0.3, 0.5, 0.999, 1.0])
def test_select_is_the_nth_member(density):
    rng = np.random.default_rng(int(density * 1000))
    mask = rng.random(200_001) < density
    mask[[0, -1]] = True
    made, want = fim.BoundarySet(mask), np.flatnonzero(mask)
    assert len(made) == len(want)
    for m in {0, len(want) - 1, *rng.integers(0, len(want), 300).tolist()}:
        assert made.select(m) == want[m]


def test_each_container_form_is_chosen():
    every, third = np.ones(fim.SPAN, bool), np.zeros(fim.SPAN, bool)
    third[::3] = True
    few = np.zeros(fim.SPAN, bool)
    few[[5, 900, 40_000]] = True
    long_runs = every.copy()
    long_runs[[100, 5_000]] = False
    kinds = [type(fim.container(x)[0]) for x in (every, long_runs, third, few, np.zeros(10, bool))]
    assert kinds == [fim.Runs, fim.Runs, fim.Bitmap, fim.Array, fim.Array]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab \n\té漢🙂'"), max_size=60))
def test_units_are_what_they_are_called(text):
    raw = np.frombuffer(text.encode(), np.uint8)

    def cut(unit):
        at = np.flatnonzero(fim.unit_starts(raw, unit)).tolist()
        return [text.encode()[a:b].decode() for a, b in zip(at, at[1:])]

    assert cut("char") == list(text)
    assert cut("line") == text.splitlines(keepends=True)
    words = cut("word")
    assert "".join(words) == text and sum(bool(w.strip()) for w in words) == len(text.split())


def plain(doc_id, text, how):
    h = hashlib.sha256(f"{how.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    text = text or ""
    n = len(text)
    if not text or any(x in text for x in (how.prefix, how.suffix, how.middle)) or h[2] % 100 >= how.fim_percent:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < how.spm_percent:
        return n, "spm", a, b - a, how.suffix + s + how.prefix + p + how.middle + m
    return n, "psm", a, b - a, how.prefix + p + how.suffix + s + how.middle + m


@pytest.mark.parametrize("how", [fim.Fim(), fim.Fim(seed=7, spm_percent=60, prefix="<|fim_prefix|>", suffix="<|fim_suffix|>", middle="<|fim_middle|>")])
def test_rows_equal_string_slicing(spark, how):
    rng = np.random.default_rng(3)
    texts = [None, "", " ", "<P>", "a<S>b", "<<P", "é漢🙂" * 40, "x" * 70_000, "漢" * 70_000, "\n" * 5, "ab\r\n<M"]
    texts += ["".join(rng.choice(list("abc é漢🙂\n<>PSM"), int(rng.integers(1, 80)))) for _ in range(200)]
    rows = rows_of(texts) + [(3, "twice", None, "f", "o", "h", 1), (3, "twice", None, "f", "o", "h", 1), (None, "no id", None, "f", "o", "h", 1)]
    made = fim.fill_in_middle(spark.createDataFrame(rows, SCHEMA).repartition(3), how)
    got = made.select("*", fim.restored(F.col("output"), F.col("form"), how).alias("back")).collect()
    want = sorted((repr((r[0], *plain(r[0], r[1], how), r[1] or "")) for r in rows))
    assert sorted(repr(tuple(r)) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("unit", ["word", "line"])
def test_other_units_cut_at_their_starts(spark, unit):
    text = "One two\nthree  vier fünf\n\nsechs 漢字 acht\n"
    how = fim.Fim(fim_percent=100, spm_percent=50, unit=unit)
    made = fim.fill_in_middle(spark.createDataFrame([(i, text) for i in range(200)], "doc_id bigint, text string"), how)
    starts = {len(text.encode()[:b].decode()) for b in np.flatnonzero(fim.unit_starts(np.frombuffer(text.encode(), np.uint8), unit))}
    rows = made.select("*", fim.restored(F.col("output"), F.col("form"), how).alias("back")).collect()
    assert {r.prefix_chars for r in rows} | {r.prefix_chars + r.middle_chars for r in rows} == starts
    assert all(r.back == text and r.n == len(starts) - 1 for r in rows)


def test_no_rows(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], SCHEMA)).count() == 0
