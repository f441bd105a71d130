"""Token counts: the compiled transducers against the tokenizer itself, the scan against a plain walk."""

import json
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm import token_counts as tc

PATH = tc.default_tokenizer()
PIECES = [*"abcdefgrstvlmnoLEVR0189 \n\t'!?.,-_=", "é", "漢", "字", "\U0001f642", "١", "²", "　", "\x85", "İ", "́", "​", "﻿", "'s", "'re", "'ll", "'ve", "  ", "\r\n", "<|endoftext|>", "<|endof", "the ", "tion"]


@lru_cache(1)
def tokenizer():
    return Tokenizer.from_file(PATH)


@lru_cache(1)
def counter():
    return tc.TokenCounter(PATH)


def by_library(texts):
    return [len(e.ids) for e in tokenizer().encode_batch(texts, add_special_tokens=False)]


def ours(texts):
    return counter().counts([t.encode() for t in texts])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=40).map("".join), max_size=5))
def test_counts_equal_the_tokenizer(texts):
    assert ours(texts) == by_library(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(texts):
    assert ours(texts) == by_library(texts)


def test_every_token_alone_and_beside_another():
    vocabulary = json.load(open(PATH, encoding="utf-8"))["model"]["vocab"]
    tokens = [t for t in (tokenizer().decode([i]) for i in list(vocabulary.values())[::7]) if "�" not in t]
    texts = [a + b for a, b in zip(tokens, tokens[1:] + tokens[:1])]
    assert ours(tokens) == by_library(tokens)
    assert ours(texts) == by_library(texts)


@pytest.mark.parametrize("text", ["a" * 5_000, "ab" * 3_000, "aaab" * 999 + "b", "=" * 4_321, " " * 3_000 + "x", "\n" * 777 + " y", "漢字" * 2_000, "Zx9Q" * 2_000])
def test_long_runs(text):
    assert ours([text]) == by_library([text])


def test_seams_are_what_bpe_keeps():
    merges = counter().counter.merges
    rng = np.random.default_rng(5)
    names = [tokenizer().id_to_token(i) for i in range(50_256)]
    of_name = {}
    for t in range(len(merges.parts)):
        of_name[t] = chr_of(merges, t)
    vocabulary = {n: i for i, n in enumerate(names)}
    plain = Tokenizer.from_str(json.dumps(json.load(open(PATH, encoding="utf-8")) | {"pre_tokenizer": None, "added_tokens": []}))
    kept = 0
    for a, b in rng.integers(0, 2_000, (3_000, 2)).tolist():
        same = plain.encode(of_name[a] + of_name[b]).ids == [vocabulary[of_name[a]], vocabulary[of_name[b]]]
        assert merges.keeps(a, b) == same
        kept += same
    assert 100 < kept < 2_990


def chr_of(merges, t):
    if merges.parts[t] is None:
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        return chr(t) if t in printable else chr(256 + sum(b not in printable for b in range(t)))
    return "".join(chr_of(merges, p) for p in merges.parts[t])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, len(tc.SYMBOLS) - 1), min_size=1, max_size=700))
def test_scan_equals_a_walk(symbols):
    state, starts = tc.FRESH, [False] * len(symbols)
    for i, a in enumerate(symbols):
        state, marks = tc._splitter(state, a)
        starts[i] |= bool(marks & tc.HERE)
        if marks & tc.BEFORE and i:
            starts[i - 1] = True
    assert tc.pre_token_starts(np.array(symbols, np.uint8)).tolist() == starts


def test_maps_of_chunks_compose():
    rng = np.random.default_rng(1)
    symbols = rng.choice([tc.LETTER, tc.NUMBER, tc.SKIP, tc.BLANK, tc.QUOTE, tc.R], (37, tc.CHUNK)).astype(np.uint8)
    whole = tc.scan(tc.chunk_maps(symbols))[-1]
    for q in tc.STATES:
        state = q
        for a in symbols.reshape(-1).tolist():
            state = tc._splitter(state, a)[0]
        assert whole[q] == state


def test_windows_and_forgetting_change_nothing(monkeypatch):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(PIECES, int(rng.integers(0, 400)))) for _ in range(300)]
    want = by_library(texts)
    monkeypatch.setattr(tc, "WINDOW_BYTES", 300)
    monkeypatch.setattr(tc, "MAX_STATES", 500)
    fresh = tc.TokenCounter(PATH)
    assert fresh.counts([t.encode() for t in texts]) == want
    assert len(fresh.counter.states) < 5_000


def test_other_tokenizers_are_refused():
    spec = json.load(open(PATH, encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"ignore_merges": True}}):
        with pytest.raises(ValueError):
            tc.Merges(spec | change)


def test_rows(spark):
    texts = [None, "", " ", "one two", "one two", "it's <|endoftext|> x", "漢字" * 50, "word " * 300_000]
    rows = [(i, t, None, 5, "h", 1) for i, t in enumerate(texts)] + [(None, "no id", None, 5, "h", 1), (3, "one two", None, 5, "h", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string, n_bytes int, h string, raw int").repartition(3)
    got = sorted(map(repr, (tuple(r) for r in tc.count_tokens(docs).collect())))
    want = by_library([r[1] or "" for r in rows])
    assert got == sorted(repr((r[0], len((r[1] or "").encode()), n)) for r, n in zip(rows, want))
    assert tc.count_tokens(docs.limit(0)).count() == 0
