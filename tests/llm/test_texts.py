"""Packing, mixing, exact and near duplicates, repeats, chat and fingerprints against brute force on small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import chat, dedup, fingerprint, mixing, near, packing, repeats
from lectern.llm.components import components
from lectern.llm.shingles import shingle_sets

EXTRA = ", lang string, source string, n_chars bigint, size string, block int, kept string, label string, path int, h int"


def table(spark, rows, extra=True):
    """(doc_id, text) rows with columns whose names clash with inner ones."""
    if not extra:
        return spark.createDataFrame(rows, "doc_id bigint, text string")
    return spark.createDataFrame([(i, t, None, f"s{(i or 0) % 3}", None, "x", 1, None, "l", 2, 3) for i, t in rows], "doc_id bigint, text string" + EXTRA).repartition(3)


def texts(n, seed, words=30, vocabulary=400):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{x}" for x in rng.integers(0, vocabulary, int(rng.integers(1, words)))) for _ in range(n)]


ODD = [(900, None), (901, ""), (902, " \t\n"), (903, "a"), (903, "a"), (None, "no id"), (904, "é中文 " * 3)]


# packing


def test_word_ids_equal_the_tokenizer():
    samples = ["The cat, sat.\nOn  it's 12 mats... don't!", "É́ x́ y", "<|endoftext|>a b<|startoftext|>", "", " ", "ÀB İi ΣΑΣ", "a.,b c.. d,", "x\x85y z\tq", "I'll we're 'S 's", "word." * 3, "中文 字"] + texts(20, 1)
    path = packing.default_tokenizer()
    assert packing.WordIds(path)(samples) == packing.WordIds(path, by_word=False)(samples)


@pytest.mark.parametrize("window", [1, 7, 64])
def test_pack_round_trip(spark, window):
    rows = [(i, t) for i, t in enumerate(texts(40, 2, 60))] + ODD
    got = packing.pack(table(spark, rows), window=window).collect()
    ids_of = packing.WordIds(packing.default_tokenizer())
    want = Counter((i, len(x) // 2 + 1, zlib.crc32(np.append(np.frombuffer(x, "<u2"), 2).astype("<u4").tobytes())) for (i, _), x in zip(rows, ids_of([t or "" for _, t in rows])))
    spans, documents = defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length and r.length >= 1
        spans[r.sequence_id].append((r.offset, r.length))
        documents[r.doc_id, r.sequence_id * window + r.offset - r.start].append(r)
    assert sorted(spans) == list(range(len(spans)))
    for s, pieces in spans.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == window or s == len(spans) - 1 and at <= window
    found = Counter()
    for (i, _), pieces in documents.items():
        pieces.sort(key=lambda r: r.start)
        ids = b"".join(bytes(r.ids) for r in pieces)
        assert [r.start for r in pieces] == list(np.cumsum([0] + [r.length for r in pieces[:-1]]))
        found[i, pieces[0].doc_tokens, zlib.crc32(ids)] += 1
    assert found == want


def test_workers_that_tokenize_get_small_batches(spark, monkeypatch):
    key, sizes, cut = "spark.sql.execution.arrow.maxBytesPerBatch", [], packing.cut_lineage
    before = spark.conf.get(key)
    monkeypatch.setattr(packing, "cut_lineage", lambda df: sizes.append(spark.conf.get(key)) or cut(df))
    monkeypatch.setattr(packing, "SENT_BYTES", 1_000)
    monkeypatch.setattr(packing, "SLICE_CHARS", 300)
    rows = [(i, "some words, " * (i % 40)) for i in range(200)]
    got = packing.pack(table(spark, rows, extra=False)).collect()
    assert sizes == ["1000"] and spark.conf.get(key) == before
    ids_of = packing.WordIds(packing.default_tokenizer())
    assert sorted((r.doc_id, r.doc_tokens) for r in got if r.start == 0) == [(i, len(ids_of([t])[0]) // 2 + 1) for i, t in rows]


def test_pack_with_empty_partitions(spark):
    docs = table(spark, [(i, "a b c") for i in range(20)])
    for some in (docs.where("doc_id = 3").repartition(9, "doc_id"), docs.repartition(1).union(docs.limit(0).repartition(5))):
        got = packing.pack(some, window=7).collect()
        assert sum(r.length for r in got) == 4 * len({r.doc_id for r in got})


def test_pack_nothing_and_padding(spark):
    assert packing.pack(table(spark, [(1, "a")]).limit(0)).count() == 0
    assert [packing.padding(n) for n in (4096, 2048, 1, 4095, 100)] == [0, 0, 0, 1, 3996]


# mixing


def _targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, left = {}, set(names), share * sum(sizes.values())
    while True:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > most * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over
        if not free:
            return out


def test_mix_against_plain_rules(spark):
    rng = np.random.default_rng(3)
    rows = [(i, t, [None, "a", "b", "é", "Z", "big"][min(5, int(rng.integers(0, 12)))]) for i, t in enumerate(texts(500, 4, 40))]
    rows += [(700, None, "a"), (701, "  ", "b"), (702, "", None), (703, "x y", "tiny"), (703, "x y", "tiny"), (704, "w " * 3000, "big")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("key", F.lit("clash")).withColumn("block", F.lit(1))
    mix = mixing.Mix(docs, mixing.Recipe(shard_words=500, blocks=16))
    got = mix.taken().collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, size(t)) for i, t, _ in rows)
    sizes, source = Counter(), {i: s for i, _, s in rows}
    for i, t, s in rows:
        sizes[s] += size(t)
    want, taken = _targets(dict(sizes)), Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    again = mixing.Mix(docs.repartition(5), mixing.Recipe(shard_words=500, blocks=16)).taken()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again.collect()), key=repr)
    rows_out = mix.mixed(docs)
    assert rows_out.columns == docs.columns
    per = Counter()
    for r in rows_out.collect():
        per[r.doc_id] += size(r.text)
    want_per = Counter()
    for r in got:
        want_per[r.doc_id] += r.taken
    assert +per == +want_per
    drawn = mix.draws.groupBy("shard").count().collect()
    assert max(r["count"] for r in drawn) - min(r["count"] for r in drawn) <= 1 and len(drawn) > 4
    assert mix.draws.groupBy("nth", "draw").count().where("count > 1").count() == 0


def test_hypergeometric_quantiles(spark):
    from math import comb

    rows = [(n, k, d, u / 20) for n, k, d in ((10, 4, 5), (7, 7, 3), (30, 2, 29), (1, 0, 1), (50, 25, 25)) for u in range(0, 20)]
    df = spark.createDataFrame(rows, "n bigint, k bigint, d bigint, u double")
    for r in df.withColumn("x", mixing.hypergeometric(F.col("n"), F.col("k"), F.col("d"), F.col("u"))).collect():
        total, cum = comb(r.n, r.d), 0
        for x in range(max(0, r.d - (r.n - r.k)), min(r.d, r.k) + 1):
            cum += comb(r.k, x) * comb(r.n - r.k, r.d - x)
            if cum >= r.u * total * (1 - 1e-12):
                break
        assert r.x == x, r


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id bigint, text string, source string")
    assert {r.taken for r in mixing.Mix(docs).taken().collect()} == {0}
    assert mixing.Mix(docs).mixed(docs).count() == 0
    assert mixing.Mix(docs.limit(0)).taken().count() == 0


def test_first_words(spark):
    df = spark.createDataFrame([(" a  b\tc \n", n) for n in range(4)], "t string, n int")
    got = [r.x for r in df.select(mixing.first_words(F.col("t"), F.col("n")).alias("x")).collect()]
    assert got == ["", " a", " a  b", " a  b\tc"]


# exact duplicates


def test_fuse_filter():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 10, 1000, 60_000):
        keys = rng.integers(0, 1 << 63, n).astype(np.uint64)
        f = dedup.FuseFilter.build(keys)
        assert f.has(keys).all()
        assert f.has(rng.integers(0, 1 << 63, 20_000).astype(np.uint64) | np.uint64(1 << 63)).mean() < 0.002
        assert f.table.nbytes <= 200 + 3 * n + 16 * f.segment


@pytest.mark.parametrize("split", [None, 20, -1, 10_000])
def test_exact_duplicates(spark, split):
    rows = [(i, t) for i, t in enumerate(texts(60, 6, 4, 4))] + ODD + [(5, "w1  w2"), (50, "w1\tw2")]
    docs = table(spark, rows)
    got = Counter(map(tuple, dedup.exact_duplicates(docs, None if split is None else F.col("doc_id") <= split).collect()))
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    want = Counter()
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        first = True
        for i in sorted(ids, key=lambda i: (i is None, i)):
            want[i, keep, len(ids), i == keep and first, hashlib.sha256(t.encode()).hexdigest()] += 1
            first = first and i != keep
    assert got == want
    kept = dedup.unique_rows(docs, None if split is None else F.col("doc_id") <= split)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert dedup.exact_duplicates(docs.limit(0), dedup.older_half(docs)).count() == 0


def test_exact_copies_without_an_id_of_a_snapshot_text(spark):
    rows = [(1, "a b"), (2, "c"), (3, "d"), (None, "a  b"), (None, "a b"), (None, "e"), (30, "d"), (40, "f"), (None, "f")]
    for snapshot in (F.col("doc_id") <= 10, F.col("doc_id").isNull(), F.col("text").isin("a  b", "e")):
        docs = table(spark, rows)
        got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in dedup.exact_duplicates(docs, snapshot).collect())
        assert got == Counter([(1, 1, 3, True), (None, 1, 3, False), (None, 1, 3, False), (2, 2, 1, True), (3, 3, 2, True), (30, 3, 2, False), (None, None, 1, True), (40, 40, 2, True), (None, 40, 2, False)])
        assert dedup.unique_rows(docs, snapshot).count() == 5


# near duplicates


def _families(seed):
    rng = np.random.default_rng(seed)
    rows, base = [], texts(12, seed, 160, 5000)
    for b in base:
        for _ in range(int(rng.integers(1, 9))):
            w = b.split()
            for j in rng.integers(0, len(w), int(rng.integers(0, 3))):
                w[j] = f"x{rng.integers(1000)}"
            rows.append(" ".join(w))
    passage = " ".join(f"p{i}" for i in range(30))
    rows += [f"{a} {passage}" for a in texts(150, seed + 1, 40, 5000)] + rows[:5]
    return list(enumerate(rows))


@pytest.mark.parametrize("paths", [near.Paths(), near.Paths(small=4, block=8, sample_block=8, sample=32)])
def test_near_duplicates(spark, paths):
    rows = _families(7) + [(i, t) for i, t in ODD if i != 902] + [(910, "one two"), (911, "one two"), (912, "b " * 5000)]
    got = near.near_duplicates(table(spark, rows), paths).collect()
    assert len(got) == len(rows)
    sets = {}
    for (i, _), s in zip(rows, shingle_sets([t or "" for _, t in rows])):
        sets.setdefault(s.tobytes(), (set(s.tolist()), []))[1].append(i)
    reps = [(min((i for i in ids if i is not None), default=None), s) for s, ids in sets.values()]
    named = [r for r in reps if r[0] is not None]
    linked = {i: [j for j, t in named if i != j and s and len(s & t) >= 0.8 * len(s | t)] for i, s in named}
    label = {i: i for i in linked}
    while any(label[j] > label[i] for i in linked for j in linked[i]):
        for i in linked:
            for j in linked[i]:
                label[j] = min(label[j], label[i])
    rep = {i: min(k for k in ids if k is not None) for _, ids in sets.values() for i in ids if i is not None}
    for r in got:
        if r.doc_id is None:
            assert r.class_id < 0 or r.class_id in label
        else:
            assert (r.rep_id, r.class_id, r.n_links) == (rep[r.doc_id], label[rep[r.doc_id]], len(linked[rep[r.doc_id]])), r
    assert sum(map(len, linked.values())) > 20
    docs = table(spark, rows)
    assert near.one_of_each(docs, paths).columns == docs.columns
    assert near.one_of_each(docs, paths).where("doc_id is not null").select("doc_id").distinct().count() == len({label[rep[i]] for i in rep})
    assert near.near_duplicates(docs.limit(0), paths).count() == 0


def test_near_copies_without_an_id_count(spark):
    words = [f"v{i}" for i in range(60)]
    near_copy = lambda k: " ".join(words[:-1] + [f"end{k}"])
    alone = lambda k: " ".join(f"u{i}" for i in range(40)) + f" end{k}"
    rows = [(7, " ".join(words)), (9, near_copy(1)), (None, near_copy(2)), (None, near_copy(2) + " "), (None, near_copy(3)), (None, alone(1)), (None, alone(2)), (1, "far away")]
    got = [(r.doc_id, r.class_id, r.n_links) for r in near.near_duplicates(table(spark, rows)).collect()]
    assert sorted((c, n) for i, c, n in got if i is None and c >= 0) == [(7, 3)] * 3
    assert {g for g in got if g[0] is not None} == {(7, 7, 3), (9, 7, 3), (1, 1, 0)}
    left = [(c, n) for i, c, n in got if i is None and c < 0]
    assert len(left) == 2 and len(set(left)) == 1 and left[0][1] == 1


def test_one_of_each_where_an_id_stands_on_two_texts(spark):
    family = lambda w, k: " ".join([f"{w}{i}" for i in range(60)] + [f"end{k}"])
    rows = [(20 + i, family("a", i)) for i in range(5)] + [(3, family("a", 9)), (3, "quite another text of some words"), (3, family("b", 1)), (4, family("b", 2)), (4, "one more text that is alone here")]
    rows += [(50, family("c", 1)), (50, family("c", 1) + " "), (51, family("c", 2)), (60, "twice the same"), (60, "twice the same"), (None, family("a", 20))]
    got = Counter((r.doc_id, r.text.split()[0][0], len(r.text.split())) for r in near.one_of_each(table(spark, rows)).collect())
    assert sum(n for (i, w, size), n in got.items() if size == 61 and w == "b") == 1
    assert got == Counter({(20, "a", 61): 1, (3, "q", 6): 1, (4, "o", 7): 1, (50, "c", 61): 1, (60, "t", 3): 1, (None, "a", 61): 1}) + Counter({k: n for k, n in got.items() if k[1] == "b"})


def test_sets_unlike_the_main_family_stay_in_all_buckets(spark):
    common = list(range(1, 97))
    rows = [(i, 96, common) for i in range(20)] + [(100 + i, 96, common[:24] + list(range(1000 * i + 1000, 1000 * i + 1072))) for i in range(4)]
    sets = spark.createDataFrame(rows, "id bigint, n bigint, sample array<int>")
    p = near.Paths(small=8, stays=1)
    large = Counter(r.id for r in near.leaves(sets, p).where("size > 8").collect())
    first = Counter(r.id for r in near.first_paths(sets, p).where(F.col("path").isin(common)).collect())
    assert [large[i] for i in range(20)] == [1] * 20
    assert sum(first[100 + i] for i in range(4)) > 8 and sum(large[100 + i] for i in range(4)) > 6


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 102), (101, 102), (7, 7), (200, 100)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in (100, 101, 102, 200)}


# repeats


def test_suffix_order():
    rng = np.random.default_rng(8)
    for trial in range(40):
        data = rng.integers(97, 97 + int(rng.integers(1, 5)), int(rng.integers(1, 300))).astype(np.uint8)
        if trial % 3 == 0:
            data = np.concatenate([data, data[: len(data) // 2], data])
        raw = data.tobytes()
        assert repeats.suffix_order(data, 1000).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


def _strip(rows, length):
    seen, out = set(), Counter()
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for a in range(len(raw) - length + 1):
            if raw[a : a + length] in seen:
                gone[a : a + length] = True
            seen.add(raw[a : a + length])
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[i, len(raw), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("p", [repeats.Repeats(20, 8), repeats.Repeats(20, 8, hot=3), repeats.Repeats(33, 32)])
def test_repeats(spark, p):
    rng = np.random.default_rng(9)
    line = "a line that many share"
    rows = [(i, f"{t} {line if i % 3 else ''} {t[:40]} {'ab' * int(rng.integers(0, 30))}") for i, t in enumerate(texts(60, 10, 20, 50))] + [(i + 100, rows_text) for i, rows_text in enumerate(texts(3, 10, 20, 50))] + ODD + [(905, "z" * 3000)]
    got = Counter(map(tuple, repeats.remove_repeats(table(spark, rows), p).collect()))
    assert got == _strip(rows, p.length)


def test_repeats_keep_the_bytes(spark):
    text = "0123456789" * 3
    got = {r.doc_id: bytes(r.kept) for r in repeats.remove_repeats(table(spark, [(1, text), (2, "x" + text + "y")]), repeats.Repeats(25, 8), with_text=True).collect()}
    assert got[2] == b"xy" and repeats.remove_repeats(table(spark, []).limit(0)).count() == 0


# chat


def test_chat_keeps_maximal_conversations(spark):
    a, b, c = ("user", "hi"), ("assistant", "yo"), ("user", "more")
    logs = {1: [a], 2: [a, b], 3: [a, b, c], 4: [a, b, c], 5: [b], 6: [a, c], 7: [("user", "h"), ("iassistant", "yo")], 8: [(None, None)]}
    rows = [(k, n, r, t, "x") for k, turns in logs.items() for n, (r, t) in enumerate(turns)] + [(None, 0, "user", "lost", "x"), (9, None, "user", "hi", "x"), (9, None, "user", "hi", "x")]
    got = chat.render(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, place string")).orderBy("conv_id", "place").collect()
    assert {r.conv_id for r in got} == {3, 5, 6, 7, 8, 9}
    assert [(r.place, r.n_turns, r.n_copies) for r in got if r.conv_id == 3] == [(1, 3, 2), (2, 3, 2), (3, 3, 2)]
    assert "".join(r.rendered for r in got if r.conv_id == 6) == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    assert [r.rendered for r in got if r.conv_id == 8] == ["<|im_start|>user\n<|im_end|>\n"]
    assert chat.render(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


# fingerprints




def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 2)
    rows = [(i * 7 % 101, t) for i, t in enumerate(texts(60, 11, 200, 3000))] + [(400, None), (401, ""), (402, "a"), (403, "a"), (404, "中" * 40), (405, "x" * 2000), (406, "a"), (None, "first")]
    got = fingerprint.compared(table(spark, rows)).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(rows)
    found = {r.doc_id: r for r in got}
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        assert found[i].n_chars == len(t) and found[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), i
        assert 0 <= found[i].near_edited <= 1 and 0 <= found[i].near_next <= 1
        if edited == t:
            assert found[i].near_edited == 1 and found[i].fingerprint == found[i].edited_fingerprint
    assert found[402].fingerprint == found[403].fingerprint and found[402].near_next == 1
    assert found[400].fingerprint == "" and found[400].near_next == 1
    long = [r for r in got if r.n_chars > 300 and r.doc_id is not None and r.doc_id < 101]
    assert all(0.3 < r.near_edited < 0.7 for r in long) and max(r.near_next for r in long) < 0.1
    assert fingerprint.compared(table(spark, rows).limit(0)).count() == 0


def test_syncmers_are_context_free(spark):
    body = " ".join(f"t{i}" for i in range(80))
    df = spark.createDataFrame([(body,), ("new words in front " + body,), (body + " and behind",)], "t string")
    one, two, three = [r.x for r in df.select(fingerprint.anchors(F.col("t")).alias("x")).collect()]
    assert one == three[: len(one)] and len(set(one) & set(two)) >= len(one) - 1


def test_syncmers_by_hand(spark):
    words = [f"t{i % 23}" for i in range(60)]
    k, s = fingerprint.K, fingerprint.S
    h = [r.h for r in spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").select("i", F.xxhash64("w").alias("h")).orderBy("i").collect()]
    pairs = spark.createDataFrame([(i, *h[i : i + s]) for i in range(len(h) - s + 1)], "i int, a bigint, b bigint").select("i", F.xxhash64("a", "b").alias("m")).orderBy("i").collect()
    m = [r.m for r in pairs]
    chosen = [i for i in range(len(h) - k + 1) if min(m[i : i + k - s + 1]) in (m[i], m[i + k - s])]
    gaps = [0] + [b - a for a, b in zip(chosen, chosen[1:])]
    want = [r.v for r in spark.createDataFrame([(n, h[i : i + k], g) for n, (i, g) in enumerate(zip(chosen, gaps))], "n int, a array<bigint>, g int").select("n", F.xxhash64("a", "g").alias("v")).orderBy("n").collect()]
    got = spark.createDataFrame([(" ".join(words),)], "t string").select(fingerprint.anchors(F.col("t")).alias("x")).first().x
    assert got == want


def test_words_are_remembered_within_bytes(monkeypatch):
    rng = np.random.default_rng(11)
    path = packing.default_tokenizer()
    texts_ = [" ".join("".join(rng.choice(list("abcdeé1.,"), int(rng.integers(1, 9)))) for _ in range(200)) for _ in range(60)]
    texts_ += ["x" * 2_000 + " y " + "Zé" * 1_000 + ". the cat, The cat."] * 3
    monkeypatch.setattr(packing, "CACHED_BYTES", 200_000)
    small = packing.WordIds(path)
    want = packing.WordIds(path, by_word=False)(texts_)
    assert [x for t in texts_ for x in small([t])] == want  # generations turn many times
    assert small.words.bytes <= 200_000 and len(small.words.old) + len(small.words.young) < 2_000
    assert small([" ".join("w" * 2_000 + str(i) for i in range(500))]) and max(map(len, small.words.young)) <= 64


def test_recent_keeps_what_comes_again():
    from lectern.llm.base import ENTRY_BYTES, Recent

    recent = Recent(20 * ENTRY_BYTES)
    for i in range(100):
        recent.turn()
        for w in recent.unknown(["often", f"w{i}"]):
            recent.put(w, i)
    assert recent.young["often"] == 0 and len(recent.young) + len(recent.old) < 30
