"""The pipeline against plain rules, stage by stage, over nulls, ties, repeated rows, long texts and clashing column names."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from lectern.llm import packing, toxicity
from lectern.llm.base import held_out
from lectern.llm.shingles import shingle_sets
import pyarrow as pa
from pyspark.sql import functions as F

CLASH = ["_row", "_key", "_ROW_", "_doc", "key", "block", "shard", "kept", "n", "part", "a.b", "_id"]
SCHEMA = "doc_id bigint, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASH)


def _rows():
    rng = np.random.default_rng(11)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 3000, n)]
    texts = []
    for i in range(150):
        w = words(int(rng.integers(8, 60)))
        if i % 3 == 0:
            w[3] = "nastyword"
        texts.append(" ".join(w))
    family = words(80)
    near = [" ".join([*family[:-1], f"end{k}"]) for k in range(6)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(200 + i, t) for i, t in enumerate(near)]
    rows += [(300, texts[1]), (301, texts[1].replace(" ", "  ")), (302, texts[2]), (302, texts[2]), (0, texts[4]), (None, texts[5]), (None, "no id but a text of its own")]
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "a"), (403, "a"), (404, "é中文 " * 3), (405, " ".join(words(6000)))]
    sources = [None, "a", "b", "é"]
    return [(i, t, None, sources[n % 4], *[f"{c}{n}" for c in CLASH]) for n, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(_rows(), SCHEMA).repartition(3).write.parquet(f"{root}/documents.parquet")
    marks = [(i, int(i % 3 == 0)) for i in range(150)] + [(400, None), (None, 1), (1, 0)]
    spark.createDataFrame(marks, "doc_id bigint, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def _normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def _size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def _classes(rows):
    """Class number of each row: near-duplicate texts, transitively."""
    sets = [set(s.tolist()) for s in shingle_sets([r.text or "" for r in rows])]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or a and b and len(a & b) >= 0.8 * len(a | b):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def test_each_stage_against_plain_rules(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    given = Counter(map(tuple, docs.collect()))
    stages, outs = dict(corpus_pipeline.STAGES), {}
    model = toxicity.learn(docs, spark.read.parquet(f"{tables}/labels.parquet").where(~held_out(F.col("doc_id"))))
    assert list(stages) == ["toxicity", "exact_dedup", "near_duplicates", "mixing", "packing"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, tables).checkpoint() if i else stage(spark, docs, tables)
        if name != "packing":
            path = f"{tables}/out-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            assert docs.schema.simpleString() == spark.read.parquet(f"{tables}/documents.parquet").schema.simpleString()
        outs[name] = docs.collect()

    score = toxicity.Scorer(model)
    keep = [r for r in given.elements() if score([r[1] or ""])[0] < model.settings.threshold]
    assert Counter(map(tuple, outs["toxicity"])) == Counter(keep) and 60 < len(keep) < 150

    groups = defaultdict(list)
    for r in outs["toxicity"]:
        groups[_normal(r.text)].append(r)
    left = {_normal(r.text): r for r in outs["exact_dedup"]}
    assert len(left) == len(outs["exact_dedup"]) and set(left) == set(groups)
    for text, r in left.items():
        assert r in groups[text] and r.doc_id == min((x.doc_id for x in groups[text] if x.doc_id is not None), default=None)

    label, stay = _classes(outs["exact_dedup"]), outs["near_duplicates"]
    want = {c: min((r.doc_id for r, x in zip(outs["exact_dedup"], label) if x == c and r.doc_id is not None), default=None) for c in label}
    assert len(want) < len(label)
    assert sorted((r.doc_id for r in stay), key=repr) == sorted(want.values(), key=repr)
    assert not Counter(map(tuple, stay)) - Counter(map(tuple, outs["exact_dedup"]))

    sizes, taken, bodies = Counter(), Counter(), defaultdict(list)
    for r in stay:
        sizes[r.source] += _size(r.text)
        bodies[r._row].append(r)
    for r in outs["mixing"]:
        (whole,) = bodies[r._row]
        assert r.text == whole.text or whole.text.startswith(r.text)
        assert tuple(r)[4:] == tuple(whole)[4:]
        taken[r.source] += _size(r.text)
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= 2 and all(n <= 2 * sizes[s] for s, n in taken.items())

    ids_of = packing.WordIds(packing.default_tokenizer())
    ids = Counter((r.doc_id, len(x) // 2 + 1) for r, x in zip(outs["mixing"], ids_of([r.text or "" for r in outs["mixing"]])))
    assert Counter((r.doc_id, r.doc_tokens) for r in outs["packing"] if r.start == 0) == ids
    assert sum(r.length for r in outs["packing"]) == sum(n * k for (_, n), k in ids.items())
    ends = Counter()
    for r in outs["packing"]:
        ends[r.sequence_id] += r.length
    assert all(n == 4096 for s, n in ends.items() if s < len(ends) - 1)


def test_nothing_in_nothing_out(spark, tables, tmp_path):
    spark.read.parquet(f"{tables}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tables}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_packing_that_keeps_nothing_frees_its_workers(spark):
    from lectern.llm import packing

    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(64)], "doc_id long, text string").repartition(64)

    def held(batches):
        from lectern.llm import base

        for batch in batches:
            yield batch.to_pandas().assign(n=len(base._KEPT))[["n"]].pipe(pa.RecordBatch.from_pandas, preserve_index=False)

    want = sorted(tuple(r) for r in packing.pack(docs).select("doc_id", "start", "length", "ids").collect())
    packed = packing.pack(docs, keeps=False)
    assert sorted(tuple(r) for r in packed.select("doc_id", "start", "length", "ids").collect()) == want
    idle = spark.range(64).repartition(64).mapInArrow(held, "n long")
    assert {r.n for r in idle.collect()} == {0}
