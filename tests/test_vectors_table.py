import json
import os
import uuid

from lectern.plans.vectors import in_use, read_vectors, update_vectors, vectors_of

CHUNKS = "file_hash string, chunk_id string, content string"


def counting(folder, bad=()):
    """An embedder that leaves a note of the texts it was asked for; refuses some."""

    def fn(texts):
        if any(t in bad for t in texts):
            raise ValueError("refused")
        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            json.dump(texts, f)
        return [[float(len(t)), float(sum(map(ord, t)) % 97), 1.0] for t in texts]

    return fn


def asked(folder):
    return sorted(t for name in os.listdir(folder) for t in json.load(open(os.path.join(folder, name))))


def run(spark, tmp_path, rows, model, batch, bad=()):
    folder = str(tmp_path / f"asked-{uuid.uuid4().hex}")
    os.makedirs(folder)
    chunks = spark.createDataFrame(rows, CHUNKS)
    root = str(tmp_path / "vectors")
    update_vectors(spark, root, chunks, model, counting(folder, bad), batch)
    live = {r.chunk_id: [round(x, 5) for x in r.vec] for r in vectors_of(chunks, read_vectors(spark, root, model)).collect()}
    fresh = str(tmp_path / f"fresh-{uuid.uuid4().hex}")
    update_vectors(spark, fresh, chunks, model, counting(str(tmp_path), bad), 1)
    want = {r.chunk_id: [round(x, 5) for x in r.vec] for r in vectors_of(chunks, read_vectors(spark, fresh, model)).collect()}
    assert live == want
    return asked(folder), sorted(live)


def test_only_unseen_texts_are_embedded(spark, tmp_path):
    first = [("a", "a:0", "one"), ("a", "a:1", "two"), ("b", "b:0", "one"), ("c", "c:0", "three"), ("d", "d:0", None), ("d", "d:1", "")]
    assert run(spark, tmp_path, first, "7", 1) == (["", "one", "three", "two"], ["a:0", "a:1", "b:0", "c:0", "d:0", "d:1"])
    assert run(spark, tmp_path, first, "7", 2)[0] == []
    # cut anew: a chunk moved, one new, one gone; file c is away
    second = [("a", "a:0", "zero"), ("a", "a:1", "one"), ("b", "b:0", "one"), ("d", "d:0", "two")]
    assert run(spark, tmp_path, second, "7", 3) == (["zero"], ["a:0", "a:1", "b:0", "d:0"])
    assert run(spark, tmp_path, second, "7", 3)[0] == ["zero"]  # the batch repeated
    assert run(spark, tmp_path, second + [("c", "c:0", "three")], "7", 4)[0] == []  # content that came back
    assert run(spark, tmp_path, second, "8", 5)[0] == ["one", "two", "zero"]  # another model
    assert run(spark, tmp_path, first, "7", 6)[0] == [] and read_vectors(spark, str(tmp_path / "vectors"), "8").count() == 4


def test_a_failed_text_voids_its_file_until_a_later_run(spark, tmp_path):
    rows = [("a", "a:0", "good"), ("a", "a:1", "bad"), ("b", "b:0", "good")]
    assert run(spark, tmp_path, rows, "m", 1, bad=["bad"]) == (["good"], ["b:0"])
    root = str(tmp_path / "vectors")
    assert [(r.file_hash, r.error) for r in read_vectors(spark, root, "m").where("error is not null").collect()] == [("a", "refused")]
    assert run(spark, tmp_path, rows, "m", 2) == (["bad"], ["a:0", "a:1", "b:0"])


def test_no_chunks_and_partitions_of_models_in_use(spark, tmp_path):
    assert run(spark, tmp_path, [("a", "a:0", "x")], "m1", 1) == (["x"], ["a:0"])
    root = str(tmp_path / "vectors")
    update_vectors(spark, root, spark.createDataFrame([], CHUNKS), "m1", counting(str(tmp_path)), 2)
    update_vectors(spark, root, spark.createDataFrame([("a", "a:0", "x")], CHUNKS), "m2", counting(str(tmp_path)), 3)
    models = spark.createDataFrame([("m1", 3), ("m2", 0)], "model_id string, notebooks int").where("notebooks > 0")
    raw = spark.read.parquet(root)
    assert "dynamicpruning" in in_use(raw, models)._jdf.queryExecution().toString().lower()
    assert [r.model_id for r in in_use(read_vectors(spark, root), models).collect()] == ["m1"]
