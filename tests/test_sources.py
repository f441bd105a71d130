import os

from pyspark.sql import functions as F

from lectern import schemas, sources
from lectern.functions import scope
from lectern.operators import conversations, diff
from lectern.plans.index import apply_batch
from lectern.schemas import CONTENT, LONG, PATHS, TEXT, table

SCHEMA = table(a=LONG, b=TEXT)


def test_log_skips_bad_lines_and_missing_log_is_empty(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"a":1,"b":"x"}\n\n{"a":2}\n{"a":3,"b"')
    assert sorted(r.a for r in sources.read_log(spark, str(path), SCHEMA).collect()) == [1, 2]
    assert sources.read_log(spark, str(tmp_path / "none"), SCHEMA).count() == 0


def test_docs(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "1.json").write_text('{\n "a": 1,\n "b": "t"\n}')
    (tmp_path / "2.json").write_text("{broken")
    assert [(r.a, r.b) for r in sources.read_docs(spark, str(tmp_path), SCHEMA).collect()] == [(1, "t")]
    assert sources.read_docs(spark, str(tmp_path / "none"), SCHEMA).count() == 0


def test_scan_lists_in_scope_files_and_reads_only_changed_ones(spark, tmp_path):
    for name, body in {"notes/a.md": "one", "notes/B.MD": "﻿two", "notes/.x/c.md": "no", "notes/d.txt": "no", "other/e.md": "no"}.items():
        full = tmp_path / name
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_text(body, encoding="utf-8")
    nb = scope.Notebook("n", (scope.Source("s", "notes"),))
    files = sources.scan_files(spark, str(tmp_path), nb)
    assert {r.file_path for r in files.collect()} == {"notes/a.md", "notes/B.MD"}
    texts = sources.read_contents(files.filter(F.col("file_path") == "notes/B.MD")).collect()
    assert [(r.file_path, r.text) for r in texts] == [("notes/B.MD", "two")]


def test_contents_of_odd_names_and_lost_files(spark, tmp_path):
    names = ["[draft] x.md", "a b%20c.md", "t{1,2}.txt", "ü*?.md"]
    for n in names:
        (tmp_path / n).write_text(f"in {n}", encoding="utf-8")
    files = sources.scan_files(spark, str(tmp_path), exts=("md", "txt")).cache()
    assert {r.file_path for r in files.collect()} == set(names)
    (tmp_path / names[1]).unlink()
    got = {r.file_path: r for r in sources.read_contents(files).collect()}
    assert {n: r.text for n, r in got.items()} == {n: None if n == names[1] else f"in {n}" for n in names}
    assert got[names[1]].error and got[names[0]].error is None


def snapshot(spark, files):
    rows = [(p, m, t) for p, (m, t) in files.items()]
    return spark.createDataFrame(rows, "file_path string, source_mtime long, text string").select(
        "file_path", F.sha2("text", 256).alias("file_hash"), "source_mtime", F.octet_length("text").cast("bigint").alias("file_size"), "text"
    )


def alive(spark, root):
    paths = diff.latest(spark.read.schema(PATHS).parquet(f"{root}/paths"), "file_path")
    content = diff.latest(spark.read.schema(CONTENT).parquet(f"{root}/content"), "file_hash")
    return {r.file_path: r.file_hash for r in paths.collect()}, {r.file_hash for r in content.collect()}


def test_incremental_runs_end_where_a_full_run_does_and_may_repeat(spark, tmp_path):
    first = {f"n/{i:02}.md": (1, f"# F{i}\n\ntag-{i % 5} body {i}") for i in range(30)}
    second = dict(first)
    for i in range(5):
        second[f"n/{i:02}.md"] = (2, f"edited {i}")
    for i in (5, 6):
        second[f"moved/{i}.md"] = second.pop(f"n/{i:02}.md")
    for i in (7, 8, 9):
        del second[f"n/{i:02}.md"]
    second["dup/a.md"] = second["dup/b.md"] = (3, first["n/10.md"][1])
    second["n/blank.md"] = (1, "  \n")
    root = str(tmp_path / "index")
    apply_batch(spark, root, snapshot(spark, first), 0, 0)
    for _ in range(2):  # the second time as after a failure
        apply_batch(spark, root, snapshot(spark, second), 1, 1)
        paths, content = alive(spark, root)
        want = {r.file_path: r.file_hash for r in snapshot(spark, second).collect()}
        assert paths == want and content == set(want.values())
    chunks = spark.read.parquet(f"{root}/chunks")
    assert chunks.select("chunk_id").distinct().count() == chunks.count()
    assert os.path.isdir(f"{root}/paths/batch=1")


def test_failed_files_write_no_path(spark):
    products = [("a", "h1", "h1", "ok"), ("b", "h2", "other", "ok"), ("c", "h3", "h3", "error"), ("d", "h4", None, "transient"), ("e", "h5", "h5", "skipped")]
    df = spark.createDataFrame([(*p, 1, 2, None) for p in products], "file_path string, expected_hash string, file_hash string, outcome string, file_size long, parser_version long, error_message string")
    changes = df.select(F.lit("NEW_PATH").alias("classification"), "file_path", F.lit(None).cast("string").alias("old_path"), F.lit(None).cast("string").alias("old_hash"),
                        F.col("expected_hash").alias("new_hash"), F.lit(1).cast("bigint").alias("source_mtime"), "file_size")
    none_p, none_c = spark.createDataFrame([], PATHS), spark.createDataFrame([], CONTENT)
    out = diff.apply_changes(none_p, none_c, changes, df, seq=1, now=1)
    assert {r.file_path for r in out["paths"].collect()} == {"a", "e"}
    assert {(r.file_hash, r.status) for r in out["content"].collect()} == {("h1", "ok"), ("h3", "error"), ("h5", "skipped")}
    assert {(r.file_path, r.error_class) for r in out["errors"].collect()} == {("b", "race"), ("c", "persistent"), ("d", "transient")}


def test_stream_frames_and_names(spark):
    frames = [("r", 1, 'data: {"choices":[{"delta":{"content":"he"}}]}'), ("r", 2, "data: {bad"), ("r", 3, ': ping\ndata: {"choices":[{"delta":{"content":"y"}}],"usage":{"total_tokens":1}}'), ("r", 4, 'data: {"usage":{"total_tokens":9}}\ndata: [DONE]')]
    row = conversations.assemble_stream(spark.createDataFrame(frames, "response_id string, seq int, block string")).first()
    assert (row.content, row.done, row.total_tokens) == ("hey", True, 9)
    names = spark.createDataFrame([("a.md", 1), ("a.md", 2), ("b.md", 3)], "name string, o int")
    taken = spark.createDataFrame([("a.md",), ("a (3).md",)], "name string")
    assert {(r.o, r.unique_name) for r in conversations.dedupe_names(names, taken, "o").collect()} == {(1, "a (2).md"), (2, "a (4).md"), (3, "b.md")}
    assert schemas.CHUNKS["locator"].dataType == schemas.LOCATOR


def test_compaction_keeps_the_latest_and_the_old_version(spark, tmp_path):
    log = spark.createDataFrame([("a", "h1", 1, False), ("a", "h2", 2, False), ("b", "h3", 1, False), ("b", "h3", 3, True)], "file_path string, file_hash string, seq long, tombstone boolean")
    first = sources.write_version(log, str(tmp_path), 1)
    second = sources.write_version(sources.compact(spark.read.schema(log.schema).parquet(first), "file_path"), str(tmp_path), 2)
    assert [(r.file_path, r.file_hash) for r in spark.read.schema(log.schema).parquet(second).collect()] == [("a", "h2")]
    assert spark.read.schema(log.schema).parquet(first).count() == 4


def test_compaction_changes_no_state(spark, tmp_path):
    from lectern.plans import index

    root = str(tmp_path)
    for batch, files in enumerate([{"a.md": (1, "one"), "b.md": (1, "two")}, {"a.md": (2, "three")}, {"a.md": (2, "three"), "b.md": (3, "two")}]):
        index.apply_batch(spark, root, snapshot(spark, files), batch, batch)
        if batch == 1:
            before = alive(spark, root)
            assert not index.compact_state(spark, root, "paths", 1)
            assert index.compact_state(spark, root, "paths", 1, force=True) and index.compact_state(spark, root, "content", 1, force=True)
            assert not index.compact_state(spark, root, "paths", 1, force=True)
            assert {r.file_path for r in index._state(spark, f"{root}/paths", PATHS, "file_path", 2).collect()} == {"a.md"}
            assert before == alive(spark, root)
    state = index._state(spark, f"{root}/paths", PATHS, "file_path", 3)
    assert {(r.file_path, r.file_hash) for r in state.collect()} == {(r.file_path, r.file_hash) for r in diff.latest(spark.read.schema(PATHS).parquet(f"{root}/paths"), "file_path").collect()}
    texts = sorted(r.content for r in index.live(spark, root, "chunks").collect())
    assert texts == ["three", "two"]


def test_index_report(spark):
    from lectern.operators.stats import index_report
    from lectern.plans import index

    files = snapshot(spark, {"a.md": (1, "one"), "b.md": (1, "  ")})
    empty = {n: spark.createDataFrame([], s) for n, s in (("paths", PATHS), ("content", CONTENT))}
    run = index.index_snapshot(empty["paths"], empty["content"], files.withColumn("text", F.when(F.col("file_path") == "a.md", F.col("text"))), seq=1, now=1)
    assert {(r.item, r.name, r.n) for r in index_report(run, 5, 12).collect()} == {("files", "NEW_PATH", 2), ("errors", "persistent", 1), ("chunks", "all", 1), ("milliseconds", "all", 7)}
