"""The tree source: its listings against plain differences, polls over a changing folder, and a batch that comes again."""

import os

from lectern.sources.tree import Shard, TreeReader, changes_between, watch
from lectern.streaming import changes


def test_differences():
    old = {"a": (1, 5), "b": (1, 6), "c": (2, 7), "x1": (3, 3), "x2": (3, 3), "same": (9, 9)}
    new = {"a": (2, 5), "b2": (1, 6), "y1": (3, 3), "n": (4, 4), "same": (9, 9)}
    assert sorted(changes_between(old, new), key=str) == sorted(
        [("a", None, "modify"), ("b2", "b", "rename"), ("c", None, "delete"), ("x1", None, "delete"), ("x2", None, "delete"), ("y1", None, "create"), ("n", None, "create")], key=str
    )
    assert list(changes_between(new, new)) == [] and list(changes_between({}, {})) == []


def write(root, files):
    for name, text in files.items():
        full = os.path.join(root, name)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w") as f:
            f.write(text)


def test_polls(spark, tmp_path):
    root = f"{tmp_path}/tree"
    write(root, {"top.md": "1", "n/a.md": "one", "n/b c.md": "two", "n/sub/é.md": "three", "m/d.md": "four"})

    def poll():
        stream = watch(spark, root, f"{tmp_path}/state", 4)
        changes.append_stream(stream, f"{tmp_path}/out", f"{tmp_path}/ckpt").awaitTermination()
        rows = {(r.path, r.old_path, r.kind) for r in spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect()}
        new, seen[:] = rows - set(seen), rows
        return new

    seen: list = []
    assert poll() == {(p, None, "create") for p in ("top.md", "n/a.md", "n/b c.md", "n/sub/é.md", "m/d.md")}
    write(root, {"n/a.md": "changed", "n/new.md": "5"})
    os.rename(f"{root}/n/b c.md", f"{root}/n/moved.md")
    os.remove(f"{root}/m/d.md")
    assert poll() == {("n/a.md", None, "modify"), ("n/new.md", None, "create"), ("n/moved.md", "n/b c.md", "rename"), ("m/d.md", None, "delete")}
    assert poll() == set()


def test_a_batch_that_comes_again_tells_the_same(tmp_path):
    root = f"{tmp_path}/tree"
    reader = TreeReader({"path": root, "state": f"{tmp_path}/state", "shards": "2"})
    write(root, {"a/1": "x", "b/2": "y"})
    first = [list(reader.read(Shard(k, 0, 10))) for k in range(2)]
    assert sorted(r[0] for s in first for r in s) == ["a/1", "b/2"]
    write(root, {"a/3": "z"})
    assert [list(reader.read(Shard(k, 0, 10))) for k in range(2)] == first
    second = [list(reader.read(Shard(k, 10, 20))) for k in range(2)]
    assert [r[:3] for s in second for r in s] == [("a/3", None, "create")]
    reader.commit({"version": 10})
    assert [list(reader.read(Shard(k, 10, 20))) for k in range(2)] == second
    reader.commit({"version": 20})
    assert os.listdir(f"{tmp_path}/state") == ["version=20"]


def test_renames_of_files_of_one_tick_and_size_are_told_by_their_names():
    """Small files written within one tick share time and size; each rename is told all the same."""
    from lectern.sources.tree import changes_between

    stat = (1_000, 7)
    old = {f"a/{i}.md": stat for i in range(4)} | {"a/gone.md": stat, "a/x.md": (2_000, 7)}
    new = {f"a/{i}.txt": stat for i in range(3)} | {"b/3.md": stat, "a/y.md": (2_000, 7)}
    renames = [(f"a/{i}.txt", f"a/{i}.md", "rename") for i in range(3)] + [("b/3.md", "a/3.md", "rename"), ("a/y.md", "a/x.md", "rename")]
    assert sorted(changes_between(old, new), key=str) == sorted([*renames, ("a/gone.md", None, "delete")], key=str)


def test_files_that_no_name_tells_apart_stay_creations_and_deletions():
    from lectern.sources.tree import changes_between

    stat = (1_000, 7)
    told = list(changes_between({"a/1.md": stat, "a/2.md": stat}, {"a/3.md": stat, "a/4.md": stat}))
    assert sorted(kind for _, _, kind in told) == ["create", "create", "delete", "delete"]
