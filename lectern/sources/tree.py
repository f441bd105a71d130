"""SRC-5: a streaming source that watches a tree of files and tells what changed: ``readStream.format("tree_changes")``."""

from __future__ import annotations

import json
import time
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SHARDS = 32


@dataclass
class Shard(InputPartition):
    number: int
    start: int
    end: int


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


Listing = dict[str, tuple[int, int]]  # path -> (time of its last change in ns, size)


def _stem(path: str) -> str:
    """The path without the ending of its name."""
    folder, _, name = path.rpartition("/")
    return f"{folder}/{name.rpartition('.')[0] or name}"


def changes_between(old: Listing, new: Listing) -> Iterator[tuple[str, str | None, str]]:
    """(path, old_path, kind). A path that went and one that came with the same time and size, each the only such one, are a rename.

    Files written within one tick of the clock may share time and size; of several such, those are a rename that agree in folder
    and name but for the ending, then those that agree in name, then one that is left on either side.
    """
    came, went = defaultdict(list), defaultdict(list)
    for path in sorted(new.keys() - old.keys()):
        came[new[path]].append(path)
    for path in sorted(old.keys() - new.keys()):
        went[old[path]].append(path)
    for stat, paths in came.items():
        gone = went.get(stat, [])
        for alike in (_stem, lambda p: p.rpartition("/")[2], lambda p: ""):
            a, b = defaultdict(list), defaultdict(list)
            for path in paths:
                a[alike(path)].append(path)
            for path in gone:
                b[alike(path)].append(path)
            pairs = [(a[k][0], b[k][0]) for k in a if len(a[k]) == 1 and len(b.get(k, ())) == 1]
            yield from ((path, old_path, "rename") for path, old_path in pairs)
            paired = {p for pair in pairs for p in pair}
            paths, gone = [p for p in paths if p not in paired], [p for p in gone if p not in paired]
        if stat in went:
            went[stat] = gone
        yield from ((p, None, "create") for p in paths)
    yield from ((p, None, "delete") for paths in went.values() for p in paths)
    yield from ((p, None, "modify") for p in sorted(new.keys() & old.keys()) if new[p] != old[p])


class TreeReader(DataSourceStreamReader):
    """Offsets name listings by their time. A batch is the difference of two.

    The tree is dealt to shards by the names in its root. Each task lists its own shard, writes the listing of the batch's end
    below ``state`` and tells how it differs from that of the start. A listing that is there is never made anew, so a batch that
    comes again, after a lost executor or a restart, tells the same. The driver sees no listing.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.state = options["path"].rstrip("/"), options["state"].rstrip("/")
        self.shards = int(options.get("shards", SHARDS))

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        return {"version": time.time_ns() // 1_000_000}

    def partitions(self, start: dict, end: dict) -> list[Shard]:
        return [Shard(k, start["version"], end["version"]) for k in range(self.shards)]

    def _file(self, base: str, version: int, shard: int) -> str:
        return f"{base}/version={version}/shard={shard}.json"

    def _listed(self, version: int, shard: int) -> Listing | None:
        store, base = _store(self.state)
        try:
            with store.open_input_stream(self._file(base, version, shard)) as f:
                return {p: (m, n) for p, m, n in map(json.loads, f.read().decode().splitlines())}
        except FileNotFoundError:
            return None

    def _list(self, shard: int) -> Listing:
        from pyarrow import fs

        store, base = _store(self.root)
        found: Listing = {}
        for top in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            if zlib.crc32(top.base_name.encode()) % self.shards == shard:
                below = [top] if top.type == fs.FileType.File else store.get_file_info(fs.FileSelector(top.path, recursive=True, allow_not_found=True))
                found |= {i.path[len(base) :].lstrip("/"): (i.mtime_ns or 0, i.size) for i in below if i.type == fs.FileType.File}
        return found

    def _write(self, version: int, shard: int, listing: Listing) -> None:
        store, base = _store(self.state)
        name = self._file(base, version, shard)
        store.create_dir(name.rsplit("/", 1)[0], recursive=True)
        part = f"{name}.{time.time_ns()}"  # a second attempt of the task writes its own
        with store.open_output_stream(part) as f:
            for path, (mtime, size) in sorted(listing.items()):
                f.write(json.dumps([path, mtime, size]).encode() + b"\n")
        store.move(part, name)

    def read(self, partition: Shard) -> Iterator[tuple]:
        old = self._listed(partition.start, partition.number) or {}
        new = self._listed(partition.end, partition.number)
        if new is None:
            new = self._list(partition.number)
            self._write(partition.end, partition.number, new)
        at = datetime.fromtimestamp(partition.end / 1000, timezone.utc)
        for path, old_path, kind in changes_between(old, new):
            yield path, old_path, kind, at

    def commit(self, end: dict) -> None:
        """Listings before the one that the next batch starts from are no longer needed."""
        from pyarrow import fs

        store, base = _store(self.state)
        for info in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            name = info.base_name.partition("version=")[2]
            if name.isdigit() and int(name) < end["version"]:
                store.delete_dir(info.path)


class TreeChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree_changes"

    def schema(self) -> str:
        return "path string, old_path string, kind string, ts timestamp"

    def streamReader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def watch(spark: SparkSession, root: str, state: str, shards: int = SHARDS) -> DataFrame:
    """SRC-5: change events (path, old_path, kind, ts) of the tree below ``root`` as a stream; paths are relative to it.

    The first batch tells of every file as created; each later one (a poll per trigger) of what changed since. ``state`` is a
    folder that all executors share. A rename is told as one within a folder of the root, and as a deletion and a creation
    between two of them. ``shards`` bounds what a task lists: a folder of the root is never split.
    """
    spark.dataSource.register(TreeChanges)
    return spark.readStream.format("tree_changes").option("state", state).option("shards", str(shards)).load(root)
