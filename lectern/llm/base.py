"""What the operators of this package share: reading a table, the training fold, bounded batches of texts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_CHARS = 2_000_000  # characters of text that a Python task works on at once; one longer text is a batch of its own


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def arrow_bytes(spark: SparkSession, limit: int) -> Iterator[None]:
    """Jobs run inside send their Python workers batches of about ``limit`` bytes at most. An executor holds a task's batch
    several times over beside its heap (as vectors, as a stream, in the worker), by default up to 10,000 texts of any length."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(limit))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def held_out(doc_id: Column) -> Column:
    """True for the rows a model must not learn labels from; a row without an id is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def text_of(column: Column) -> Column:
    """A text, or the empty text for null."""
    return F.coalesce(column, F.lit(""))


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that no column of ``docs`` has, in whatever case: ``name`` with as many underscores as that takes."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], text_column: str, limit: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """The same rows in the same order, cut so that each slice has about ``limit`` bytes of text at most."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text_column)), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if batch.num_rows > start:
            yield batch.slice(start)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Consecutive rows with the same ``key``, across batches; the rows must be sorted by it. Holds one run at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)


def lists(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, one after another, and the length of each list."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def list_array(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values))


LONG_WORD = 64  # characters; longer words are worked out each time they come
ENTRY_BYTES = 200  # of a remembered word besides its letters and its value, about


class Recent:
    """Values of words, bounded in bytes, in two generations.

    When the young generation has half of the bytes, it becomes the old one and the old one is dropped; a word of the old one
    that comes again is carried over. So what is met often stays, and a full store costs only what was not met for long.
    ``young`` may be read for all words that ``unknown`` was asked about and that are not long.
    """

    def __init__(self, limit: int) -> None:
        self.limit, self.bytes = limit, 0
        self.young: dict[str, Any] = {}
        self.old: dict[str, Any] = {}

    def put(self, word: str, value: Any) -> None:
        self.young[word] = value
        self.bytes += ENTRY_BYTES + len(word) + (len(value) if isinstance(value, bytes) else 0)

    def unknown(self, words: Iterable[str]) -> list[str]:
        new, young, old = [], self.young, self.old
        for w in words:
            if w in young:
                continue
            value = old.get(w)
            if value is None:
                new.append(w)
            else:
                self.put(w, value)
        return new

    def turn(self) -> None:
        """Between batches: let the generations move on if the young one is full."""
        if 2 * self.bytes > self.limit:
            self.old, self.young, self.bytes = self.young, {}, 0


_KEPT: dict[tuple, Any] = {}


def kept(make: Callable[..., Any], *args: Any) -> Any:
    """``make(*args)``, kept by this Python worker over its tasks until another such object, or a map that keeps none, takes its place."""
    key = make.__module__, make.__qualname__, args
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make(*args)
    return _KEPT[key]


def trim() -> None:
    """Memory that is no longer used goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def drop_kept() -> None:
    """Lets go of what ``kept`` holds in this Python worker."""
    if _KEPT:
        _KEPT.clear()
        trim()


def giving_back(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same map over batches; what it no longer uses goes back to the system at its end, since idle Python workers live on.
    Unless it ``keeps`` an object itself, what an earlier map kept goes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # this function is sent to the workers with copies of the globals it names: only functions of the module reach the worker's own
        if not keeps:
            drop_kept()
        try:
            yield from fn(batches)
        finally:
            trim()

    return run
