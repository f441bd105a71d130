"""Removal of repeated byte strings by suffix sorting.

A byte goes if a string of ``length`` bytes that covers it also starts earlier, in a smaller document or before in the same.

A window of ``length`` bytes is named by its anchor, the ``core`` bytes in it with the least hash (leftmost of equals), which
equal windows share at the same place. Consecutive windows with one anchor form a segment.

1. Every task lists the anchors of its documents; they meet by hash, and anchors that occur once in the corpus are dropped.
   A task passes each anchor on once, with its places, so a frequent one is no more rows than there are tasks.
2. The documents' bytes are cut into the segments of the anchors that are left. A segment that its task has seen earlier is
   marked at once. An anchor with more than ``hot`` places (a short line that a large part of the corpus has, in ever new
   surroundings) is not used as a key: its segments are cut into single windows, each its own key.
3. Segments meet by key, sorted by content and place. Of equal segments all but the earliest are marked. Where a key has
   several different segments, their bytes are suffix-sorted together: suffixes smaller than their successors are sorted
   directly, the others are induced from them by a scan over the buckets of first bytes, and the common prefixes of adjacent
   suffixes give the classes of equal windows; all but the earliest of a class are marked.
4. The marks return to their documents.

All steps are one plan over one shuffle of the texts by document. A task holds its own input's anchors in step 1, else a batch.

Null texts are empty; texts shorter than ``length`` lose nothing. Rows with the same id are documents of their own, in the order
of their text, the last of equal ones last; a row without an id comes before all others. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .base import slices, text_of
from .shingles import mixed

PLACE = np.dtype([("doc", "<i8"), ("nth", "<i4"), ("start", "<i4"), ("span", "<i2")])
SORTED_BYTES = 4_000_000  # bytes that are suffix-sorted at once
SEEN = 300_000  # segments a task remembers
NO_ID = -(1 << 63)


@dataclass(frozen=True)
class Repeats:
    length: int = 100
    core: int = 32
    hot: int = 100_000


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of ``size`` bytes, by doubling."""
    base = np.uint64(0x9E3779B97F4A7C15)
    value, width, power = data.astype(np.uint64) + np.uint64(1), 1, base
    total, done, rest = None, 0, size
    while True:
        if rest & 1:
            if total is None:
                total, done, total_power = value[: len(data) - width + 1], width, power
            else:
                n = len(data) - done - width + 1
                total, done = total[:n] + total_power * value[done : done + n], done + width
                total_power = total_power * power
        rest >>= 1
        if not rest:
            return mixed(total)
        n = len(value) - width
        value = value[:n] + power * value[width : width + n]
        with np.errstate(over="ignore"):
            power, width = power * power, 2 * width


def sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    least, width = values, 1
    while 2 * width <= size:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < size:
        least = np.minimum(least[: len(values) - size + 1], least[size - width : len(values) - width + 1])
    return least


def anchored(texts: list[bytes], p: Repeats) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of 48 bits, text, first window, windows) of every segment of the texts, in order."""
    ends = np.cumsum([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < p.length:
        return np.zeros(0, np.uint64), none, none, none
    hashes = rolling(data, p.core)
    keyed = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    anchor = (sliding_least(keyed, p.length - p.core + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begin = ends - np.array([len(t) for t in texts])
    owner = np.repeat(np.arange(len(texts)), ends - begin)[: len(anchor)]
    window = np.flatnonzero(np.arange(len(anchor)) + p.length <= ends[owner])
    anchor, owner = anchor[window], owner[window]
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])])) if len(window) else none
    spans = np.diff(np.append(first, len(window)))
    return hashes[anchor[first]] >> np.uint64(16), owner[first], window[first] - begin[owner[first]], spans


def _documents(docs: DataFrame) -> DataFrame:
    """(doc, text, nth): every use reads these columns, so that one shuffle serves all."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), text_of(F.col("text")).alias("text"))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("doc").orderBy("text")))


def _raw(part: pa.RecordBatch) -> list[bytes]:
    return [t.encode("utf-8", "replace") for t in part.column("text").to_pylist()]


def anchor_places(docs: DataFrame, p: Repeats) -> DataFrame:
    """(h, places): each task's anchors, once, with all their places in the task."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, places = [], []
        for part in slices(batches, "text"):
            h, owner, start, span = anchored(_raw(part), p)
            place = np.zeros(len(h), PLACE)
            place["doc"], place["nth"] = part.column("doc").to_numpy()[owner], part.column("nth").to_numpy()[owner]
            place["start"], place["span"] = start, span
            hashes.append(h)
            places.append(place)
        if not hashes or not sum(map(len, hashes)):
            return
        h, place = np.concatenate(hashes), np.concatenate(places)
        hashes, places = [], []
        order = np.argsort(h, kind="stable")
        h, place = h[order], place[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        bounds = np.append(first, len(h))
        for a in range(0, len(first), 50_000):
            b = min(a + 50_000, len(first))
            lo, hi = bounds[a], bounds[b]
            offsets = ((bounds[a : b + 1] - lo) * PLACE.itemsize).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(place[lo:hi].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(h[first[a:b]].view(np.int64)), packed], names=["h", "places"])

    return docs.select("doc", "nth", "text").mapInArrow(find, "h bigint, places binary")


def repeated(places: DataFrame, p: Repeats) -> DataFrame:
    """(anchor, doc, nth, start, span, hot) of the segments whose anchor occurs more than once."""
    fields = "anchor bigint, doc bigint, nth int, start int, span smallint, hot boolean"

    def rows(h: np.ndarray, place: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(np.ascontiguousarray(place[c])) for c in PLACE.names]
        return pa.RecordBatch.from_arrays([pa.array(h), *columns, pa.array(hot)], names=["anchor", *PLACE.names, "hot"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, total = None, [], 0  # the anchor that may go on in the next batch; once it is surely hot, nothing is held

        def told() -> Iterator[pa.RecordBatch]:
            whole = np.concatenate(held) if held else np.zeros(0, PLACE)
            if total > 1 and len(whole):
                yield rows(np.full(len(whole), last), whole, np.full(len(whole), total > p.hot))

        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column("places").to_pylist()
            h = np.repeat(batch.column("h").to_numpy(), np.fromiter(map(len, raw), np.int64, len(raw)) // PLACE.itemsize)
            place = np.frombuffer(b"".join(raw), PLACE)
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            counts = np.diff(np.append(first, len(h)))
            if last is not None and h[0] == last:
                held.append(place[: counts[0]])
                total += int(counts[0])
                h, place, first, counts = h[counts[0] :], place[counts[0] :], first[1:] - counts[0], counts[1:]
                if total > p.hot:
                    yield from told()
                    held = []
            if not len(h):
                continue
            yield from told()
            inner = np.concatenate([counts[:-1] > 1, [False]])
            pick = np.repeat(inner, counts)
            if pick.any():
                yield rows(h[pick], place[pick], np.repeat(counts > p.hot, counts)[pick])
            last, held, total = int(h[-1]), [place[first[-1] :]], int(counts[-1])
        yield from told()

    return places.repartition("h").sortWithinPartitions("h").mapInArrow(keep, fields)


SEGMENT = "kind int, anchor bigint, doc bigint, nth int, start int, span int, body binary"
KNOWN, ANCHORED, SINGLE = 0, 1, 2  # covered, as its task has seen; to be compared under its anchor; one window of a hot anchor


def cut_segments(docs: DataFrame, places: DataFrame, p: Repeats) -> DataFrame:
    """Segments with their bytes; those that are known to be covered have none."""
    listed = places.groupBy("doc").agg(F.collect_list(F.struct("anchor", "nth", "start", "span", "hot")).alias("cut"))  # of one document
    rows = docs.select("doc", "nth", "text").join(listed, "doc")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple[int, int, int]] = {}
        for part in slices(batches, "text"):
            out: list[tuple] = []
            cuts = part.column("cut")
            flat, sizes = cuts.flatten(), pc.list_value_length(cuts).to_pylist()
            anchors, nths, starts, spans, hots = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("anchor", "nth", "start", "span", "hot"))
            at = 0
            for doc, nth, raw, size in zip(part.column("doc").to_pylist(), part.column("nth").to_pylist(), _raw(part), sizes):
                mine = np.arange(at, at + size)[nths[at : at + size] == nth]
                at += size
                for s, n, anchor, hot in sorted(zip(starts[mine].tolist(), spans[mine].tolist(), anchors[mine].tolist(), hots[mine].tolist())):
                    for s, n in [(w, 1) for w in range(s, s + n)] if hot else [(s, n)]:
                        body = raw[s : s + n - 1 + p.length]
                        was = seen.get(body)
                        if was is not None and was < (doc, nth, s):
                            before = out[-1] if out else None
                            if before and before[0] == KNOWN and before[2:4] == (doc, nth) and before[4] + before[5] >= s:
                                s, n = before[4], s + n - before[4]  # one range with the one before
                                out.pop()
                            out.append((KNOWN, anchor, doc, nth, s, n, None))
                            continue
                        if len(seen) > SEEN:
                            seen = {}
                        seen[body] = (doc, nth, s)
                        out.append((SINGLE if hot else ANCHORED, anchor, doc, nth, s, n, body))
            if out:
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["kind", "anchor", "doc", "nth", "start", "span", "body"])

    return rows.mapInArrow(segments, SEGMENT)


def ascending(data: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successor; the end is smaller than any byte."""
    n = len(data)
    change = np.flatnonzero(data[1:] != data[:-1])
    nxt = np.full(n, n, np.int64)
    at = np.searchsorted(change, np.arange(n))
    inside = at < len(change)
    nxt[inside] = change[at[inside]] + 1
    return (nxt < n) & (data[np.minimum(nxt, n - 1)] > data)


def sorted_directly(data: np.ndarray, positions: np.ndarray, depth: int) -> np.ndarray:
    """``positions`` by their first ``depth`` bytes (at least), ties by position: eight bytes at a time, only where still tied."""
    padded = np.concatenate([data, np.zeros(depth + 16, np.uint8)])
    words = np.zeros(len(data) + depth + 8, np.uint64)
    for i in range(8):
        words = (words << np.uint64(8)) | padded[i : i + len(words)]
    order = positions[np.argsort(words[positions], kind="stable")]
    value = words[order]
    new = np.concatenate([[True], value[1:] != value[:-1]])
    for d in range(8, depth, 8):
        size = np.diff(np.append(np.flatnonzero(new), len(new)))
        tied = np.flatnonzero(np.repeat(size > 1, size))
        if not len(tied):
            break
        group = np.cumsum(new)[tied]
        value = words[order[tied] + d]
        by = np.argsort(value, kind="stable")
        by = by[np.argsort(group[by], kind="stable")]
        order[tied], value = order[tied[by]], value[by]
        new[tied] = np.concatenate([[True], (value[1:] != value[:-1]) | (group[1:] != group[:-1])])
    return order


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes by their first ``depth`` bytes at least, by two stages.

    Suffixes smaller than their successor are sorted directly. Any other follows its successor in order: a scan over the
    buckets of first bytes, from the smallest, puts the predecessor of each suffix found into its own bucket, before that
    bucket's directly sorted ones; runs of one byte are followed within their bucket.
    """
    n = len(data)
    small = ascending(data)
    direct = sorted_directly(data, np.flatnonzero(small), depth)
    bounds = np.searchsorted(data[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[data[n - 1]].append(np.array([n - 1]))  # follows the end
    order = []
    for byte in range(256):
        done: list[np.ndarray] = []
        fresh = np.concatenate(induced[byte]) if induced[byte] else np.zeros(0, np.int64)
        while len(fresh):
            done.append(fresh)
            before = fresh[fresh > 0] - 1
            fresh = before[(data[before] == byte) & ~small[before]]
        found = np.concatenate([*done, direct[bounds[byte] : bounds[byte + 1]]])
        order.append(found)
        before = found[found > 0] - 1
        before = before[~small[before] & (data[before] > byte)]
        if len(before):
            first = data[before]
            by = np.argsort(first, kind="stable")
            before, first = before[by], first[by]
            cuts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
            for a, b in zip(cuts, np.append(cuts[1:], len(first))):
                induced[first[a]].append(before[a:b])
    return np.concatenate(order)


def repeated_windows(bodies: list[bytes], rank: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, offset) of each window that also occurs in a segment of smaller rank, or earlier in its own."""
    data = np.frombuffer(b"".join(bodies), np.uint8)
    sizes = np.array([len(b) for b in bodies])
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(bodies)), sizes)
    offset = np.arange(len(data)) - begin[owner]
    order = suffix_order(data, length)
    order = order[offset[order] + length <= sizes[owner[order]]]
    if not len(order):
        return order, order
    same = np.zeros(len(order), bool)  # whether the common prefix with the one before has all bytes
    left = np.arange(1, len(order))
    for d in range(0, length, 4):
        step = min(4, length - d)
        equal = np.ones(len(left), bool)
        for i in range(d, d + step):
            equal &= data[order[left] + i] == data[order[left - 1] + i]
        left = left[equal]
        if not len(left):
            break
    same[left] = True
    group = np.cumsum(~same) - 1
    seg, off = owner[order], offset[order]
    by = np.lexsort((off, rank[seg], group))
    first = np.concatenate([[True], group[by][1:] != group[by][:-1]])
    late = by[~first]
    return seg[late], off[late]


def covered(segments: DataFrame, p: Repeats) -> DataFrame:
    """(doc, nth, start, end): byte ranges that earlier strings cover."""
    key = F.when(F.col("kind") == KNOWN, F.xxhash64("doc", "start")).when(F.col("kind") == SINGLE, F.xxhash64("body")).otherwise(F.col("anchor"))
    fields = "doc bigint, nth int, start int, end int"

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
            doc, nth, start, end = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(nth, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["doc", "nth", "start", "end"])

        waiting: list[tuple[bytes, tuple[int, int, int]]] = []  # different segments of finished keys
        n_bytes = 0

        def sort() -> list[tuple[int, int, int, int]]:
            places = [w[1] for w in waiting]
            rank = np.empty(len(waiting), np.int64)
            rank[sorted(range(len(waiting)), key=places.__getitem__)] = np.arange(len(waiting))
            seg, off = repeated_windows([w[0] for w in waiting], rank, p.length)
            by = np.lexsort((off, seg))
            seg, off = seg[by], off[by]
            cut = np.flatnonzero(np.concatenate([[True], (seg[1:] != seg[:-1]) | (off[1:] != off[:-1] + 1)])) if len(seg) else []
            return [(*places[seg[a]][:2], places[seg[a]][2] + int(off[a]), places[seg[a]][2] + int(off[b - 1]) + p.length) for a, b in zip(cut, np.append(cut[1:], len(seg)))] if len(seg) else []

        key, last, mine = None, None, []
        for batch in batches:
            marks = []
            for k, *place, span, body in zip(*(batch.column(c).to_pylist() for c in ("key", "doc", "nth", "start", "span", "body"))):
                if k != key:
                    if len(mine) > 1:
                        waiting += mine
                        n_bytes += sum(len(m[0]) for m in mine)
                    key, last, mine = k, None, []
                if body is None or body == last:
                    marks.append((*place, place[2] + span - 1 + p.length))
                else:
                    mine.append((body, tuple(place)))
                    last = body
            if marks:
                yield out(marks)
            if n_bytes > SORTED_BYTES:
                if rows := sort():
                    yield out(rows)
                waiting, n_bytes = [], 0
        if len(mine) > 1:
            waiting += mine
        if waiting and (rows := sort()):
            yield out(rows)

    keyed = segments.withColumn("key", key).select("key", "doc", "nth", "start", "span", "body")
    return keyed.repartition("key").sortWithinPartitions("key", "body", "doc", "nth", "start").mapInArrow(mark, fields)


def remove_repeats(docs: DataFrame, p: Repeats = Repeats(), with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``with_text`` the remaining bytes as ``kept``."""
    rows = _documents(docs)
    marks = covered(cut_segments(rows, repeated(anchor_places(rows, p), p), p), p)
    marks = marks.groupBy("doc").agg(F.collect_list(F.struct("nth", "start", "end")).alias("marks"))  # of one document
    joined = rows.select("doc", "nth", "text").join(marks, "doc", "left")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            out = []
            for raw, nth, marks in zip(_raw(part), part.column("nth").to_pylist(), part.column("marks").to_pylist()):
                kept, at, removed, spans = [], 0, 0, 0
                for start, end in sorted((m["start"], m["end"]) for m in marks or () if m["nth"] == nth):
                    if start > at or not spans:
                        kept.append(raw[at:start])
                        spans += 1
                        removed += end - start
                        at = end
                    elif end > at:
                        removed += end - at
                        at = end
                kept.append(raw[at:])
                rest = b"".join(kept)
                out.append((len(raw), removed, spans, hashlib.sha256(rest).hexdigest(), rest if with_text else None))
            n, removed, spans, digest, rest = zip(*out)
            doc = part.column("doc")
            doc_id = pc.if_else(pc.equal(doc, NO_ID), pa.scalar(None, pa.int64()), doc)
            arrays = [doc_id, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest), pa.array(rest, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    schema = StructType([StructField("doc_id", LongType()), *StructType.fromDDL("n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary").fields])
    result = joined.select("doc", "nth", "text", "marks").mapInArrow(strip, schema)
    return result if with_text else result.drop("kept")
