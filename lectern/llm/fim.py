"""Fill-in-middle: a text is cut at two unit boundaries and its three parts are written in a new order behind sentinels.

A text is handled as the bytes it is stored in. The offsets at which a unit (code point, word, line) starts, and the end, form
a boundary set in the manner of Roaring bitmaps: offsets are cut by their high bits into containers of 65 536, and each
container is kept in the smallest of three forms: an array of low halves, a bitmap, or runs of consecutive offsets (plain
ASCII is one run). Cumulative cardinalities over the containers find the one that holds the m-th boundary, and a select inside
it gives the offset: an index for an array, a search over run lengths, or over popcounts of words and then inside one word for
a bitmap. So both cuts are found without decoding the text, in memory of about two bytes a byte of it.

The cuts and the form are drawn from a hash of the id: a rerun, or a lost executor, gives the same rows. One map, no shuffle.

Nulls count as empty texts, which stay plain. A null id is hashed as an empty number. Texts that hold a sentinel stay plain, so
every other output can be read back (``restored``). Rows that repeat are cut alike. Long texts are batches of their own. Only
the id and text columns are read, so further columns may have any name. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .base import giving_back, slices, text_of

LOW_BITS = 16
SPAN = 1 << LOW_BITS  # offsets of a container
BITMAP_BYTES = SPAN // 8


class Runs:
    """Consecutive offsets as (first, cardinality before) of each run."""

    def __init__(self, first: np.ndarray, lengths: np.ndarray) -> None:
        self.first, self.before = first, np.cumsum(lengths) - lengths

    def select(self, m: int) -> int:
        i = int(np.searchsorted(self.before, m, "right")) - 1
        return int(self.first[i]) + m - int(self.before[i])


class Array:
    """Low halves in order."""

    def __init__(self, bits: np.ndarray) -> None:
        self.values = np.flatnonzero(bits).astype(np.uint16)

    def select(self, m: int) -> int:
        return int(self.values[m])


class Bitmap:
    """One bit an offset in words of 64, with the cardinality up to and including each word."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)]).view("<u8")
        self.upto = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)

    def select(self, m: int) -> int:
        word = int(np.searchsorted(self.upto, m, "right"))
        rest = m - (int(self.upto[word - 1]) if word else 0)
        bits = np.unpackbits(self.words[word : word + 1].view(np.uint8), bitorder="little")
        return word * 64 + int(np.flatnonzero(bits)[rest])


def container(bits: np.ndarray) -> tuple[Runs | Array | Bitmap, int]:
    """The smallest form of a block of at most ``SPAN`` offsets, and its cardinality."""
    count = int(np.count_nonzero(bits))
    if count == len(bits):
        return Runs(np.zeros(1, np.int64), np.array([count])), count
    edges = np.flatnonzero(np.diff(bits.view(np.int8), prepend=0, append=0))
    if 2 * len(edges) < min(2 * count, BITMAP_BYTES):  # two halves for each run
        return Runs(edges[::2], edges[1::2] - edges[::2]), count
    return (Array(bits) if 2 * count <= BITMAP_BYTES else Bitmap(bits)), count


class BoundarySet:
    """A set of offsets, given as a mask, that answers where its m-th member lies."""

    def __init__(self, mask: np.ndarray) -> None:
        made = [container(mask[a : a + SPAN]) for a in range(0, len(mask), SPAN)]
        self.containers = [c for c, _ in made]
        self.upto = np.cumsum([n for _, n in made])

    def __len__(self) -> int:
        return int(self.upto[-1])

    def select(self, m: int) -> int:
        high = int(np.searchsorted(self.upto, m, "right"))
        return (high << LOW_BITS) + self.containers[high].select(m - (int(self.upto[high - 1]) if high else 0))


def unit_starts(raw: np.ndarray, unit: str) -> np.ndarray:
    """Mask over the offsets 0 to len(raw): where a unit of the UTF-8 bytes starts, and the end. n units are n + 1 boundaries.

    char  code points
    word  runs of other bytes than ASCII white space, each with the white space behind it
    line  lines with their line feed
    """
    mask = np.ones(len(raw) + 1, bool)
    if unit == "char":
        mask[:-1] = (raw & 0xC0) != 0x80
    elif unit == "line":
        mask[1:-1] = raw[:-1] == 10
    elif unit == "word":
        blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
        mask[1:-1] = blank[:-1] & ~blank[1:]
    else:
        raise ValueError(f"no unit {unit}")
    return mask


@dataclass(frozen=True)
class Fim:
    """How texts are cut: shares in percent, the seed of the draws, what marks the parts."""

    seed: int = 1
    fim_percent: int = 90
    spm_percent: int = 20
    unit: str = "char"
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


def draws(id_column: Column, seed: int) -> list[Column]:
    """Four integers below 2^32 of an id: the first groups of eight digits of the SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)]


def fill_in_middle(docs: DataFrame, how: Fim = Fim(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n units, form, prefix_chars, middle_chars, output) of each row; the lengths, in code points, are null if plain."""
    rows = docs.select(F.col(id_column).alias("doc_id"), text_of(F.col(text_column)).alias("text"), *draws(F.col(id_column), how.seed))
    p, s, m = (x.encode() for x in (how.prefix, how.suffix, how.middle))

    def one(raw: bytes, h1: int, h2: int, h3: int, h4: int) -> tuple[int, str, int | None, int | None, bytes]:
        flat = np.frombuffer(raw, np.uint8)
        starts = BoundarySet(unit_starts(flat, how.unit))
        n = len(starts) - 1
        if not raw or h3 % 100 >= how.fim_percent or p in raw or s in raw or m in raw:
            return n, "plain", None, None, raw
        first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = starts.select(first), starts.select(last)
        sizes = (first, last - first) if how.unit == "char" else tuple(int(np.count_nonzero((x & 0xC0) != 0x80)) for x in (flat[:a], flat[a:b]))
        spm = h4 % 100 < how.spm_percent
        parts = (s, raw[b:], p, raw[:a], m, raw[a:b]) if spm else (p, raw[:a], s, raw[b:], m, raw[a:b])
        return n, "spm" if spm else "psm", *sizes, b"".join(parts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            raw = part.column("text").cast(pa.binary()).to_pylist()
            made = list(zip(*map(one, raw, *[part.column(f"h{i}").to_pylist() for i in range(1, 5)])))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array(v, t) for v, t in zip(made, types)]
            columns[-1] = columns[-1].cast(pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    fields = StructType.fromDDL("n bigint, form string, prefix_chars bigint, middle_chars bigint, output string").fields
    return rows.mapInArrow(giving_back(cut), StructType([StructField("doc_id", rows.schema["doc_id"].dataType), *fields]))


def restored(output: Column, form: Column, how: Fim = Fim()) -> Column:
    """The text that an output of the given form was made of."""
    part = F.split(output, "|".join(re.escape(x) for x in (how.prefix, how.suffix, how.middle)), 4)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)
