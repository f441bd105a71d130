"""Language identification by rank-order profiles.

A profile is the list of a text's most frequent letter n-grams (1 to 3 code points, a blank between words), most frequent
first, ties by code points. A document's distance to a language is the sum over its profile of how far each n-gram is out
of its place in the language's profile, with ``size`` for one that is not there; the nearest language wins, ties by name.

Language profiles are counted on a bounded sample of the labelled rows outside the held-out fold (``per_language`` rows
each, by a hash of the text); the counts of the tasks are summed in a shuffle and only the profiles come to the driver.
Documents never move. Null texts and texts without a letter are ``und`` with score 0; without any labelled row all are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .base import slices

SIZE = 300  # n-grams of a profile
PER_LANGUAGE = 8_000  # about so many documents of each language are learned from
UNKNOWN = "und"
LONG = 1_000_000  # code points of a text that are counted at once


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else a blank."""
    points = np.arange(0x110000, dtype=np.int64)
    known = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return np.where(known, points, 32)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, as integers in order, and their counts."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for start in range(0, len(text), LONG):  # two more code points, so that no n-gram is lost at a cut
        points = _letters()[np.frombuffer(text[start : start + LONG + 2].lower().encode("utf-32-le", "replace"), np.uint32)]
        if start == 0:
            points = np.concatenate([[32], points])
        if start + LONG >= len(text):
            points = np.concatenate([points, [32]])
        blank = points == 32
        last = min(len(points), LONG + (start == 0)) if start + LONG < len(text) else len(points)
        one, two = points[:last][~blank[:last]], (points[:-1] << 21 | points[1:])[:last]
        three = (points[:-2] << 42 | points[1:-1] << 21 | points[2:])[:last]
        two, three = two[~(blank[:-1] & blank[1:])[:last]], three[~((blank[:-2] & blank[1:-1]) | (blank[1:-1] & blank[2:]))[:last]]
        found.append(np.unique(np.concatenate([one, two, three]), return_counts=True))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(found) == 1:
        return found[0]
    codes, back = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    return codes, np.bincount(back, np.concatenate([f[1] for f in found])).astype(np.int64)


def top(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent codes, most frequent first, ties by code."""
    if len(codes) > 4 * size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """The learned profiles; ``nearest`` gives the language of a text."""

    def __init__(self, profiles: dict[str, list[int]], size: int) -> None:
        self.languages, self.size = sorted(profiles), size
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p], np.int64))
        self.places = np.full((len(self.languages), len(self.codes) + 1), -1, np.int64)  # the last column: in no profile
        for i, name in enumerate(self.languages):
            self.places[i, np.searchsorted(self.codes, np.array(profiles[name], np.int64))] = np.arange(len(profiles[name]))

    def nearest(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages:
            return UNKNOWN, 0.0
        mine = top(*grams(text), self.size)
        if not len(mine):
            return UNKNOWN, 0.0
        at = np.searchsorted(self.codes, mine)
        at[at == len(self.codes)] = 0
        at = np.where(self.codes[at] == mine, at, len(self.codes))
        places = self.places[:, at]
        away = np.where(places < 0, self.size, np.abs(places - np.arange(len(mine)))).sum(axis=1)
        best = int(np.argmin(away))
        return self.languages[best], float(1 - away[best] / (self.size * len(mine)))


def learn(rows: DataFrame, size: int = SIZE, per_language: int = PER_LANGUAGE) -> Profiles:
    """Profiles of the languages in ``rows`` (text, lang), both non-null where they count."""
    rows = rows.select("text", "lang").where("text is not null and lang is not null")
    share = rows.groupBy("lang").agg((F.lit(float(per_language)) / F.count(F.lit(1))).alias("share")).collect()  # one row per language
    if not share:
        return Profiles({}, size)
    keep: Column = F.lit(False)
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    for r in share:
        keep = keep | ((F.col("lang") == r.lang) & (place < r.share))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for part in slices(batches, "text"):
            new: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist()):
                new.setdefault(lang, [sums[lang]] if lang in sums else []).append(grams(text))
            for lang, found in new.items():
                codes, back = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
                sums[lang] = codes, np.bincount(back, np.concatenate([f[1] for f in found])).astype(np.int64)
        for lang, (codes, counts) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes), pa.array(counts)], names=["lang", "code", "n"])

    counts = rows.where(keep).mapInArrow(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("place") <= size)
    profiles: dict[str, list[int]] = {r.lang: [] for r in share}
    for r in sorted(ranked.collect(), key=lambda r: r.place):  # ``size`` rows per language
        profiles[r.lang].append(r.code)
    return Profiles({k: v for k, v in profiles.items() if v}, size)


def identify(docs: DataFrame, profiles: Profiles, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score (0 to 1, higher: nearer to the profile)."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [profiles.nearest(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"]
            )

    return rows.mapInArrow(predict, StructType([StructField("doc_id", rows.schema["doc_id"].dataType), *StructType.fromDDL("lang_pred string, score double").fields]))
