"""Document fingerprints from closed syncmers, with DataFrame functions only.

Symbols are words of up to 24 code points (longer ones are cut) and single Han characters. A k-mer is ``k`` symbols; it is
chosen when the least hash among its inner strings of ``s`` symbols is the first or the last of them. The choice looks at
nothing outside the k-mer, so an edit changes only the k-mers it touches. A fingerprint is the chosen k-mers in text
order, each hashed together with its distance to the one before (8 hexadecimal digits), so that two texts agree where the
same anchors stand at the same distances. A text of fewer than ``k`` symbols has one anchor, all its symbols; an empty one
has none. Likeness is twice the shared anchors over the anchors of both; two texts without anchors are alike.

``with_next`` puts each text beside that of the next id: texts move once, to ranges of ids cut by quantiles, and the first
row of each range is sent to the range before as well. Ties of ids are broken by the text; a row without an id comes first.
Nulls count as empty. Rows that repeat are rows of their own. Only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import text_of
from .mixing import bound

K, S = 6, 2
SYMBOL = r"\p{IsHan}|[^\s\p{IsHan}]{1,24}"
RANGE_ROWS = 4_000  # documents of a range
QUANTILES = 64  # cuts between which ids are taken as even
BROADCAST_ROWS = 1_000_000  # ids of 16 bytes


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """The chosen k-mers of a text as hashes with distances, in order."""
    span = k - s + 1

    def chosen(symbols: Column) -> Column:
        return bound(F.transform(symbols, lambda i: F.xxhash64(i)), from_hashes)

    def from_hashes(h: Column) -> Column:
        inner = F.transform(F.sequence(F.lit(0), F.size(h) - s), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(s)]))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(h) < k, F.array(F.xxhash64(h))).otherwise(bound(inner, lambda m: placed(h, m)))

    def placed(h: Column, m: Column) -> Column:
        def edge(i: Column) -> Column:
            return bound(F.array_min(F.slice(m, i + 1, span)), lambda low: (F.get(m, i) == low) | (F.get(m, i + span - 1) == low))

        at = F.filter(F.sequence(F.lit(0), F.size(m) - span), edge)
        return bound(at, lambda p: F.transform(p, lambda i, j: F.xxhash64(F.slice(h, i + 1, k), F.when(j == 0, F.lit(0)).otherwise(i - F.get(p, j - 1)))))

    return bound(F.regexp_extract_all(text, F.lit(SYMBOL), F.lit(0)), chosen)


def digits(anchor: Column) -> Column:
    return F.lpad(F.lower(F.hex(anchor.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")


def fingerprint(anchors: Column) -> Column:
    return F.array_join(F.transform(anchors, digits), "")


def likeness(a: Column, b: Column) -> Column:
    """Of two distinct sets of anchors."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def with_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, text, next_text): each text with that of the next id; the last one's next is the first."""
    rows = docs.select(F.col(id_column).alias("doc_id"), text_of(F.col(text_column)).alias("text"))
    shares = [i / QUANTILES for i in range(QUANTILES + 1)]
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.percentile_approx("doc_id", shares, 1000).alias("cuts")).first()
    low = 0 if seen.low is None else seen.low
    cuts = sorted({low - 1, low, *(seen.cuts or [])})
    parts = max(1, seen.n // (RANGE_ROWS * QUANTILES) + 1)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(low - 1))
    nth = F.size(F.filter(F.array(*[F.lit(int(c)).cast("long") for c in cuts]), lambda c: c <= key))
    start = F.element_at(F.array(*[F.lit(int(c)).cast("long") for c in cuts]), nth)
    end = F.coalesce(F.get(F.array(*[F.lit(int(c)).cast("long") for c in cuts]), nth), start + 1)
    rows = rows.withColumn("key", key).withColumn("range", F.struct(nth.alias("nth"), F.least(F.floor((F.col("key") - start) * parts / (end - start)), F.lit(parts - 1)).cast("long").alias("part")))
    heads = rows.groupBy("range").agg(F.min("key").alias("key"))
    order = Window.orderBy("range")
    last = F.max("range").over(Window.partitionBy())
    heads = heads.select("key", F.coalesce(F.lag("range").over(order), last).alias("before"))
    few = heads.count() <= BROADCAST_ROWS
    sent = rows.join(F.broadcast(heads) if few else heads, "key", "left")
    here = F.struct(F.lit(False).alias("copy"), F.col("range").alias("to"))
    there = F.struct(F.lit(True).alias("copy"), F.col("before").alias("to"))
    sent = sent.select("doc_id", "text", "key", F.explode(F.when(F.col("before").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("at")).select("doc_id", "text", "key", "at.*")
    following = F.lead("text").over(Window.partitionBy("to").orderBy("copy", "key", "text"))
    return sent.withColumn("next_text", following).where("not copy").select("doc_id", "text", "next_text")


def half_edited(text: Column, other: Column) -> Column:
    """The last half of ``text``'s code points replaced by the first as many (or all) of ``other``."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(other, F.lit(1), half))


def compared(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: fingerprints of the text and of its half-edited form, and their likeness to it and to the next document."""
    rows = with_next(docs, id_column, text_column).withColumn("edited", half_edited(F.col("text"), F.col("next_text")))
    rows = rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        anchors(F.col("text")).alias("a"), anchors(F.col("edited")).alias("b"), anchors(F.col("next_text")).alias("c"),
    )
    sets = [F.array_distinct(x).alias(f"d{x}") for x in "abc"]
    rows = rows.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("a")).alias("fingerprint"), fingerprint(F.col("b")).alias("edited_fingerprint"), *sets)
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("da"), F.col("db")).alias("near_edited"), likeness(F.col("da"), F.col("dc")).alias("near_next"))
