"""Packing by concatenate and cut: all documents are one stream of token ids, cut into windows of equal size.

Two passes. The first turns texts into ids and writes them to the shared checkpoint folder, one part per task; a part's
token total is all that leaves it. Prefix sums over the totals (one number per part) give each part the place of its first
token in the whole stream. The second pass adds a running sum inside the part and cuts each document where it crosses a
window: a document that lies over a boundary yields one record per window. No row moves between tasks, and no task holds
more than a batch of documents.

Nulls count as empty texts. An empty text is one piece that holds the end id alone. Rows that repeat are packed each on
their own. Only the id and text columns are read, so further columns may have any name. An empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import cut_lineage
from .base import LONG_WORD, Recent, arrow_bytes, giving_back, kept, slices, text_of

WINDOW = 4096
SENT_BYTES = 4 << 20  # of texts that a task sends its Python worker at once
SLICE_CHARS = 500_000  # of text that a worker splits into words at once
CACHED_BYTES = 160 << 20  # of words and their ids in one Python worker


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of a text by a tokenizer that drops white space and lowers case: each word between blanks is encoded once and
    remembered. A word of letters with one point or comma behind it is the word and the mark; many words of letters are
    encoded in one call and told apart by the ids that close a word.

    Holds for tokenizers that split at white space and between letters and marks, as ``word_bpe_49k`` (a test compares
    both ways). ``by_word=False`` encodes whole texts instead.
    """

    def __init__(self, path: str, by_word: bool = True, cached_bytes: int | None = None) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = by_word
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.marks = dict(zip(".,", self._encode([".", ","])))
        self.words = Recent(CACHED_BYTES if cached_bytes is None else cached_bytes)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_letters(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return self._encode(words)
        raw, at = ids.tobytes(), (np.r_[0, ends] * self.dtype.itemsize).tolist()
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of words; those of lower-case letters are worked out together, others are made of them or encoded alone."""
        learned: dict[str, bytes] = {"": b""}
        letters, other, made = set(), [], []
        for w in new:
            base, mark = (w[:-1], w[-1]) if w and w[-1] in ".," else (w, "")
            if not base.isalpha():
                other.append(w)
                continue
            low = base.lower() if base.isascii() else base
            letters.add(low)
            if low != w:
                made.append((w, low, mark))
        for words, encode in ((self.words.unknown(letters), self._encode_letters), (other, self._encode)):
            for i in range(0, len(words), 5_000):
                learned.update(zip(words[i : i + 5_000], encode(words[i : i + 5_000])))
        young = self.words.young
        for w, low, mark in made:
            ids = learned[low] if low in learned else young[low]
            learned[w] = ids + self.marks[mark] if mark else ids
        for w, ids in learned.items():
            if len(w) <= LONG_WORD:
                self.words.put(w, ids)
        return learned

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._encode(texts)
        self.words.turn()
        young, new = self.words.young, set()
        split = [t.replace("\n", " ").split(" ") for t in texts]
        ids = [list(map(young.get, ws)) for ws in split]
        short = [i for i, found in enumerate(ids) if None in found]
        for i in short:
            new.update([w for w, x in zip(split[i], ids[i]) if x is None])
        learned = self._learn(self.words.unknown(new)) if new else {}
        for i in short:
            ids[i] = [x if x is not None else young[w] if w in young else learned[w] for w, x in zip(split[i], ids[i])]
        return [b"".join(found) for found in ids]


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, by_word: bool = True, id_column: str = "doc_id", text_column: str = "text", cached_bytes: int | None = None) -> DataFrame:
    """(id, n_tokens, ids) of each document, the end id included; ids as little-endian integers of ``width`` bytes."""
    rows = docs.select(F.col(id_column).alias("id"), text_of(F.col(text_column)).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids_of = kept(WordIds, tokenizer, by_word, cached_bytes)
        end, width = np.array([end_id], ids_of.dtype).tobytes(), ids_of.dtype.itemsize
        for part in slices(batches, "text", SLICE_CHARS):
            ids = [x + end for x in ids_of(part.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array([len(x) // width for x in ids], pa.int64()), pa.array([width] * len(ids), pa.int32()), pa.array(ids, pa.binary())],
                names=["id", "n_tokens", "width", "ids"],
            )

    out = StructType([rows.schema["id"], *StructType.fromDDL("n_tokens bigint, width int, ids binary").fields])
    return rows.mapInArrow(giving_back(encode, keeps=True), out)


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = 2, by_word: bool = True, id_column: str = "doc_id", text_column: str = "text", cached_bytes: int | None = None, keeps: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset and the piece's ids (unsigned 32-bit, little-endian).

    Every sequence but the last is full, so only the last is ever padded. ``cached_bytes`` (``CACHED_BYTES``) of words are remembered by a
    Python worker: fewer cost time and change no row. Workers keep tokenizer and words for a packing that follows, unless ``keeps`` is false.
    """
    with arrow_bytes(docs.sparkSession, SENT_BYTES):
        tokens = cut_lineage(tokenize(docs, tokenizer or default_tokenizer(), end_id, by_word, id_column, text_column, cached_bytes))
    totals = tokens.groupBy(F.spark_partition_id().alias("part")).agg(F.sum("n_tokens").alias("n")).collect()  # one row per part
    sums = np.zeros(max((r.part for r in totals), default=-1) + 2, np.int64)
    for r in totals:
        sums[r.part + 1] = r.n
    begin = np.cumsum(sums)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = int(begin[min(TaskContext.get().partitionId(), len(begin) - 1)])  # the last parts may be empty
        for part in slices(batches, "ids", SLICE_CHARS):
            n = part.column("n_tokens").to_numpy()
            first = at + np.cumsum(n) - n
            at += int(n.sum())
            pieces = (first + n - 1) // window - first // window + 1
            row = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = first[row] // window + nth
            left = np.maximum(first[row], sequence * window)
            right = np.minimum(first[row] + n[row], (sequence + 1) * window)
            dtypes = {2: "<u2", 4: "<u4"}
            ids = [np.frombuffer(b, dtypes[w]).astype("<u4") for b, w in zip(part.column("ids").to_pylist(), part.column("width").to_pylist())]
            start = left - first[row]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id").take(pa.array(row)),
                    pa.array(start), pa.array(right - left), pa.array(n[row]), pa.array(sequence), pa.array(left - sequence * window),
                    pa.array([ids[r][s : s + k].tobytes() for r, s, k in zip(row, start, right - left)], pa.binary()),
                ],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    fields = StructType.fromDDL("start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary").fields
    return tokens.mapInArrow(giving_back(cut, keeps), StructType([StructField("doc_id", tokens.schema["id"].dataType), *fields]))


def padding(length: int, window: int = WINDOW) -> int:
    """Pad ids that a sequence of ``length`` ids needs: none at a power of two, else up to the window."""
    return 0 if length & (length - 1) == 0 else window - length
