"""Toxicity by subword bags: averaged character n-gram embeddings under a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (3 to 5 code points, with a mark at both ends), hashed into ``buckets`` rows of an
embedding table; a passage of ``span`` words is the mean of its words. Table and softmax are trained together, so a
misspelling that was never seen is scored by the n-grams it shares. A document is toxic if a passage is: passages overlap
by half and the document takes its highest, so a long text is not averaged away. In training the passages of a toxic
document count as toxic only where the model ranks them highest; all passages of a clean document are clean.

Learned on a bounded sample (about ``per_label`` documents of each label, by a hash of the id), on the driver. Scoring is a map over whole texts: no row moves. Since the softmax is linear in the mean, a word is one
number, which a task remembers. Empty and null texts score 0. Rows with a null label are not learned from; without rows of
both labels every score is 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .base import LONG_WORD, Recent, giving_back, slices, text_of

WORD = re.compile(r"\w+")
CACHED_BYTES = 96 << 20  # of words and their values in one task


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 18
    dim: int = 4
    span: int = 6  # words of a passage
    per_label: int = 1_800  # about so many documents of each label are learned from
    per_doc: int = 24  # passages of a document that a round takes at random, on average
    rounds: int = 9
    epochs: int = 1
    rate: float = 0.2
    threshold: float = 0.3


def subwords(words: list[str], buckets: int, part: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all words, word by word, and where each word begins."""
    found = [_subwords(words[i : i + part], buckets) for i in range(0, len(words), part)]
    before = np.cumsum([0, *(len(code) for code, _ in found)])
    return np.concatenate([code for code, _ in found]), np.concatenate([begin + n for (_, begin), n in zip(found, before)])


def _subwords(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    marked = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    ends = np.cumsum(lengths)
    left = np.repeat(ends, lengths) - np.arange(len(marked))  # code points to the end of the word
    owner = np.repeat(np.arange(len(words)), lengths)
    codes, owners = [], []
    value = np.zeros(len(marked), np.uint64)
    for n in range(1, 6):
        value = value[: len(marked) - n + 1] * np.uint64(1_000_003) + marked[n - 1 :]
        if n < 3:
            continue
        inside = left[: len(value)] >= n
        mixed = (value[inside] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        codes.append(((mixed >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32))
        owners.append(owner[: len(value)][inside])
    owner, code = np.concatenate(owners), np.concatenate(codes)
    order = np.argsort(owner, kind="stable")
    owner, code = owner[order], code[order]
    return code, np.searchsorted(owner, np.arange(len(words)))


def passages(n_words: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Passages of each text that overlap by half and cover all: text and first word of each."""
    step = span // 2
    count = np.where(n_words > span, -(-(n_words - span) // step) + 1, (n_words > 0).astype(np.int64))
    text = np.repeat(np.arange(len(n_words)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return text, np.maximum(0, np.minimum(nth * step, n_words[text] - span))


@dataclass(frozen=True)
class Model:
    """What scoring needs: each bucket's share of the logit, and the bias."""

    weights: np.ndarray
    bias: float
    settings: Settings

    def of_words(self, words: list[str]) -> np.ndarray:
        code, begin = subwords(words, self.settings.buckets)
        counts = np.diff(np.append(begin, len(code)))
        return np.add.reduceat(self.weights[code], begin) / counts

    def top(self, values: np.ndarray) -> float:
        """The highest logit among a document's passages, from its words' values."""
        n, span = len(values), self.settings.span
        sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        if n <= span:
            return float(sums[-1] / n + self.bias)
        starts = np.append(np.arange(0, n - span, span // 2), n - span)
        return float(((sums[starts + span] - sums[starts]) / span).max() + self.bias)

    def score(self, values: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.top(values), -500, 500)))) if len(values) else 0.0


def train(texts: list[str], labels: list[int], settings: Settings = Settings(), clean_weight: float = 1.0) -> Model:
    """Fit table and softmax on whole texts with labels 0 and 1, and the scale of the scores on every fifth text, kept apart.

    ``clean_weight`` is how many clean documents one of the sample stands for, per toxic one.
    """
    apart = np.arange(len(texts)) % 5 == 4
    model = _fit([t for t, a in zip(texts, apart) if not a], [y for y, a in zip(labels, apart) if not a], settings)
    tops = np.array([model.top(model.of_words(ws)) if (ws := WORD.findall(t.lower())) else model.bias for t in np.array(texts, object)[apart]])
    y = np.array(labels)[apart]
    if not 0 < y.sum() < len(y):
        return model
    # logistic regression of the label on a document's highest logit, with smoothed labels
    goal = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    weight = np.where(y == 1, 1.0, clean_weight)
    x = np.stack([tops, np.ones(len(tops))], axis=1)
    fit = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ fit, -30, 30)))
        grad = x.T @ (weight * (p - goal)) + np.array([0.01 * (fit[0] - 0.5), 0])
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([0.01, 1e-6])
        fit = fit - np.clip(np.linalg.solve(hess, grad), -1, 1)
    slope = max(float(fit[0]), 0.01)
    return Model(model.weights * np.float32(slope), float(model.bias * slope + fit[1]), settings)


def _fit(texts: list[str], labels: list[int], settings: Settings) -> Model:
    """Table and softmax.

    Each round takes some passages of every document at random and, from the second on, those that the model ranks highest:
    in a toxic document they are what is toxic, in a clean one the hardest examples. The table starts at zero, so an n-gram
    that was never learned adds nothing to a score.
    """
    s, rng = settings, np.random.default_rng(7)
    empty = Model(np.zeros(s.buckets, np.float32), -1e9, s)
    ids: dict[str, int] = {}
    words_of = [np.array([ids.setdefault(w, len(ids)) for w in WORD.findall(t.lower())], np.int32) for t in texts]
    n_words = np.array([len(w) for w in words_of], np.int64)
    row_doc, at_word = passages(n_words, s.span)
    label = np.array(labels, np.int64)[row_doc] if len(row_doc) else np.zeros(0, np.int64)
    if len(set(label.tolist())) < 2:
        return empty
    flat = np.concatenate([*words_of, np.full(s.span, -1, np.int32)])
    del words_of
    length = np.minimum(n_words[row_doc], s.span)
    start = at_word + (np.cumsum(n_words) - n_words)[row_doc]
    code, begin = subwords(list(ids), s.buckets)
    counts = np.diff(np.append(begin, len(code)))
    used, slot = np.unique(code.astype(np.int32), return_inverse=True)
    slot = slot.astype(np.int32)
    del code
    table, out = np.zeros((len(used), s.dim), np.float32), rng.normal(0, 0.5, (s.dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    table_sq, out_sq = np.full(len(used), 1e-8, np.float32), 1e-8
    first, size = np.flatnonzero(np.r_[True, row_doc[1:] != row_doc[:-1]]), len(row_doc)
    per_doc = np.diff(np.append(first, size))

    def logits() -> np.ndarray:
        word = np.add.reduceat((table @ (out[:, 1] - out[:, 0]))[slot], begin) / counts
        sums = np.concatenate([[0.0], np.cumsum(np.append(word, 0)[flat])])
        return (sums[start + length] - sums[start]) / length + bias[1] - bias[0]

    for turn in range(s.rounds):
        few = rng.random(size) < np.repeat(s.per_doc / per_doc, per_doc)
        if turn:
            z = logits()
            best = z >= np.repeat(np.maximum.reduceat(z, first), per_doc)
            pool = np.flatnonzero(np.where(label == 1, best | (z > 2.0), best | (few & (rng.random(size) < 0.3)) | (z > -1.0)))
        else:
            pool = np.flatnonzero(few)
        share_toxic = max(1.0, 0.5 * (label[pool] == 0).sum() / max(1, (label[pool] == 1).sum())) if turn else 1.0
        for _ in range(s.epochs):
            rng.shuffle(pool)
            for at in range(0, len(pool), 256):
                batch = pool[at : at + 256]
                present = np.arange(s.span) < length[batch][:, None]
                w = np.where(present, flat[start[batch][:, None] + np.arange(s.span)], -1)
                words, back = np.unique(w, return_inverse=True)
                back, real = back.reshape(w.shape), words >= 0
                wid = words[real]
                starts = np.cumsum(counts[wid]) - counts[wid]
                grams = slot[np.arange(counts[wid].sum()) + np.repeat(begin[wid] - starts, counts[wid])]
                vectors = np.zeros((len(words), s.dim), np.float32)
                vectors[real] = np.add.reduceat(table[grams], starts) / counts[wid][:, None]
                share = (present / length[batch][:, None]).astype(np.float32)
                mean = (vectors[back] * share[:, :, None]).sum(axis=1)
                z = mean @ out + bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(batch)), label[batch]] -= 1
                p *= np.where(label[batch] == 1, share_toxic, 1.0)[:, None] / len(batch)
                pull = (share[:, :, None] * (p @ out.T)[:, None, :]).reshape(-1, s.dim)
                d_word = np.stack([np.bincount(back.ravel(), pull[:, k], len(words)) for k in range(s.dim)], axis=1)[real]
                per_gram = np.repeat(d_word / counts[wid][:, None], counts[wid], axis=0)
                touched, where = np.unique(grams, return_inverse=True)
                d_table = np.stack([np.bincount(where, per_gram[:, k], len(touched)) for k in range(s.dim)], axis=1).astype(np.float32)
                d_out = mean.T @ p
                table_sq[touched] += (d_table**2).mean(axis=1)
                table[touched] -= s.rate * d_table / np.sqrt(table_sq[touched])[:, None]
                out_sq += float((d_out**2).mean())
                out -= (0.1 * s.rate * d_out / np.sqrt(out_sq)).astype(np.float32)
                bias -= (s.rate * p.sum(axis=0)).astype(np.float32)
    weights = np.zeros(s.buckets, np.float32)
    weights[used] = table @ (out[:, 1] - out[:, 0])
    return Model(weights, float(bias[1] - bias[0]), s)


class Scorer:
    """Scores whole texts; remembers the values of words."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, Recent(CACHED_BYTES)

    def __call__(self, texts: list[str | None]) -> list[float]:
        words = [WORD.findall((t or "").lower()) for t in texts]
        self.known.turn()
        new, values = self.known.unknown({w for ws in words for w in ws}), {}
        for i in range(0, len(new), 50_000):
            for w, value in zip(new[i : i + 50_000], self.model.of_words(new[i : i + 50_000]).tolist()):
                if len(w) > LONG_WORD:
                    values[w] = value
                else:
                    self.known.put(w, value)
        young = self.known.young
        return [self.model.score(np.array([young[w] if w in young else values[w] for w in ws])) for ws in words]


def learn(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> Model:
    """A model from the documents that ``labels`` (id, label) marks; a document marked both ways counts as toxic."""
    marks = labels.select(F.col(id_column).alias("_id"), F.col(label_column).cast("int").alias("_label")).where("_id is not null and _label in (0, 1)")
    marks = marks.groupBy("_id").agg(F.max("_label").alias("_label"))
    share = {r._label: settings.per_label / r["count"] for r in marks.groupBy("_label").count().collect()}  # two rows
    if len(share) < 2:
        return _fit([], [], settings)
    place = F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    chosen = marks.where(place < F.when(F.col("_label") == 1, share[1]).otherwise(share[0]))
    rows = docs.select(F.col(id_column).alias("_id"), text_of(F.col(text_column)).alias("_text")).join(F.broadcast(chosen), "_id")  # at most about 2 x per_label rows
    sample = rows.select("_text", "_label").orderBy(F.xxhash64("_text"), "_text", "_label").toPandas()
    return train(sample["_text"].tolist(), sample["_label"].tolist(), settings, share[1] / share[0])


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, score (0 to 1), predicted (1 from the threshold on)."""
    rows = docs.select(F.col(id_column).alias("doc_id"), text_of(F.col(text_column)).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ``buckets`` floats

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_of = Scorer(shared.value)
        for part in slices(batches, "text"):
            scores = score_of(part.column("text").to_pylist())
            flags = [int(x >= shared.value.settings.threshold) for x in scores]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64()), pa.array(flags, pa.int32())], names=["doc_id", "score", "predicted"])

    return rows.mapInArrow(giving_back(predict), StructType([StructField("doc_id", rows.schema["doc_id"].dataType), *StructType.fromDDL("score double, predicted int").fields]))


def accepted(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, as they are, whose text scores below the threshold; rows that repeat are each judged.

    Further columns may have any names. An empty table gives an empty one.
    """
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # maps over batches take no names with dots
    text = f"c{docs.columns.index(text_column)}"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_of = Scorer(shared.value)
        for part in slices(batches, text):
            yield part.filter(pa.array([x < shared.value.settings.threshold for x in score_of(part.column(text).to_pylist())], pa.bool_()))

    return numbered.mapInArrow(giving_back(keep), numbered.schema).toDF(*docs.columns)
