"""Word shingles of texts as 64-bit hashes, for many texts at a time in numpy."""

from __future__ import annotations

import numpy as np

WORDS = 5  # of a shingle
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
PRIME, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs without blanks) of all texts, and the number of words of each text."""
    raw = [t.encode("utf-8", "replace") + b" " for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(r) for r in raw])
    blank = BLANK[data]
    start = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]])) if len(data) else np.zeros(0, np.int64)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    stop = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
    lengths = stop - start
    powers = np.cumprod(np.full(int(lengths.max()) + 1, PRIME))
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    body = data[~blank].astype(np.uint64) + np.uint64(1)
    words = mixed(np.add.reduceat(body * powers[at], np.cumsum(lengths) - lengths))
    return words, np.diff(np.searchsorted(start, np.concatenate([[0], ends])))


def shingle_sets(texts: list[str], k: int = WORDS) -> list[np.ndarray]:
    """The distinct shingles of each text, in order; a text of fewer than ``k`` words has one, all its words; none without words."""
    words, counts = word_hashes(texts)
    value = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i in range(k):
        value = (value ^ words[i : i + len(value)]) * PRIME + np.uint64(i + 1)
    value = mixed(value)
    out, at = [], 0
    for n in counts.tolist():
        if n >= k:
            out.append(np.unique(value[at : at + n - k + 1]))
        elif n:
            h = np.uint64(n)
            with np.errstate(over="ignore"):
                for w in words[at : at + n]:
                    h = (h ^ w) * PRIME
            out.append(mixed(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out
