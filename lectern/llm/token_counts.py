"""Token counts of a byte-level BPE by compiled finite-state transducers, without running the tokenizer over the texts.

Two deterministic transducers make up the tokenizer.

The splitter reads classes of code points (letter, number, blank, ...) and marks where a pre-token starts, as the usual pattern
of contractions, letters, numbers, other symbols and white space does; a mark it must wait for is set one code point later. It
has a dozen states, so what a chunk of text does is a map from state to state. The chunks of a batch are independent: their
maps are made side by side, composed by a parallel prefix scan, and each chunk then knows the state it starts in and sets its
marks. The end of a text is a symbol that leads every state to the first one.

The counter reads the bytes of a pre-token; each transition carries the number of tokens that the byte adds (below zero where
a merge takes effect). Its state holds the places at which a longer token may still begin: the node of the token trie reached
from there, the token that ends there, and its count. A token may follow another exactly if BPE keeps the seam between them
(``Merges.keeps``), so one token alone can end at each place, and the state after a byte follows from the state before it.
States and transitions are compiled when first met, into a table that all pre-tokens of a batch walk in step.

One map, no shuffle. A Python worker keeps the compiled transducers over its tasks, bounded by ``MAX_STATES``, beyond which
it starts compiling anew: that costs time and changes nothing.

Nulls count as empty texts, which have no tokens. Rows that repeat are counted each. Very long texts are cut at white space,
where a pre-token always starts, so memory follows the window, or the longest stretch of text without white space if that is
longer. Only the id and text columns are read, so further columns may have any name. An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .base import giving_back, kept, slices, text_of

WINDOW_BYTES = 1 << 20  # bytes of text that are walked at once
CHUNK = 64  # code points of a chunk of the splitter
MAX_STATES = 400_000  # of the counter: with their transitions about 200 MB of a Python worker
LONG = 96  # bytes; longer pre-tokens are walked on their own

# symbols of the splitter
END, LETTER, STMD, R, V, LOW_L, LOW_E, NUMBER, BLANK, WHITE, QUOTE, OTHER, SPECIAL, SKIP = SYMBOLS = range(14)
LETTERS = (LETTER, STMD, R, V, LOW_L, LOW_E)
# states: nothing open, runs, a quote mark that may open a contraction, then with its letter, white space of one or more
(FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, AT_QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, ONE_BLANK, TO_BLANK, ONE_WHITE, TO_WHITE) = STATES = range(12)
HERE, BEFORE = 1, 2  # a pre-token starts at this code point, at the one before
PATTERN_NAME = "ByteLevel"


def _opened(symbol: int) -> int:
    """State after a pre-token that starts with ``symbol``."""
    if symbol in LETTERS:
        return IN_LETTERS
    return {NUMBER: IN_NUMBERS, OTHER: IN_OTHER, QUOTE: AT_QUOTE, BLANK: ONE_BLANK, WHITE: ONE_WHITE}.get(symbol, FRESH)


def _splitter(state: int, symbol: int) -> tuple[int, int]:
    """(next state, marks) of one transition."""
    if symbol == SKIP:
        return state, 0
    here = 0 if symbol == END else HERE
    if state in (QUOTE_R, QUOTE_V, QUOTE_L):
        if (state, symbol) in ((QUOTE_R, LOW_E), (QUOTE_V, LOW_E), (QUOTE_L, LOW_L)):
            return FRESH, 0
        following, marks = _splitter(IN_LETTERS, symbol)
        return following, marks | BEFORE
    if state == AT_QUOTE:
        if symbol == STMD:
            return FRESH, 0
        if symbol in (R, V, LOW_L):
            return {R: QUOTE_R, V: QUOTE_V, LOW_L: QUOTE_L}[symbol], 0
        if symbol in (QUOTE, OTHER):
            return IN_OTHER, 0
    if symbol in (BLANK, WHITE) and state >= ONE_BLANK:
        return (TO_BLANK if symbol == BLANK else TO_WHITE), 0
    if symbol not in (END, SPECIAL) and state in (ONE_BLANK, TO_BLANK):  # the last blank belongs to what follows it
        return (IN_OTHER if symbol == QUOTE else _opened(symbol)), (BEFORE if state == TO_BLANK else 0)
    if state == TO_WHITE and symbol not in (END, SPECIAL):
        return _opened(symbol), BEFORE | HERE
    goes_on = (state == IN_LETTERS and symbol in LETTERS) or (state == IN_NUMBERS and symbol == NUMBER) or (state == IN_OTHER and symbol in (OTHER, QUOTE))
    return (state, 0) if goes_on else (_opened(symbol), here)


_TABLE = np.array([[_splitter(q, a) for a in SYMBOLS] for q in STATES])
NEXT, MARKS = _TABLE[:, :, 0].astype(np.uint8), _TABLE[:, :, 1].astype(np.uint8)


def _maps_of_four() -> np.ndarray:
    """State maps of all words of four symbols, flat: (word, state) -> state."""
    one = NEXT.T.astype(np.uint8)  # symbol, state
    maps = one
    for _ in range(3):
        maps = one[:, maps].transpose(1, 0, 2).reshape(-1, len(STATES))  # append a symbol
    return maps.reshape(-1)


_FOUR = _maps_of_four()


def chunk_maps(symbols: np.ndarray) -> np.ndarray:
    """State map of each chunk (a row of ``symbols``): (chunk, state) -> state."""
    n = len(SYMBOLS)
    words = symbols.reshape(len(symbols), -1, 4).astype(np.int32)
    words = (((words[:, :, 0] * n + words[:, :, 1]) * n + words[:, :, 2]) * n + words[:, :, 3]) * len(STATES)
    maps = np.broadcast_to(np.arange(len(STATES), dtype=np.int32), (len(symbols), len(STATES)))
    for k in range(words.shape[1]):
        maps = _FOUR[words[:, k, None] + maps]
    return maps


def scan(maps: np.ndarray) -> np.ndarray:
    """Each chunk's map after those of all chunks before it: log2 rounds of composition, each over all chunks at once."""
    step = 1
    while step < len(maps):
        maps = np.concatenate([maps[:step], np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), 1)])
        step *= 2
    return maps


def pre_token_starts(symbols: np.ndarray) -> np.ndarray:
    """Mask over the symbols: where a pre-token starts."""
    n = len(symbols)
    chunks = np.full(-(-n // CHUNK) * CHUNK, SKIP, np.uint8)
    chunks[:n] = symbols
    chunks = chunks.reshape(-1, CHUNK)
    state = np.full(len(chunks), FRESH, np.intp)
    state[1:] = scan(chunk_maps(chunks))[:-1, FRESH]
    columns, marks = np.ascontiguousarray(chunks.T), np.empty((CHUNK, len(chunks)), np.uint8)
    next_state, marks_of = NEXT.reshape(-1), MARKS.reshape(-1)
    for k in range(CHUNK):
        at = state * len(SYMBOLS) + columns[k]
        marks[k] = marks_of[at]
        state = next_state[at].astype(np.intp)
    flat = marks.T.reshape(-1)
    starts = (flat & HERE) != 0
    starts[:-1] |= (flat[1:] & BEFORE) != 0
    return starts[:n]


class Merges:
    """Tokens of a byte-level BPE file, the trie of their bytes, and which tokens may stand side by side."""

    def __init__(self, spec: dict) -> None:
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
        known = model["type"] == "BPE" and split.get("type") == PATTERN_NAME and split.get("use_regex", True) and not split.get("add_prefix_space")
        added = spec.get("added_tokens") or []
        if odd or not known or spec.get("normalizer") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("only plain byte-level BPE files are compiled")
        self.special = sorted((t["content"].encode() for t in added), key=len, reverse=True)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the file writes as themselves
        others = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        self.parts: list[tuple[int, int] | None] = [None] * 256
        ids = {chr_: b for chr_, b in byte_of.items()}
        self.rank: dict[tuple[int, int], int] = {}
        for left, right in (m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            if left + right in ids:
                raise ValueError("a token of two merges")
            pair = ids[left], ids[right]
            self.rank[pair] = ids[left + right] = len(self.parts)
            self.parts.append(pair)
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        self.token: list[int] = [-1]
        self.inner: list[bool] = [False]
        for name, t in ids.items():
            node = 0
            for b in (byte_of[c] for c in name):
                self.inner[node] = True
                key = node << 8 | b
                node = self.child.setdefault(key, len(self.token))
                if node == len(self.token):
                    self.token.append(-1)
                    self.inner.append(False)
            self.token[node] = t
        for node, t in enumerate(self.token):
            if t >= 256 and not self._whole(t):  # a token that its own merges never give
                self.token[node] = -1
        self.seams: dict[int, bool] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int, float]]:
        """(piece, rank at which it is made, rank at which it is merged on) at one edge of a token, largest piece first."""
        out, gone = [], float("inf")
        while True:
            made = token if token >= 256 else -1  # a token's number is the rank of its merge
            out.append((token, made, gone))
            if made < 0:
                return out
            gone, token = made, self.parts[token][side]

    def _apart(self, left: int, right: int, before: float) -> bool:
        """True if no merge of a rank below ``before`` joins pieces over the seam between two tokens.

        Two pieces that meet there are joined when their merge comes up while both are there. On equal ranks the merge
        further left goes first: the left piece is taken by its own token, the right piece by the seam.
        """
        lefts, rights = self._edge(left, 1), self._edge(right, 0)
        for a, made_a, gone_a in lefts:
            for b, made_b, gone_b in rights:
                rank = self.rank.get((a, b))
                if rank is not None and max(made_a, made_b) < rank < before and rank < gone_a and rank <= gone_b:
                    return False
        return True

    def _whole(self, token: int) -> bool:
        left, right = self.parts[token]
        return self._apart(left, right, token) and all(t < 256 or self._whole(t) for t in (left, right))

    def keeps(self, left: int, right: int) -> bool:
        """True if BPE of the two tokens' bytes gives the two tokens."""
        key = left << 20 | right
        found = self.seams.get(key)
        if found is None:
            found = self.seams[key] = self._apart(left, right, float("inf"))
        return found


class Counter:
    """The counting transducer: states are compiled when first met, transitions stand in an open-addressing table."""

    NONE = (1 << 20) - 1  # in place of a token where a pre-token starts

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self.forget()

    def forget(self) -> None:
        first = (self._entry(0, self.NONE, 0),)
        self.states: list[tuple[int, ...]] = [first]
        self.number = {first: 0}
        self.merges.seams.clear()
        self.n, self.size = 0, 1 << 16
        self.keys, self.values = np.full(self.size, -1, np.int64), np.zeros(self.size, np.int64)

    @staticmethod
    def _entry(node: int, token: int, count: int) -> int:
        return node << 40 | token << 16 | count + (1 << 15)

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, tokens added) on a byte."""
        m, kept, ends = self.merges, [], None
        for entry in self.states[state]:
            node = m.child.get(entry >> 40 << 8 | byte)
            if node is None:
                continue
            token, last = m.token[node], entry >> 16 & self.NONE
            if token >= 0 and (last == self.NONE or m.keeps(last, token)):
                ends = token, (entry & 0xFFFF) - (1 << 15) + 1
            if m.inner[node]:
                kept.append((node, entry))
        token, added = ends
        following = (*[node << 40 | (entry & 0xFFFFFFFFFF) - added for node, entry in kept], self._entry(0, token, 0))
        number = self.number.setdefault(following, len(self.states))
        if number == len(self.states):
            self.states.append(following)
        return number, added

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.int64(-7046029254386353131)) >> np.int64(20)) & (self.size - 1)

    def _add(self, keys: np.ndarray, values: np.ndarray) -> None:
        if 2 * (self.n + len(keys)) > self.size:
            old = self.keys >= 0
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            self.n = 0
            while 2 * len(keys) > self.size:
                self.size *= 2
            self.size *= 2
            self.keys, self.values = np.full(self.size, -1, np.int64), np.zeros(self.size, np.int64)
        self.n += len(keys)
        at = self._slots(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of several keys for a slot the last one stays
            done = self.keys[at] == keys
            self.values[at[done]] = values[done]
            keys, values, at = keys[~done], values[~done], (at[~done] + 1) & (self.size - 1)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Transitions (next state << 16 | tokens added, shifted), -1 where none is compiled yet."""
        at = self._slots(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.values[at], -1)
        left = np.flatnonzero((seen != keys) & (seen >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) & (self.size - 1)
            seen = self.keys[at]
            hit = seen == keys[left]
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (seen >= 0)
            left, at = left[on], at[on]
        return out

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = state << 8 | byte
        found = self._find(keys)
        missing = found < 0
        if missing.any():
            new, back = np.unique(keys[missing], return_inverse=True)
            made = np.array([(q << 16) + added + (1 << 15) for q, added in (self.compile(k >> 8, k & 255) for k in new.tolist())], np.int64)
            self._add(new, made)
            found[missing] = made[back]
        return found >> 16, (found & 0xFFFF) - (1 << 15)

    def count(self, data: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Tokens of each span of ``data``; all spans go through the transducer in step, longest first."""
        counts = np.zeros(len(first), np.int64)
        for i in np.flatnonzero(length > LONG).tolist():
            counts[i] = self._count_long(data[first[i] : first[i] + length[i]].tobytes())
        order = np.argsort(-length, kind="stable")
        order = order[np.searchsorted(-length[order], -LONG) :]
        at, sizes = first[order], length[order]
        state, total = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        active = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), "right").tolist()
        for k, n in enumerate(active):
            state[:n], added = self.step(state[:n], data[at[:n] + k].astype(np.int64))
            total[:n] += added
        counts[order] = total
        return counts

    def _count_long(self, raw: bytes) -> int:
        known: dict[int, tuple[int, int]] = {}
        state = total = 0
        for b in raw:
            key = state << 8 | b
            found = known.get(key)
            if found is None:
                found = known[key] = self.compile(state, b)
            state, added = found
            total += added
        return total


def _symbol_table() -> np.ndarray:
    """Symbol of each code point, with the library's own notion of letters, numbers and white space."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    points = np.r_[0:0xD800, 0xE000:0x110000]
    table = np.full(0x110000, OTHER, np.uint8)
    for pattern, symbol in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", WHITE)):
        split = Split(Regex(pattern), "removed", invert=True)
        for block in np.split(points, range(4096, len(points), 4096)):
            for _, (a, b) in split.pre_tokenize_str(block.astype("<u4").tobytes().decode("utf-32-le")):
                table[block[a:b]] = symbol
    for text, symbol in (("stmd", STMD), ("r", R), ("v", V), ("l", LOW_L), ("e", LOW_E), (" ", BLANK), ("'", QUOTE)):
        table[[ord(c) for c in text]] = symbol
    return table


class TokenCounter:
    """Token counts of texts, equal to those of the tokenizer that ``path`` describes."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            merges = Merges(json.load(f))
        self.counter, self.symbols = Counter(merges), _symbol_table()
        self.byte_symbols = np.full(256, SKIP, np.uint8)
        self.byte_symbols[:128], self.byte_symbols[255] = self.symbols[:128], END
        self.special = re.compile(b"|".join(map(re.escape, merges.special))) if merges.special else None

    def _read(self, data: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(offset, symbol) of each code point of texts that a byte 255 follows each."""
        at = np.flatnonzero((data & 0xC0) != 0x80)
        lead = data[at]
        symbols = self.byte_symbols[lead]
        for low, high, bits, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0xF8, 0x07, 3)):
            these = np.flatnonzero((lead >= low) & (lead < high))
            point = (lead[these] & bits).astype(np.int64)
            for k in range(1, more + 1):
                point = point << 6 | data[at[these] + k] & 0x3F
            symbols[these] = self.symbols[point]
        for m in self.special.finditer(raw) if self.special else ():
            a, b = np.searchsorted(at, m.span())
            symbols[a:b] = SKIP
            symbols[a] = SPECIAL
        return at, symbols

    def _window(self, texts: list[bytes]) -> np.ndarray:
        raw = b"\xff".join(texts) + b"\xff"
        data = np.frombuffer(raw, np.uint8)
        at, symbols = self._read(data, raw)
        starts = pre_token_starts(symbols)
        edges = np.flatnonzero(starts | (symbols == END))
        token, first = symbols[edges], at[edges]
        spans = np.flatnonzero(token[:-1] != END)
        bpe = spans[token[spans] != SPECIAL]
        counts = np.zeros(len(edges), np.int64)
        counts[spans] = 1
        counts[bpe] = self.counter.count(data, first[bpe], first[bpe + 1] - first[bpe])
        return np.diff(np.cumsum(counts)[token == END], prepend=0)

    def counts(self, texts: list[bytes]) -> list[int]:
        out, held, owners, size = np.zeros(len(texts), np.int64), [], [], 0
        for i, text in enumerate(texts):
            for piece in _cut(text):
                if size + len(piece) > WINDOW_BYTES and held:
                    np.add.at(out, owners, self._window(held))
                    held, owners, size = [], [], 0
                    if len(self.counter.states) > MAX_STATES:
                        self.counter.forget()
                held.append(piece)
                owners.append(i)
                size += len(piece)
        if held:
            np.add.at(out, owners, self._window(held))
        return out.tolist()


_SAFE = re.compile(rb"[!-~](?=[ \t\n])")


def _cut(text: bytes) -> Iterator[bytes]:
    """A long text in pieces of about a window, cut before white space, where a pre-token always starts."""
    a = 0
    while len(text) - a > WINDOW_BYTES:
        found = _SAFE.search(text, a + WINDOW_BYTES - 1)
        if found is None:
            break
        yield text[a : found.end()]
        a = found.end()
    yield text[a:]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def count_tokens(docs: DataFrame, tokenizer: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each row."""
    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col(id_column).alias("doc_id"), text_of(F.col(text_column)).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept(TokenCounter, path)
        for part in slices(batches, "text"):
            texts = part.column("text").cast(pa.binary()).to_pylist()
            columns = [part.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(counter.counts(texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens"])

    fields = StructType.fromDDL("n_bytes bigint, n_tokens bigint").fields
    return rows.mapInArrow(giving_back(count, keeps=True), StructType([StructField("doc_id", rows.schema["doc_id"].dataType), *fields]))
