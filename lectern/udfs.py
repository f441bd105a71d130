"""Extension points: models the caller supplies, run as Arrow-batched pandas UDFs.

Each hook takes a plain function over a list of texts (and raises on failure); the wrappers here
add prefixes, batching, retries and error isolation, and return errors as rows.
"""

from __future__ import annotations

import random
import re
import time
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.text import RETRYABLE_PATTERN
from .operators.vector import BATCH_ROWS, BATCH_TOKENS, MAX_CHARS
from .schemas import LOCATOR

Embedder = Callable[[list[str]], Sequence[Sequence[float]]]
Completer = Callable[[str], str]
PairScorer = Callable[[list[str], list[str]], Sequence[float]]

# Text prefixes the E5 embedding family was trained with; retries of model calls.
PREFIXED_FAMILY = r"(?:multilingual-)?e5-(?:small|base)(?:-v2)?$"
_HAN = r"\u3400-\u9fff\uf900-\ufaff"
TOKENS = re.compile(rf"[{_HAN}]|(?:(?![{_HAN}])\w)+|[^\w\s]")  # as the text functions count them, for sizing requests
PREFIX = {"document": "passage: ", "query": "query: "}
MAX_RETRIES, RETRY_BASE_S, RETRY_MAX_S = 4, 1.5, 20.0


def prefix_for(model_id: str, kind: str) -> str:
    return PREFIX[kind] if re.search(PREFIXED_FAMILY, model_id) else ""


def hashing_embedder(dims: int = 64) -> Embedder:
    """A model-free default: signed feature hashing of lower-case words."""

    def embed(texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            vec = np.zeros(dims)
            for word in t.lower().split():
                h = zlib.crc32(word.encode())
                vec[h % dims] += 1.0 if h & 0x10000 else -1.0
            out.append(vec)
        return out

    return embed


def _unit(vec: Sequence[float]) -> list[float]:
    v = np.asarray(vec, dtype=np.float64)
    norm = float(np.sqrt((v * v).sum()))
    return (v if norm == 0 else v / norm).tolist()


def _embed_batch(texts: list[str], fn: Embedder) -> list[tuple[list[float] | None, str | None]]:
    """Vectors for a batch; if the batch fails, each text is tried alone so that one bad text costs only itself."""
    try:
        vectors = list(fn(texts))
        if len(vectors) != len(texts):
            raise ValueError(f"model returned {len(vectors)} vectors for {len(texts)} texts")
        return [(_unit(v), None) for v in vectors]
    except Exception as e:  # noqa: BLE001 - reported as a row
        if len(texts) == 1:
            return [(None, str(e))]
        return [_embed_batch([t], fn)[0] for t in texts]


def token_batches(texts: list[str]) -> Iterator[list[str]]:
    """VEC-4: the texts in order, as many at a time as rows and tokens of a request allow; one over the tokens goes alone."""
    part, tokens = [], 0
    for t in texts:
        n = len(TOKENS.findall(t))
        if part and (len(part) == BATCH_ROWS or tokens + n > BATCH_TOKENS):
            yield part
            part, tokens = [], 0
        part.append(t)
        tokens += n
    if part:
        yield part


def embed(model_id: str, fn: Embedder, kind: str) -> Callable[[Column], Column]:
    """UDF-2/VEC-3: column function text -> struct(vec, error)."""
    prefix = prefix_for(model_id, kind)

    @F.pandas_udf("vec array<float>, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for part in token_batches([prefix + (t or "")[:MAX_CHARS] for t in batch]):
                rows += _embed_batch(part, fn)
            yield pd.DataFrame(rows, columns=["vec", "error"])

    return run


def embed_documents(chunks: DataFrame, model_id: str, fn: Embedder) -> DataFrame:
    """VEC-3: (file_hash, chunk_id, model_id, vec, error)."""
    out = chunks.select("file_hash", "chunk_id", F.lit(model_id).alias("model_id"), embed(model_id, fn, "document")(F.col("content")).alias("e"))
    return out.select("file_hash", "chunk_id", "model_id", "e.vec", "e.error")


def embed_queries(queries: DataFrame, model_id: str, fn: Embedder) -> DataFrame:
    """VEC-3: (query_id, qvec); a query whose embedding failed keeps a null vector and falls back to BM25."""
    out = queries.select("query_id", embed(model_id, fn, "query")(F.col("text")).alias("e"))
    return out.select("query_id", F.col("e.vec").alias("qvec"))


def call_with_retry(fn: Completer, prompt: str, sleep: Callable[[float], None] = time.sleep) -> str:
    """One model call: overload and rate-limit errors are retried with growing pauses, others raise at once."""
    for attempt in range(MAX_RETRIES):
        try:
            answer = fn(prompt).strip()
            if not answer:
                raise ValueError("model returned empty content")
            return answer
        except Exception as e:  # noqa: BLE001
            if attempt == MAX_RETRIES - 1 or not re.search(RETRYABLE_PATTERN, str(e)):
                raise
            sleep(min(RETRY_MAX_S, RETRY_BASE_S * 2**attempt) + random.random() * 0.5)
    raise AssertionError("unreachable")


def complete(fn: Completer) -> Callable[[Column], Column]:
    """UDF-4: column function prompt -> struct(text, error)."""

    @F.pandas_udf("text string, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for prompt in batch:
                try:
                    rows.append((call_with_retry(fn, prompt), None))
                except Exception as e:  # noqa: BLE001 - reported as a row
                    rows.append((None, str(e)))
            yield pd.DataFrame(rows, columns=["text", "error"])

    return run


def score_pairs(fn: PairScorer) -> Callable[[Column, Column], Column]:
    """UDF-3: column function (query, text) -> relevance score."""

    @F.pandas_udf("double")
    def run(query: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series(list(fn(list(query), list(text))), dtype="float64")

    return run


@dataclass(frozen=True)
class Extracted:
    """What an extractor may return besides plain text: locators (entries of ``schemas.LOCATOR`` fields with ``char_start``
    and ``char_end``) for CHK-11."""

    text: str
    locators: Sequence[dict] = ()


@dataclass(frozen=True)
class ExtractorSpec:
    """A parser with its version (CDC-5 compares it) and the options it is called with."""

    parse: Callable[..., str | Extracted]
    version: int = 1
    options: dict = field(default_factory=dict)


Extractor = Callable[[bytes], str | Extracted] | ExtractorSpec


def _extract_text(content: bytes) -> str:
    return content.decode("utf-8-sig", errors="replace")


def _extract_html(content: bytes) -> str:
    from .operators.assemble import markdown_of

    return markdown_of(_extract_text(content))


EXTRACTORS: dict[str, Extractor] = {"md": _extract_text, "txt": _extract_text, "html": _extract_html, "htm": _extract_html}


def extract(files: DataFrame, extractors: dict[str, Extractor] | None = None) -> DataFrame:
    """UDF-1: files (file_path, ext, content) to (file_path, file_hash, file_size, text, outcome, error, parser_version, locators), map-only.

    Extractors are looked up by extension in any case; an unknown extension or a failing parser is a row with
    outcome ``error``, never a failed job. A spec adds options and the parser's version; a parser that returns
    ``Extracted`` adds locators, of which ``locator_rows`` makes the map for CHK-11.
    """
    specs = {k.lower(): f if isinstance(f, ExtractorSpec) else ExtractorSpec(f) for k, f in (EXTRACTORS if extractors is None else extractors).items()}
    names = LOCATOR.fieldNames()

    def one(ext: str, content: bytes) -> tuple:
        spec = specs.get(ext.lower())
        if spec is None:
            return None, "error", f"no extractor for .{ext}", None, None
        try:
            got = spec.parse(content, **spec.options)
            got = got if isinstance(got, Extracted) else Extracted(got)
            places = [{"char_start": x["char_start"], "char_end": x["char_end"], "locator": {n: x.get(n) for n in names}} for x in got.locators]
            return got.text, "ok", None, spec.version, places
        except Exception as e:  # noqa: BLE001 - reported as a row
            return None, "error", str(e), spec.version, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [one(x, c) for x, c in zip(batch["ext"], batch["content"])]
            out = pd.DataFrame(done, columns=["text", "outcome", "error", "parser_version", "locators"], index=batch.index).astype({"parser_version": "Int64"})
            yield pd.concat([batch[["file_path", "file_hash", "file_size"]], out], axis=1)

    hashed = files.select("file_path", "ext", "content", F.sha2("content", 256).alias("file_hash"), F.octet_length("content").cast("bigint").alias("file_size"))
    return hashed.mapInPandas(run, f"file_path string, file_hash string, file_size bigint, text string, outcome string, error string, parser_version bigint, locators array<struct<char_start:int,char_end:int,locator:{LOCATOR.simpleString()}>>")


def locator_rows(extracted: DataFrame) -> DataFrame:
    """(file_hash, char_start, char_end, locator) of extracted files, one entry per place; files with the same bytes count once."""
    return extracted.dropDuplicates(["file_hash"]).select("file_hash", F.explode("locators").alias("x")).select("file_hash", "x.*")
