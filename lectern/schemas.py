"""Declared schemas of every table the engine reads or writes (nothing is inferred)."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

TEXT, INT, LONG, DOUBLE, FLAG, TIME = StringType(), IntegerType(), LongType(), DoubleType(), BooleanType(), TimestampType()


def table(**columns: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


LOCATOR = table(
    kind=TEXT, index=INT, title=TEXT, is_note=FLAG, name=TEXT, row_from=INT, row_to=INT, page_from=INT, page_to=INT
)
CITATION = table(index=INT, chunk_id=TEXT, file_path=TEXT, heading_text=TEXT, char_start=INT, char_end=INT, preview=TEXT)

FILES = table(file_path=TEXT, file_hash=TEXT, source_mtime=LONG, file_size=LONG, text=TEXT)
PATHS = table(file_path=TEXT, file_hash=TEXT, source_mtime=LONG, observed_at=LONG, seq=LONG, tombstone=FLAG)
REFS = table(file_hash=TEXT, file_path=TEXT, seq=LONG, tombstone=FLAG)
CONTENT = table(
    file_hash=TEXT, file_size=LONG, chunking_version=LONG, parser_version=LONG, indexed_at=LONG, status=TEXT,
    error_message=TEXT, summary=TEXT, summary_model_id=TEXT, embedding_model_id=TEXT, embedding_error=TEXT,
    seq=LONG, tombstone=FLAG,
)
CHUNKS = table(
    chunk_id=TEXT, chunk_index=INT, file_hash=TEXT, file_path=TEXT, source_id=TEXT, heading_path=ArrayType(TEXT),
    heading_text=TEXT, content=TEXT, content_hash=TEXT, token_count=INT, char_start=INT, char_end=INT, kind=TEXT,
    locator=LOCATOR,
)
POSTINGS = table(field=TEXT, term=TEXT, chunk_id=TEXT, tf=INT, len=INT)
DOC_STATS = table(field=TEXT, chunk_id=TEXT, len=INT)
VECTORS = table(chunk_id=TEXT, model_id=TEXT, vec=ArrayType(FloatType()))
KEPT_VECTORS = table(file_hash=TEXT, chunk_id=TEXT, text_hash=TEXT, vec=ArrayType(FloatType()), error=TEXT, model_id=TEXT, batch=LONG)
HITS = table(
    query_id=LONG, chunk_id=TEXT, bm25_score=DOUBLE, vector_score=DOUBLE, rrf_score=DOUBLE, rerank_score=DOUBLE, final_rank=INT
)
TURNS = table(
    session_id=TEXT, pos=LONG, role=TEXT, content=TEXT, created_at=LONG, error=TEXT, cancelled=FLAG, citations=ArrayType(CITATION)
)
ARTIFACTS = table(
    artifact_id=TEXT, notebook_id=TEXT, kind=TEXT, title=TEXT, content=TEXT, citations=ArrayType(CITATION), model_used=TEXT,
    generated_at=LONG, truncated=FLAG,
)
CHANGES = table(path=TEXT, old_path=TEXT, kind=TEXT, ts=TIME)
