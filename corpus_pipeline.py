"""From raw documents to packed training sequences: five stages, each a registered operator at work.

toxicity    documents that the classifier rejects go
exact       of equal texts the smallest id stays
near        of each near-duplicate class the smallest id stays
mixing      sources are mixed to their target weights: documents go, stay or are repeated; per source one is cut to its first words
packing     the mix as token sequences, one row per piece

Every stage reads all rows and whole texts of what the one before kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import dedup, mixing, near, packing, toxicity
from lectern.llm.base import held_out, table
from lectern.session import cut_lineage

REMEMBERED_BYTES = 64 << 20  # of words in a worker that packs: its executor still holds what earlier stages took
ORACLE_SQL = None  # learned scores, hashes and token ids: tests compare with brute force


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    return toxicity.accepted(docs, toxicity.learn(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup.unique_rows(docs, dedup.older_half(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.Mix(docs).mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, cached_bytes=REMEMBERED_BYTES, keeps=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_duplicates", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
