from pyspark.sql import functions as F

from checks.streams import tokens_once
from lectern.functions import text
from lectern.operators.chunking import ChunkerConfig, chunk_documents


def test_repeated_sentences_count_once(spark):
    long = " ".join(f"Word{i} one two three four, five." for i in range(60))
    files = spark.createDataFrame([("a", "a.md", long), ("b", "b.md", "short text.")], "file_hash string, file_path string, text string")
    chunks = chunk_documents(files, ChunkerConfig(50, 10))
    own = {r.file_hash: r.n for r in files.select("file_hash", text.token_count(F.col("text")).alias("n")).collect()}
    held = tokens_once(chunks, files.select("file_hash", F.col("text").alias("_text"))).groupBy("file_hash").agg(F.sum("n").alias("n"), F.sum("token_count").alias("all"))
    rows = {r.file_hash: r for r in held.collect()}
    assert {k: r.n for k, r in rows.items()} == own and rows["a"]["all"] > own["a"]
