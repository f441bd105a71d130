"""Postings kept by chunk, searches with more expansions than may be broadcast, and an index of many small buckets."""

from __future__ import annotations

import glob

from pyspark.sql import functions as F

from lectern.operators import lexical, term_index
from lectern.plans import index


def chunks_of(spark):
    rows = [(f"c{i}", f"head{i % 3}", " ".join(f"w{j}" for j in range(i % 7, 40, i % 5 + 1)) + f" only{i}", f"p/{i}.md") for i in range(60)]
    return spark.createDataFrame(rows, "chunk_id string, heading_text string, content string, file_path string")


def test_kept_postings_are_grouped_by_chunk_without_an_exchange(spark):
    chunks = chunks_of(spark)
    kept = lexical.postings_table(chunks)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, lexical.build_postings(chunks).collect()))
    counted = kept.groupBy("chunk_id").agg(F.sum("tf").alias("n"))
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()


def test_shares_are_the_same_when_only_frequent_terms_are_broadcast(spark):
    chunks = chunks_of(spark)
    postings, corpus = lexical.postings_table(chunks), lexical.corpus_stats(lexical.doc_stats(chunks))
    terms = spark.createDataFrame([("w", 0), ("only", 1), ("head1", 2), ("w3", 3)], "term string, no int")
    gains = lexical.term_gains(terms, postings, corpus, lexical.Bm25()).join(terms.withColumnRenamed("term", "query_term"), "query_term").drop("query_term")

    def shares(**limits):
        out = {}
        for row in lexical.shares_of(postings, gains, lexical.Bm25(), **limits).collect():
            held = out.setdefault(row["chunk_id"], {})
            for no, share in zip(row["terms"], row["shares"]):
                held[no] = held.get(no, 0) + share
        return {c: {no: round(s, 9) for no, s in held.items()} for c, held in out.items()}

    least = lexical.least_hot(gains, 40)
    assert 0 < gains.where(F.col("df") >= least).count() <= 40 < gains.count()
    whole = shares()
    assert len(whole) == 60 and whole == shares(max_rows=1, max_hot=40) == shares(max_rows=1, max_hot=0)


def test_shares_of_frequent_terms_stay_in_their_buckets(spark, monkeypatch):
    monkeypatch.setattr(lexical, "tasks_for", lambda *_: 3)  # fewer buckets than the session's shuffle partitions
    chunks = chunks_of(spark)
    postings, corpus = lexical.postings_table(chunks), lexical.corpus_stats(lexical.doc_stats(chunks))
    terms = spark.createDataFrame([("w", 0), ("only", 1)], "term string, no int")
    gains = lexical.term_gains(terms, postings, corpus, lexical.Bm25()).join(terms.withColumnRenamed("term", "query_term"), "query_term").drop("query_term")
    shares = lexical.shares_of(postings, gains, lexical.Bm25(), max_rows=1, max_hot=40)
    plan = shares._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(chunk_id") == 1, plan  # of the rare shares
    assert shares.count() == 60


def test_a_small_bucket_is_written_by_one_task(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(term_index, "MAX_BUCKETS", 4)
    postings = lexical.build_postings(chunks_of(spark))
    term_index.write_term_index(postings, str(tmp_path), run_rows=2, min_buckets=2)
    assert term_index.read_postings(spark, str(tmp_path)).count() == postings.count()
    assert len(glob.glob(f"{tmp_path}/postings/bucket=*/*.parquet")) == 4


def test_removed_ids_are_hashed_and_postings_not_sorted(spark):
    postings = lexical.postings_table(chunks_of(spark))
    removed = spark.createDataFrame([(f"c{i}",) for i in range(0, 70, 2)], "chunk_id string")
    want = sorted(tuple(r) for r in postings.collect() if int(r.chunk_id[1:]) % 2)
    columns = postings.columns
    for limit, join in (({}, "BroadcastHashJoin"), ({"max_rows": 3}, "ShuffledHashJoin")):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        try:
            left = lexical.merge(postings, removed, postings.limit(0), **limit).select(columns)
            plan = left._jdf.queryExecution().executedPlan().toString()
            assert sorted(map(tuple, left.collect())) == want
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert join in plan and "SortMergeJoin" not in plan


def test_postings_of_a_run_are_dealt_by_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "TASK_BYTES", 1_000)
    files = spark.createDataFrame([(f"n/{i}.md", f"text {i} " + "word " * 80) for i in range(60)], "file_path string, text string")
    files = files.select("file_path", F.sha2("text", 256).alias("file_hash"), F.lit(1).cast("long").alias("source_mtime"), F.length("text").cast("long").alias("file_size"), "text")
    index.apply_batch(spark, str(tmp_path), files, 0, 0)
    assert len(glob.glob(f"{tmp_path}/postings/batch=0/*.parquet")) >= 16  # the session shuffles into 4
    tokens = spark.read.parquet(f"{tmp_path}/postings").where("field = 'content'").agg(F.sum("tf")).first()[0]
    assert tokens == 60 * 82


def test_scores_of_all_pairs_are_not_grouped(spark):
    """Equal to a sum over the shares, in blocks of queries too; pairs of chunks and queries are rows only once they are scored."""
    chunks = chunks_of(spark)
    postings, corpus = lexical.postings_table(chunks), lexical.corpus_stats(lexical.doc_stats(chunks))
    asked = [(1, "w3 w3 w9"), (2, "only7 head1"), (3, ""), (None, "w3 nothing"), (2**60 + 1, "head0 md")]
    queries = spark.createDataFrame(asked, "query_id bigint, text string")
    hits = queries.select("query_id").crossJoin(chunks.select("chunk_id")).where("query_id is not null")
    for model in (lexical.EXACT, lexical.Bm25()):
        parts = lexical.contributions(queries, postings, corpus, hits, model).groupBy("query_id", "chunk_id").agg(F.sum("part").alias("s"))
        want = {(r.query_id, r.chunk_id, round(r.s, 9)) for r in parts.collect()}
        for block in (1000, 2) if model == lexical.EXACT else (1000,):
            out = lexical.bm25(queries, postings, corpus, model, block=block)
            got = [(r.query_id, r.chunk_id, round(r.score, 9)) for r in out.collect()]
            assert len(got) == len(set(got)) and {g for g in got if g[0] is not None} == want
            assert {g[1] for g in got if g[0] is None} == {r.chunk_id for r in postings.where("term = 'w3'").collect()} or model != lexical.EXACT
    plan = lexical.bm25(queries, postings, corpus)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("MapInArrow")[0]
    assert lexical.bm25(queries.where("query_id = 3"), postings, corpus).count() == 0
