"""Headline timings at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``: one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import QUERIES
from checks.views import Views
from lectern import get_spark
from lectern.operators import lexical, term_index
from lectern.plans.index import build_term_index

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "txt1_tokens", "cdc3_diff_snapshots", "cdc7_apply_changes", "chk4_scan_blocks", "chk12_chunk_documents_split",
    "lex1_postings", "vec1_vector_topk", "ret6_hybrid_search", "sum3_summary_input", "gen2_budget_prefix",
    "agg1_scope_stats", "str1_debounce",
)


def main() -> None:
    spark = get_spark(
        "bench", f"local[{CPUS}]",
        **{"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.time()
        run()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)

    for name in HEADLINE:
        timed(name, lambda: QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save())

    # an index written once, then searched with the whole batch of questions
    views, root = Views(spark, SF_DIR), tempfile.mkdtemp(prefix="lectern-bench-")
    timed("index_build", lambda: build_term_index(views.chunks, root))
    dictionary, postings = term_index.read_dictionary(spark, root), term_index.read_postings(spark, root)
    corpus = lexical.corpus_stats(spark.read.parquet(f"{root}/doc_stats"))

    def search(queries) -> None:
        lexical.search_topk(queries, postings, corpus, 50, dictionary=dictionary).write.format("noop").mode("overwrite").save()

    timed("index_search_batch", lambda: search(views.q))
    one = spark.createDataFrame(views.q.orderBy("query_id").limit(1).toPandas())
    start = time.time()
    search(one)
    single = round(time.time() - start, 3)

    docs, questions = views.table("documents").count(), views.q.count()
    print(json.dumps({
        "metric": "total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR),
        "documents_chunked_per_sec": round(docs / times["chk12_chunk_documents_split"], 1),
        "sec_of_one_question": single,
        "ms_per_query": round(1000 * times["index_search_batch"] / questions, 1),
    }))


if __name__ == "__main__":
    main()
