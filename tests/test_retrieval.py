import random

from pyspark.sql import functions as F

from lectern import udfs
from lectern.operators import context, fusion, generation, lexical, vector


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_expansions_equal_brute_force(spark):
    rng = random.Random(11)
    vocab = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(1, 19))) for _ in range(400)})
    asked = sorted(set(rng.sample(vocab, 60)) | {v[:-1] + "z" for v in rng.sample(vocab, 60)})
    terms, words = (spark.createDataFrame([(t,) for t in x], "term string") for x in (asked, vocab))
    prefix = {(r.term, r.index_term) for r in lexical.expand_prefix(terms, words).collect()}
    assert prefix == {(q, v) for q in asked for v in vocab if v.startswith(q) and v != q}
    fuzzy = {(r.term, r.index_term, r.distance) for r in lexical.expand_fuzzy(terms, words).collect()}
    want = {(q, v, levenshtein(q, v)) for q in asked for v in vocab if q != v and abs(len(q) - len(v)) <= 6}
    assert fuzzy == {(q, v, d) for q, v, d in want if d <= min((len(q) + 5) // 10, 6)}


def corpus(spark, n=120):
    rng = random.Random(2)
    words = ["alpha", "alphabet", "beta", "betas", "gamma", "delta", "the", "of", "retrieval", "retrievals"]
    rows = [(f"c{i:03}", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12))), rng.choice(["alpha", "", "note"]), f"n/{i}.md") for i in range(n)]
    return spark.createDataFrame(rows, "chunk_id string, content string, heading_text string, file_path string")


def test_topk_equals_the_best_of_all_pairs(spark):
    chunks = corpus(spark)
    postings, stats = lexical.build_postings(chunks), lexical.corpus_stats(lexical.doc_stats(chunks))
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(["alpha the the", "retrieval of gamma", "betas", "nothing here", ""])], "query_id int, text string")
    model = lexical.Bm25(digits=6)
    pairs = lexical.bm25(queries, postings, stats, model).collect()
    want = set()
    for q in range(5):
        best = sorted((r for r in pairs if r.query_id == q), key=lambda r: (-r.score, r.chunk_id))[:7]
        want |= {(q, r.chunk_id, r.score, n) for n, r in enumerate(best, 1)}
    for block in (1000, 2):
        got = lexical.search_topk(queries, postings, stats, 7, model, block=block).collect()
        assert {(r.query_id, r.chunk_id, r.score, r["rank"]) for r in got} == want


def test_heading_match_ranks_first(spark):
    rows = [("a", "unrelated words here", "retrieval", "x.md"), ("b", "retrieval words here", "other", "y.md")]
    chunks = spark.createDataFrame(rows, "chunk_id string, content string, heading_text string, file_path string")
    q = spark.createDataFrame([(1, "retrieval")], "query_id int, text string")
    hits = lexical.search_topk(q, lexical.build_postings(chunks), lexical.corpus_stats(lexical.doc_stats(chunks))).collect()
    assert [h.chunk_id for h in sorted(hits, key=lambda h: h["rank"])] == ["a", "b"]


def test_vector_blocks_agree(spark):
    rng = random.Random(4)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(8)]
    vectors = spark.createDataFrame([(f"c{i}", vec()) for i in range(300)], "chunk_id string, vec array<float>").repartition(8)
    queries = spark.createDataFrame([(i, vec()) for i in range(20)], "query_id long, qvec array<float>")
    one = {tuple(r) for r in vector.vector_topk(vectors, queries, 5, digits=6).collect()}
    many = {tuple(r) for r in vector.vector_topk(vectors, queries, 5, digits=6, block=4).collect()}
    assert one == many and len(one) == 100


HIT = "query_id int, chunk_id string, score double, rank int"


def test_rrf_and_bm25_fallback(spark):
    lex = spark.createDataFrame([(1, "a", 9.0, 1), (1, "b", 8.0, 2), (2, "z", 1.0, 1), (2, "y", 0.5, 2)], HIT)
    vec = spark.createDataFrame([(1, "b", 0.9, 1), (1, "c", 0.8, 2)], HIT)
    rows = {(r.query_id, r.chunk_id): r for r in fusion.rrf(lex, vec).collect()}
    assert [k[1] for k in sorted((k for k in rows if k[0] == 1), key=lambda k: rows[k].position)] == ["b", "a", "c"]
    assert abs(rows[1, "b"].rrf_score - (1 / 62 + 1 / 61)) < 1e-12
    assert rows[2, "z"].rrf_score is None and (rows[2, "z"].position, rows[2, "y"].position) == (1, 2)


def test_rankings(spark):
    pool = spark.createDataFrame([(q, p, f"c{p}") for q in (1, 2, 3) for p in (1, 2, 3)], "query_id int, position int, chunk_id string")
    answers = [(1, '{"rankings":[{"index":2,"score":9},{"index":99,"score":1},{"index":2,"score":3},{"index":1.5}]}'), (2, "no json"), (3, 'Sure {"rankings":[{"index":3,"score":"x"}]} ok')]
    rows = fusion.apply_rankings(pool, spark.createDataFrame(answers, "query_id int, raw string")).collect()
    order = {q: [r.chunk_id for r in sorted(rows, key=lambda r: r.final_rank) if r.query_id == q] for q in (1, 2, 3)}
    assert order == {1: ["c2", "c1", "c3"], 2: ["c1", "c2", "c3"], 3: ["c3", "c1", "c2"]}
    assert {r.rerank_score for r in rows if r.query_id == 1 and r.chunk_id == "c2"} == {9.0}


def test_rewrites(spark):
    raws = ['x ["a", " b ", "q", "", 5, null, "c", "d"] y', "none", "[broken", '["q"]']
    got = spark.createDataFrame([(r,) for r in raws], "raw string").select(fusion.parse_rewrites(F.col("raw"), F.lit("q")).alias("k")).collect()
    assert [r.k for r in got] == [["a", "b", "c"], [], [], []]


def test_budget_keeps_the_first_and_stops_at_the_first_that_does_not_fit(spark):
    rows = [(1, 1, 500), (1, 2, 5), (2, 1, 10), (2, 2, 10), (2, 3, 400), (2, 4, 1)]
    hits = spark.createDataFrame(rows, "query_id int, position int, token_count int")
    out = {(r.query_id, r.position): (r.in_prompt, r.truncated) for r in context.fit_budget(hits, 100).collect()}
    assert out == {(1, 1): (True, True), (1, 2): (False, True), (2, 1): (True, True), (2, 2): (True, True), (2, 3): (False, True), (2, 4): (False, True)}


def test_budget_prefix_of_a_whole_notebook(spark):
    rows = [("n", f"p{i:04}", 0, f"c{i}", 1 + i % 5) for i in range(500)] + [("m", "p", 0, "x", 9999)]
    df = spark.createDataFrame(rows, "notebook_id string, file_path string, chunk_index int, chunk_id string, token_count int").repartition(8)
    out = generation.budget_prefix(df, 1000).collect()
    want, spent = [], 0
    for r in rows[:500]:
        spent += r[4] + 30
        if spent > 1000:
            break
        want.append(r[3])
    assert [r.chunk_id for r in sorted(out, key=lambda r: r["index"]) if r.notebook_id == "n"] == want
    assert {(r.notebook_id, r.truncated) for r in out} == {("n", True), ("m", False)}


def test_outlines(spark):
    outline = "- Root [1]\n  - A [3][7]\n      - jump\n   - odd\n  - B [5] mid\n    - C\n\ntext\r\n- Second\n  - D"
    rows = generation.parse_outlines(spark.createDataFrame([("x", outline), ("empty", None)], "doc string, outline string")).orderBy("line_no").collect()
    nodes = [(r.node_id, r.parent_id, r.depth, r.text, r.citations) for r in rows if r.node_id is not None]
    assert nodes == [(0, None, 0, "Root", [1]), (1, 0, 1, "A", [3, 7]), (2, 0, 1, "B [5] mid", []), (3, 2, 2, "C", []), (4, 0, 1, "Second", []), (5, 0, 1, "D", [])]
    assert [(r.line_no, r.error.split()[0]) for r in rows if r.error] == [(3, "no"), (4, "uneven"), (8, "no"), (9, "second")]


def test_slides(spark):
    decks = {"plain": "a\n---\nb --- c\n---  \n\n---\n", "front": "\n---\nmarp: true\n---\n# one\r\n---\r\ntwo", "open": "---\nnever closed"}
    df = spark.createDataFrame(list(decks.items()), "doc string, deck string")
    out = {}
    for r in generation.split_slides(df).orderBy("slide_no").collect():
        out.setdefault(r.doc, []).append(r.slide)
    assert out == {"plain": ["a", "b --- c"], "front": ["# one", "two"], "open": ["never closed"]}


def test_retries_only_what_can_pass():
    calls, waits = [], []

    def busy(_):
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("HTTP 429: slow down")
        return " ok "

    assert udfs.call_with_retry(busy, "p", waits.append) == "ok" and len(waits) == 2 and waits[1] > waits[0]
    for message, times in (("HTTP 400", 1), ("rate limit", 4)):
        seen = []

        def fail(_, message=message, seen=seen):
            seen.append(1)
            raise RuntimeError(message)

        try:
            udfs.call_with_retry(fail, "p", lambda s: None)
        except RuntimeError:
            pass
        assert len(seen) == times


def test_a_model_that_returns_too_few_vectors_costs_its_batch_only(spark):
    from lectern import udfs

    df = spark.createDataFrame([("h", str(i), f"text {i}") for i in range(5)], "file_hash string, chunk_id string, content string")
    out = udfs.embed_documents(df, "m", lambda texts: [[1.0, 0.0]] * min(len(texts), 3)).collect()
    assert all(r.vec == [1.0, 0.0] for r in out)
    assert all("0 vectors for 1 texts" in r.error for r in udfs.embed_documents(df, "m", lambda texts: []).collect())
    assert [len(b) for b in udfs.token_batches(["a " * 5000, "b " * 4000, "c", "d " * 9000, "e"] + ["f"] * 100)] == [1, 2, 1, 96, 5]


def test_extractors_with_version_options_and_locators(spark):
    from lectern import udfs

    def paged(content, sep):
        a, b = content.decode().split(sep)
        return udfs.Extracted(a + b, [{"char_start": 0, "char_end": len(a), "kind": "page", "page_from": 1, "page_to": 1}, {"char_start": len(a), "char_end": len(a + b), "kind": "page", "page_from": 2, "page_to": 2}])

    files = spark.createDataFrame([("a.pp", "pp", b"one|two"), ("b.pp", "pp", b"none"), ("c.txt", "txt", b"plain")], "file_path string, ext string, content binary")
    out = udfs.extract(files, {"pp": udfs.ExtractorSpec(paged, 7, {"sep": "|"}), "txt": lambda b: b.decode()}).cache()
    assert {(r.file_path, r.text, r.outcome, r.parser_version) for r in out.collect()} == {("a.pp", "onetwo", "ok", 7), ("b.pp", None, "error", 7), ("c.txt", "plain", "ok", 1)}
    assert [(r.char_start, r.char_end, r.locator.page_from) for r in udfs.locator_rows(out).orderBy("char_start").collect()] == [(0, 3, 1), (3, 6, 2)]


def test_search_within_notebooks_equals_search_over_their_files(spark):
    from lectern.operators import lexical
    from lectern.plans.search import hybrid_search, scoped_search

    words = ["red", "green", "blue", "stone", "river", "cloud"]
    chunks = spark.createDataFrame(
        [(f"h{i}:0", 0, f"h{i}", f"f{i}.md", "", " ".join(words[j % 6] for j in range(i, i + 3 + i % 4))) for i in range(30)],
        "chunk_id string, chunk_index int, file_hash string, file_path string, heading_text string, content string",
    )
    scope = spark.createDataFrame([(f"n{i % 3}", f"h{i}", f"f{i}.md") for i in range(30)], "notebook_id string, file_hash string, file_path string")
    asked = spark.createDataFrame([(1, "red river", "n0"), (2, "red river", "n1"), (3, "cloud", "n2")], "query_id long, text string, notebook_id string")
    got = scoped_search(asked, chunks, scope, ["n0", "n1", "n2"], pre_filter=F.col("chunk_index") == 0).collect()
    assert got and all(int(r.chunk_id[1:].split(":")[0]) % 3 == int(r.notebook_id[1:]) for r in got)
    own = chunks.where(F.expr("cast(substring(file_hash, 2) as int) % 3 = 1"))
    alone = hybrid_search(asked.where("query_id = 2").drop("notebook_id"), own, lexical.build_postings(own), lexical.corpus_stats(lexical.doc_stats(own))).collect()
    key = lambda r: (r.query_id, r.final_rank, r.chunk_id, round(r.bm25_score, 9))
    assert sorted(map(key, alone)) == sorted(key(r) for r in got if r.query_id == 2)


def test_questions_to_prompts(spark):
    from lectern.operators import lexical
    from lectern.plans.search import answer_questions

    chunks = spark.createDataFrame(
        [(f"h{i}:{j}", j, f"h{i}", f"f{i}.md", f"H{i}", f"{'apple' if i % 2 else 'pear'} number {i} part {j}", 6, 0, 20) for i in range(8) for j in range(3)],
        "chunk_id string, chunk_index int, file_hash string, file_path string, heading_text string, content string, token_count int, char_start int, char_end int",
    )
    questions = spark.createDataFrame([(1, "apple"), (2, "总结 pear")], "query_id long, text string")
    rewrites = spark.createDataFrame([(1, 1, "pear 4"), (1, 99, "ignored")], "query_id long, rewrite_id int, text string")
    summary_hits = spark.createDataFrame([(2, f"h{i}", i + 1) for i in range(6)], "query_id long, file_hash string, rank int")
    out = answer_questions(questions, rewrites, chunks, lexical.build_postings(chunks), lexical.corpus_stats(lexical.doc_stats(chunks)), summary_hits, budget=400)
    assert {(r.query_id, r.route) for r in out["routes"].collect()} == {(1, "chunk"), (2, "summaries")}
    prompts = {r.query_id: r for r in out["prompts"].collect()}
    assert set(prompts) == {1, 2}
    cited = out["citations"].collect()
    assert {r.chunk_id.split(":")[0] for r in cited if r.query_id == 2} <= {f"h{i}" for i in range(6)}
    assert any("apple" in r.content for r in cited if r.query_id == 1)
