"""A selection of the registered queries against their SQL on the smallest data (all of them: ``python -m checks.compare``)."""

import os

import pytest

from checks import ORACLES, QUERIES
from checks.compare import compare, connect

SF = "/root/testdata/sf0.001"
FAST = [
    "txt1_tokens", "txt12_classify_error", "flt2_in_source", "flt6_size_limit", "asm1_documents", "asm2_table_to_markdown", "chk3_heading_path", "chk5_sections",
    "chk8_pack_sentences", "chk12_chunk_documents", "cdc3_diff_snapshots", "cdc7_apply_changes", "cdc10_error_gate", "str1_debounce", "lex3_bm25", "vec1_vector_topk",
    "ret6_hybrid_search", "ret14_chat_prompt", "gen2_budget_prefix", "gen5_split_slides", "cnv4_question_of", "cnv6_dedupe_names", "cnv7_assemble_stream",
]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) == ""


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_fused_lists_are_searched_once(spark, monkeypatch):
    from checks import retrieval
    from checks.views import Views

    calls = []
    for holder, name in ((retrieval.lexical, "search_topk"), (retrieval.vector, "vector_topk")):
        monkeypatch.setattr(holder, name, lambda *a, _fn=getattr(holder, name), _name=name, **k: calls.append(_name) or _fn(*a, **k))
    assert retrieval.ret3(Views(spark, "/root/testdata/sf0.001")).count() > 0
    assert sorted(calls) == ["search_topk", "vector_topk"]
