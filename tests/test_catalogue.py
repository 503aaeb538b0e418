import pytest

from quillstone.plans import catalogue

from oracle import SF, both


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_statement(spark, name):
    got, want = both(spark, catalogue.QUERIES[name], catalogue.SQL[name])
    assert got == want


@pytest.mark.parametrize("name", ["q_pack_agents", "q_pack_dossier", "q_pack_task", "q_search_stemmed", "q_map_text", "q_verify_prefix", "q_eval_recall"])
def test_other_queries_give_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
