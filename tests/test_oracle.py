"""Every registered query against its SQL in DuckDB; queries without SQL must give rows of a stable schema."""

import pytest
from oracle_check import compare, duck

from weftline.registry import all_queries

QUERIES = all_queries()
# Empty at the smallest scale by nature of the data.
MAY_BE_EMPTY = {"clear_store", "embedded_topk", "fuzzy_match", "fuzzy_match_all", "hybrid_search"}


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    result = compare(spark, con, sf, QUERIES[name])
    if result["ok"] is None:
        assert result["rows"] > 0 or name in MAY_BE_EMPTY
    elif result["why"] == "EMPTY":
        assert name in MAY_BE_EMPTY
    else:
        assert result["ok"], result["why"]


def test_a_wrong_constant_is_noticed(spark, sf, con):
    from dataclasses import replace

    q = QUERIES["log_level_filter"]
    assert compare(spark, con, sf, replace(q, sql=q.sql.replace(">= 2", ">= 3")))["ok"] is False


def test_names_carry_survey_ids():
    assert all(q.ops for q in QUERIES.values())
