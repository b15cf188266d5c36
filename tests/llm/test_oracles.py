"""Queries with SQL, on the smallest tables."""

import pytest

from tideloom.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, same_rows, name):
    same_rows(QUERIES[name](spark, sf_dir), SQL[name])


def test_line_dedup_is_native(spark, sf_dir):
    plan = QUERIES["op1_line_dedup"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
