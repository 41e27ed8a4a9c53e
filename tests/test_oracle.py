"""Every query that has SQL gives the same rows as DuckDB."""

import pytest
from compare import connect, differences

from __spark_entry__ import entry, oracle_sql, queries
from pairwright.plans.catalog import QUERIES
from pairwright.plans.oracle import ORACLE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, ORACLE[name]) == []


def test_sql_belongs_to_queries():
    assert set(ORACLE) <= set(QUERIES)
    assert set(oracle_sql()) <= set(queries())


def test_only_learning_queries_lack_sql():
    assert set(QUERIES) - set(ORACLE) == {"stack_oof", "tune_stacker", "feature_importance"}


def test_entry_has_a_row_per_model(spark):
    assert {r["model"] for r in entry(spark).collect()} == {"m1", "m2", "m3"}
