"""Every registered query against its DuckDB oracle at sf0.01 (the round's correctness gate)."""

import pytest

import __spark_entry__ as entry
from tests.oracle_compare import compare, duck

from tests.conftest import SF01

# The optional training-data queries have their own tests.
NAMES = sorted(set(entry.queries()) - set(entry.LLM_QUERIES))


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


def test_every_query_has_an_oracle():
    assert set(entry.oracle_sql()) - set(entry.LLM_SQL) == set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, SF01, con)
    assert r["cols_match"], r
    assert r["spark_rows"] == r["duck_rows"], r
    assert r["values_match"], r


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["o_orderkey", "change_type"]
    assert df.count() > 0


FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas")


def test_no_cross_joins_or_python_in_any_plan(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        bad = {}
        for name, fn in sorted((n, entry.queries()[n]) for n in NAMES):
            plan = fn(spark, SF01)._jdf.queryExecution().executedPlan().toString()
            hits = [f for f in FORBIDDEN if f in plan]
            if hits:
                bad[name] = hits
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert bad == {}
