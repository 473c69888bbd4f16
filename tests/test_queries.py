"""Every registered query against its SQL on the given tables, and the shape of its plan."""

import pytest

import __spark_entry__ as entry
from opsframe.plans import catalogue
from tests.compare import connect, differences

QUERIES = catalogue.QUERIES
CHECKS = catalogue.ORACLES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)
    assert len(QUERIES) >= 114
    assert set(QUERIES) <= set(entry.queries()) and set(CHECKS) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows_and_plan(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    found = differences(df, con, CHECKS[name])
    assert found is None, found
    plan = df._jdf.queryExecution().executedPlan().toString()
    for slow in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert slow not in plan
    # Only the check of a job's output comes down to one row in one task.
    assert "SinglePartition" not in plan or name == "output_check"
    spark.catalog.clearCache()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["word", "count"]
    assert df.count() == 20
