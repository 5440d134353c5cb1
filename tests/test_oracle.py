"""Every registered query against its SQL in DuckDB, on whole tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import TABLES, compare
from tinderframe.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"
SLOW: set[str] = set()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(set(queries()) - SLOW))
def test_query(spark, con, name):
    result = compare(spark, con, name, FOLDER)
    assert not result.startswith("FAIL"), result
    assert "TYPES" not in result, result


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["stid", "n", "bias", "mae", "mse"]
    assert df.count() > 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairwise_join(spark, name):
    """No plan compares all rows of one side with all rows of the other."""
    if name in {"gbt_eval", "rf_eval", "lm_eval", "lm_weighted", "grid_search", "grid_best", "null_scoring"}:
        pytest.skip("fits a model before there is a plan")
    plan = queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
