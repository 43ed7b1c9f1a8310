"""Every query with SQL gives the same rows in DuckDB; the contract of the entry module."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry  # noqa: E402
from tidemark.plans.catalogue import ORACLE, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    made = duckdb.connect()
    for t in TABLES:
        made.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return made


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, db, name):
    made, want = QUERIES[name](spark, SF), db.sql(ORACLE[name])
    order = [want.columns.index(c) for c in made.columns]
    assert sorted(map(repr, (tuple(r[k] for k in order) for r in want.fetchall()))) == sorted(map(repr, map(tuple, made.collect())))


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE.keys()))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["method", "n_rows", "n_series"]
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


def test_one_shuffle_serves_the_cascade(spark):
    """Lags, window mean and sigma share one exchange and one sort of each kind of order."""
    plan = QUERIES["hybrid_rows_3tier"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double>" in plan and "IsNotNull(value)" in plan
