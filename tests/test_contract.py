import duckdb
import pytest

import __spark_entry__ as contract
from check_oracle import TABLES, canonical

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["risk_contrast", "state_counts", "ranking_metrics", "influence", "code_summary", "unit_structure", "holdout_assignment", "inner_folds", "bootstrap_means", "secret_scan"]


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() == 3 and "delta" in df.columns


def test_registry_is_consistent():
    queries, sql = contract.queries(), contract.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = contract.queries()[name](spark, FOLDER)
    cursor = db.execute(contract.oracle_sql()[name])
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cursor.fetchall(), [c[0] for c in cursor.description])


def test_filters_and_columns_reach_the_scan(spark):
    plan = contract.queries()["risk_contrast"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "In(l_linenumber, [1,2])" in plan
    assert "l_shipdate" not in plan and "l_partkey" not in plan
    assert plan.count("hashpartitioning(unit_id") == 1  # pairing; unit means reuse its partitioning
