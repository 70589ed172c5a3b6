"""The registry: every query with SQL gives the rows DuckDB gives on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
SAMPLE = ("resample_right", "align_tables", "clean_causal", "rolling_stats", "gas_balance", "regime", "availability", "fc_seasonal", "metrics_gs",
          "column_gate", "hard_winner", "profile", "lag_corr", "setpoints", "plan_audit", "knn_patterns", "router_features")


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    import pandas as pd

    from check import TABLES, canonical

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rows = entry.queries()[name](spark, SF)
    left = pd.DataFrame([tuple(r) for r in rows.collect()], columns=rows.columns, dtype=object)
    cur = con.execute(entry.oracle_sql()[name])
    right = pd.DataFrame(cur.fetchall(), columns=[d[0] for d in cur.description], dtype=object)
    assert sorted(left.columns) == sorted(right.columns)
    assert canonical(left) == canonical(right)


def test_registry_is_whole():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 140


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
