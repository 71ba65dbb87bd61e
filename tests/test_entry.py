"""Driver contract and a fast oracle subset on sf0.001."""
import math

import duckdb
import pytest

import __spark_entry__ as E
from vigil.sources.tables import TABLES
from conftest import SF0001

ROWS_ONLY = {"anomaly_train", "anomaly_score", "forecast_seasonal", "stream_scoring", "health_forest", "alert_feed_forest",
             "root_cause_forest"}


def test_contract_keys():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert set(q) - set(o) - set(E.LLM_QUERIES) == ROWS_ONLY


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 25 and {"psi", "ks_statistic", "severity"} <= set(df.columns)


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "to_pydatetime"):
        return v.to_pydatetime()
    if hasattr(v, "item"):
        return v.item()
    return v


@pytest.mark.parametrize("name", ["health_snapshot", "counter_rate", "compare_welch", "root_cause",
                                  "forecast_linear", "alert_feed", "contributing_dims", "gpu_node_match"])
def test_oracle_subset(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    s = E.queries()[name](spark, SF0001).toPandas()
    o = con.execute(E.oracle_sql()[name]).df()
    cols = sorted(s.columns)
    assert cols == sorted(o.columns)
    key = lambda r: repr(r)
    sr = sorted((tuple(_norm(x) for x in r) for r in s[cols].itertuples(index=False)), key=key)
    orr = sorted((tuple(_norm(x) for x in r) for r in o[cols].itertuples(index=False)), key=key)
    assert sr == orr
