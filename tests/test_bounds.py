"""Windows end at as_of, every model is diagnosed, no value falls out of a
slice, and a fresh cache computes nothing."""

import datetime as dt

import pytest

from vigil import windows
from vigil.config import RCA_METRICS
from vigil.operators import drift, maintenance, panels, rules, scan
from vigil.sources.readers import read_external_alerts

AS_OF = "2024-01-31 00:00:00"
BEFORE = dt.datetime(2024, 1, 30, 23, 59)


def test_since_ends_at_as_of(spark):
    rows = [(1, BEFORE), (2, dt.datetime(2024, 1, 31)), (3, dt.datetime(2024, 1, 31, 0, 0, 1)),
            (4, dt.datetime(2024, 1, 29))]
    df = spark.createDataFrame(rows, "id int, time timestamp_ntz")
    assert {r.id for r in windows.since(df, AS_OF, 7200).collect()} == {1, 2}
    assert {r.id for r in windows.since(df, AS_OF, 7200, open_end=True).collect()} == {1, 2, 3}


def test_value_chunks_keep_every_value(spark):
    vals = [float("-inf"), -1.0, 0.0, 1.0, 2.0, float("inf"), float("nan")]
    df = spark.createDataFrame([("m", v) for v in vals], "k string, v double")
    assert scan.value_chunks(df, ["k"], "v", 3).count() == len(vals)


def test_fresh_cache_computes_nothing(spark):
    keys = ["model_name", "metric"]
    req = spark.createDataFrame([("m", "x")], "model_name string, metric string")
    stored = spark.createDataFrame([("m", "x", BEFORE, 1.0)],
                                   "model_name string, metric string, computed_at timestamp_ntz, psi double")

    def compute(stale):
        raise AssertionError("nothing is stale")

    got = maintenance.serve_with_cache(req, stored, compute, keys, AS_OF, 6).collect()
    assert [r.psi for r in got] == [1.0]


def test_root_cause_has_every_model(spark):
    cols = "model_name string, model_type string, time timestamp_ntz, " + ", ".join(f"{c} double" for c in RCA_METRICS)
    vals = [50000.0 if c == "gpu_mem_free_mb" else 1.0 for c in RCA_METRICS]
    tel = spark.createDataFrame([("a", "llm", BEFORE, *vals), ("b", "llm", BEFORE, *vals)], cols)
    ev = spark.createDataFrame([(BEFORE, "a", -0.2, True, False, "gpu_util_pct", 250.0)],
                               "computed_at timestamp_ntz, model_name string, anomaly_score double, is_anomaly boolean, "
                               "cold_start_mode boolean, top_feature string, total_deviation double")
    got = {r.model_name: r for r in rules.root_cause(tel, ev, AS_OF, 60).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"].rule_id == "R8" and got["a"].confidence == 0.7 and "gpu_util_pct" in got["a"].evidence
    assert got["b"].status == "no_anomaly" and not got["b"].anomaly_detected and got["b"].root_cause is None
    assert got["a"].recommendation != got["b"].recommendation


def test_heatmap_has_every_model(spark):
    df = spark.createDataFrame([(BEFORE, "any-name", 2.0), (BEFORE, "any-name", 4.0)],
                               "time timestamp_ntz, model_name string, gpu_util_pct double")
    assert [(r.model_name, r.avg_value) for r in panels.heatmap(df, "gpu_util_pct", 300).collect()] == [("any-name", 3.0)]


def test_large_groups_take_the_series(spark):
    """Beyond 10,000 rows `auto` is the series."""
    n = 10001
    rows = [("m", dt.datetime(2024, 1, 20) + dt.timedelta(seconds=i), float(i % 97)) for i in range(n)]
    rows += [("m", dt.datetime(2024, 1, 30) + dt.timedelta(seconds=i), float(i % 89)) for i in range(50)]
    df = spark.createDataFrame(rows, "model_name string, time timestamp_ntz, latency_p95_ms double")
    p = {m: drift.drift_scan(df, AS_OF, "30d", "2d", ["latency"], m).first().ks_p_value for m in ("auto", "series")}
    assert p["auto"] == p["series"]


def test_alert_feed_missing_or_unreadable(spark, tmp_path):
    assert read_external_alerts(spark, str(tmp_path / "none.json")).count() == 0
    with pytest.raises(Exception):
        read_external_alerts(spark, "nosuchscheme://feed.json").count()
