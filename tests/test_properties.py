"""Properties from the test strategy: D in [0, 1]; PSI >= 0 when every
comparison value lies inside the reference range; identical samples give
D = 0 and PSI = 0; swapping the compared models flips t."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.operators.compare import compare_models
from vigil.operators.drift import drift_scan
from conftest import fact_rows, ts

AS_OF = "2024-01-31 00:00:00"


def _two_windows(spark, groups):
    rows, seq = [], 0
    for model, (ref, cmp) in groups.items():
        for v in ref:
            rows.append({"time": ts("2024-01-15 00:00:00"), "seq": seq, "model_name": model, "latency_p95_ms": float(v)})
            seq += 1
        for v in cmp:
            rows.append({"time": ts("2024-01-30 00:00:00"), "seq": seq, "model_name": model, "latency_p95_ms": float(v)})
            seq += 1
    return fact_rows(spark, rows, extra_cols=["throughput_rps"])


def test_drift_properties(spark):
    rng = np.random.default_rng(11)
    groups = {}
    for i in range(6):
        ref = rng.normal(50, 10, 200).round(1)
        inside = rng.uniform(ref.min(), ref.max(), 80).round(1)
        groups[f"in{i}"] = (ref, inside)
        groups[f"same{i}"] = (ref, ref)
        groups[f"far{i}"] = (ref, rng.normal(80, 5, 60).round(1))
    r = drift_scan(_two_windows(spark, groups), AS_OF, "30d", "10d", ["latency"], "series").collect()
    assert len(r) == 18
    for row in r:
        assert 0.0 <= row.ks_statistic <= 1.0 and 0.0 <= row.ks_p_value <= 1.0
        if row.model_name.startswith("in"):
            assert row.psi >= 0.0
        if row.model_name.startswith("same"):
            assert row.ks_statistic == 0.0 and row.psi == 0.0 and row.severity == "none"
        if row.model_name.startswith("far"):
            assert row.severity == "high" and row.ks_p_value < 1e-6


def test_swapping_models_flips_t(spark):
    rng = np.random.default_rng(5)
    rows = [{"time": ts("2024-01-30 12:00:00"), "seq": i, "model_name": m, "latency_p95_ms": float(v)}
            for i, (m, v) in enumerate([("a", x) for x in rng.normal(10, 2, 30)] + [("b", x) for x in rng.normal(12, 3, 40)])]
    df = fact_rows(spark, rows, extra_cols=["throughput_rps"])
    pairs = spark.createDataFrame([("a", "b"), ("b", "a")], "model_a string, model_b string")
    r = {x.model_a: x for x in compare_models(df, pairs, AS_OF).collect()}
    assert r["a"].t_statistic == pytest.approx(-r["b"].t_statistic)
    assert r["a"].p_value == pytest.approx(r["b"].p_value)
    assert (r["a"].difference_pct < 0) and (r["b"].difference_pct > 0)
