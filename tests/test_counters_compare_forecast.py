"""Counter rates, Welch comparison and linear forecast on hand-made series."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.operators.compare import compare_models, model_stats
from vigil.operators.counters import with_rates
from vigil.operators.forecast import forecast, risk_from_hours
from conftest import fact_rows, ts

AS_OF = "2024-01-31 00:00:00"


def test_counter_rate_edge_cases(spark):
    vals = [10, 10, 16, None, 22, 4, 7]   # first, equal, rise, NULL, rise over NULL, reset, rise
    rows = [{"time": ts(f"2024-01-30 00:00:{i * 5:02d}"), "seq": i, "model_name": "m", "model_type": "llm",
             "request_success_total": v, "prompt_tokens_total": None if v is None else v * 10,
             "generation_tokens_total": 0} for i, v in enumerate(vals)]
    got = with_rates(fact_rows(spark, rows)).orderBy("seq").collect()
    assert [r.throughput_rps for r in got] == [None, 0.0, 6 / 15, None, 6 / 15, None, 3 / 15]
    assert got[2].avg_prompt_tokens == 10.0 and got[1].avg_prompt_tokens is None


def test_counter_rate_across_day_chunks(spark):
    rows = [{"time": ts("2024-01-29 23:59:50"), "seq": 1, "model_name": "m", "request_success_total": 5},
            {"time": ts("2024-01-30 00:00:05"), "seq": 2, "model_name": "m", "request_success_total": 35}]
    got = with_rates(fact_rows(spark, rows)).orderBy("seq").collect()
    assert got[1].throughput_rps == 2.0


def _cmp_frame(spark, a, b):
    rows = [{"time": ts("2024-01-30 12:00:00"), "seq": i, "model_name": "a", "latency_p95_ms": float(v)}
            for i, v in enumerate(a)]
    rows += [{"time": ts("2024-01-30 12:00:00"), "seq": 1000 + i, "model_name": "b", "latency_p95_ms": float(v)}
             for i, v in enumerate(b)]
    rows.append({"time": ts("2024-01-30 12:00:00"), "seq": 5000, "model_name": "c", "latency_p95_ms": float("inf")})
    return fact_rows(spark, rows, extra_cols=["throughput_rps"])


def test_welch_against_numpy(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(100, 10, 40).round(1), rng.normal(95, 20, 25).round(1)
    df = _cmp_frame(spark, a, b)
    pairs = spark.createDataFrame([("a", "b"), ("c", "b")], "model_a string, model_b string")
    res = {r.model_a: r for r in compare_models(df, pairs, AS_OF).collect()}
    va, vb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
    t = (a.mean() - b.mean()) / np.sqrt(va + vb)
    assert res["a"].t_statistic == pytest.approx(round(t, 6), abs=2e-6)
    dfree = (va + vb) ** 2 / (va ** 2 / (len(a) - 1) + vb ** 2 / (len(b) - 1))
    # two-sided p by numerical integration of the t density
    xs = np.linspace(abs(t), 60, 400001)
    from math import gamma, pi, sqrt
    dens = gamma((dfree + 1) / 2) / (sqrt(dfree * pi) * gamma(dfree / 2)) * (1 + xs ** 2 / dfree) ** (-(dfree + 1) / 2)
    p = 2 * np.trapezoid(dens, xs)
    assert res["a"].p_value == pytest.approx(p, abs=1e-5)
    # model c has only a non-finite value -> no statistics, "Insufficient"
    assert res["c"].n_a == 0 and res["c"].t_statistic is None and res["c"].statistically_significant is False


def test_percentiles_numpy(spark):
    a = np.arange(1.0, 102.0)
    st = {r.model_name: r for r in model_stats(_cmp_frame(spark, a, a[:7]), AS_OF).collect()}
    assert (st["a"].p50, st["a"].p95, st["a"].p99) == (51.0, 96.0, 100.0)
    assert st["b"].p95 == pytest.approx(round(float(np.percentile(a[:7], 95)), 4))


def _series(spark, points, metric="requests_waiting"):
    rows = [{"time": ts(t), "seq": i, "model_name": "m", "model_type": "llm", metric: v}
            for i, (t, v) in enumerate(points)]
    return fact_rows(spark, rows, extra_cols=["throughput_rps"])


def test_linear_forecast_single_point_and_gap(spark):
    snap, pts = forecast(_series(spark, [("2024-01-30 22:00:00", 7)]), AS_OF, ["requests_waiting"], 1)
    p = pts.orderBy("step").collect()
    assert [r.yhat for r in p] == [7.0] * 4 and str(p[0].ds) == "2024-01-30 22:15:00"
    pts2 = forecast(_series(spark, [("2024-01-30 20:00:00", 1), ("2024-01-30 20:30:00", 2),
                                    ("2024-01-30 21:00:00", 3)]), AS_OF, ["requests_waiting"], 1)[1]
    p2 = pts2.orderBy("step").collect()
    assert str(p2[0].ds) == "2024-01-30 21:30:00"   # median step 30 min
    assert p2[0].yhat == pytest.approx(4.0) and p2[3].yhat == pytest.approx(7.0)
    std = np.std([1, 2, 3])
    assert p2[0].yhat_upper == pytest.approx(4.0 + 2 * std)


@pytest.mark.parametrize("hours,exp", [(1.0, "critical"), (1.01, "high"), (3.0, "high"), (6.0, "medium"),
                                       (6.01, "low"), (None, "low"), (-2.0, "critical")])
def test_risk_bands(spark, hours, exp):
    v = F.lit(hours).cast("double")
    assert spark.range(1).select(risk_from_hours(v).alias("r")).collect()[0].r == exp


def test_saturation_by_upper_band(spark):
    # rising KV usage reaches 90 within the horizon only through the upper band
    pts = [(f"2024-01-30 {h:02d}:{m:02d}:00", 80 + 0.1 * ((h - 12) * 4 + m // 15) + (1.0 if (m // 15) % 2 else -1.0))
           for h in range(12, 24) for m in (0, 15, 30, 45)]
    snap, p = forecast(_series(spark, pts, "kv_cache_usage_pct"), AS_OF, ["kv_cache_usage_pct"], 6)
    r = snap.collect()[0]
    assert r.cold_start_mode is True and r.n_training_points == len(pts)
    first = p.where(F.col("yhat_upper") >= 90.0).orderBy("step").first()
    assert first is not None and r.saturation_time == first.ds
    assert p.where(F.col("yhat") >= 90.0).count() == 0
    assert r.saturation_risk == "medium"
