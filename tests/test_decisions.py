"""Hand-computed boundary cases for health status, rules, confidence and alerts."""
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.operators.alerts import alert_feed, external_alerts, score_severity
from vigil.operators.health import health_status
from vigil.operators.rules import diagnose

HEALTH_CASES = [
    # score, kv, queue, free, temp, drift -> status
    (None, None, None, None, None, None, "healthy"),
    (-0.15, None, None, None, None, None, "degraded"),      # strict < for critical
    (-0.1501, None, None, None, None, None, "critical"),
    (-0.05, None, None, None, None, None, "healthy"),
    (-0.0501, None, None, None, None, None, "degraded"),
    (None, 90.0, None, None, None, None, "critical"),       # >= for KV
    (None, 75.0, None, None, None, None, "degraded"),
    (None, 74.99, None, None, None, None, "healthy"),
    (None, None, 20.0, None, None, None, "critical"),
    (None, None, 5.0, None, None, None, "degraded"),
    (None, None, None, 2047.9, None, None, "critical"),
    (None, None, None, 2048.0, None, None, "degraded"),
    (None, None, None, 4096.0, None, None, "healthy"),
    (None, None, None, None, 87.0, None, "critical"),
    (None, None, None, None, 80.0, None, "degraded"),
    (None, None, None, None, None, "high", "critical"),
    (None, None, None, None, None, "medium", "degraded"),
    (None, None, None, None, None, "low", "healthy"),
]


def test_health_status(spark):
    schema = "score double, kv double, q double, free double, temp double, drift string, exp string"
    df = spark.createDataFrame(HEALTH_CASES, schema)
    out = df.select("exp", health_status(F.col("score"), F.col("kv"), F.col("q"), F.col("free"),
                                         F.col("temp"), F.col("drift")).alias("got")).collect()
    assert [r.got for r in out] == [r.exp for r in out]


RULE_SCHEMA = T.StructType([T.StructField(c, T.DoubleType()) for c in [
    "kv_cache_usage_pct", "requests_waiting", "latency_p95_ms", "gpu_util_pct", "gpu_temp_celsius",
    "gpu_mem_free_mb", "ttft_p95_ms", "tpot_mean_ms", "rtf", "anomaly_score",
    "baseline_latency_p95_ms", "baseline_ttft_p95_ms", "baseline_tpot_mean_ms", "total_deviation"]]
    + [T.StructField("model_type", T.StringType()), T.StructField("top_dims", T.StringType()),
       T.StructField("exp", T.StringType())])

BASE = dict(kv_cache_usage_pct=50.0, requests_waiting=1.0, latency_p95_ms=100.0, gpu_util_pct=50.0,
            gpu_temp_celsius=60.0, gpu_mem_free_mb=10000.0, ttft_p95_ms=50.0, tpot_mean_ms=20.0, rtf=0.5,
            anomaly_score=0.0, baseline_latency_p95_ms=100.0, baseline_ttft_p95_ms=50.0,
            baseline_tpot_mean_ms=20.0, total_deviation=0.0, model_type="llm", top_dims="")


def _case(exp, **kw):
    d = dict(BASE, **kw)
    return tuple(d.get(f.name) for f in RULE_SCHEMA.fields[:-1]) + (exp,)


RULE_CASES = [
    _case("R0"),
    _case("R1", kv_cache_usage_pct=90.1, requests_waiting=6.0),
    _case("R0", kv_cache_usage_pct=90.0, requests_waiting=6.0),
    _case("R2", latency_p95_ms=201.0, gpu_util_pct=29.9),
    _case("R3", requests_waiting=21.0, gpu_util_pct=90.1),
    _case("R1", requests_waiting=21.0, gpu_util_pct=90.1, kv_cache_usage_pct=95.0),  # R1 beats R3
    _case("R4", ttft_p95_ms=101.0, tpot_mean_ms=21.0),
    _case("R0", ttft_p95_ms=101.0, tpot_mean_ms=24.0),
    _case("R5", gpu_temp_celsius=85.1),
    _case("R6", gpu_mem_free_mb=2047.0),
    _case("R0", gpu_mem_free_mb=None),        # missing free VRAM defaults to 99999
    _case("R7", model_type="tts", rtf=1.01),
    _case("R0", model_type="llm", rtf=1.01),
    _case("R8", anomaly_score=-0.16, top_dims="gpu_util_pct, rtf"),
    _case("R0", anomaly_score=-0.15),
]


def test_rules_first_match(spark):
    df = spark.createDataFrame(RULE_CASES, RULE_SCHEMA)
    out = diagnose(df).select("exp", "rule_id", "anomaly_detected", "confidence", "evidence").collect()
    for r in out:
        assert r.rule_id == r.exp
        assert r.anomaly_detected == (r.exp != "R0")
    by = {r.exp: r for r in out}
    assert by["R8"].confidence == 0.3 and by["R5"].confidence == 0.6 and by["R0"].confidence == 0.0
    assert any(r.evidence == "cache fill 90.1%, limit 90% | queue length 6, limit 5"
               for r in out)
    assert "furthest off: gpu_util_pct, rtf" in by["R8"].evidence


@pytest.mark.parametrize("dev,matched,mx,exp", [(0, 1, 2, 0.3), (50, 2, 2, 0.8), (100, 1, 1, 1.0),
                                               (1000, 1, 2, 0.7)])
def test_confidence(spark, dev, matched, mx, exp):
    from vigil.operators.rules import confidence
    r = spark.range(1).select(confidence(matched, mx, F.lit(float(dev))).alias("c")).collect()[0]
    assert r.c == pytest.approx(exp)


@pytest.mark.parametrize("score,exp", [(-0.1501, "critical"), (-0.15, "critical"), (-0.1499, "warning"),
                                       (-0.0501, "warning"), (-0.05, "warning"), (-0.0499, "info")])
def test_alert_bands(spark, score, exp):
    assert spark.range(1).select(score_severity(F.lit(score)).alias("s")).collect()[0].s == exp


def _ext(spark):
    schema = ("labels map<string,string>, annotations map<string,string>, status struct<state:string>, "
              "startsAt string, endsAt string")
    rows = [
        ({"alertname": "A", "model_name": "m1", "severity": "critical"}, {"summary": "s1"}, ("active",),
         "2024-01-30T10:00:00", ""),
        ({"alertname": "B", "job": "jobx"}, {}, ("resolved",), "2024-01-30T09:00:00", "2024-01-30T09:30:00"),
        ({"alertname": "C"}, {"description": "d"}, None, "2024-01-30T08:00:00", ""),
        ({"alertname": "A", "model_name": "m1", "severity": "critical"}, {"summary": "s1"}, ("active",),
         "2024-01-30T10:00:00", ""),
    ]
    return spark.createDataFrame(rows, schema)


def test_external_alert_fallbacks(spark):
    u = external_alerts(_ext(spark)).orderBy("fired_at").collect()
    assert [(r.model_name, r.title, r.severity, r.resolved) for r in u[:3]] == [
        ("unknown", "C", "warning", False), ("jobx", "B", "warning", True), ("m1", "s1", "critical", False)]


def test_alert_feed_dedupe_limit_and_order(spark):
    ext = external_alerts(_ext(spark))
    stored = spark.createDataFrame([
        ("anomaly_detector", "anomaly", "m1", "s1", "x", "warning", "2024-01-30 10:00:00", False, -0.1),
        ("anomaly_detector", "anomaly", "m2", "t", "x", "critical", "2024-01-30 11:00:00", False, -0.2),
    ], "source string, alert_type string, model_name string, title string, description string, "
       "severity string, fired_at string, resolved boolean, anomaly_score double"
    ).withColumn("fired_at", F.to_timestamp_ntz("fired_at"))
    feed = alert_feed(stored, ext, limit=3).collect()
    # stored first (newest first); the duplicate external (m1, s1, 10:00) is dropped; resolved excluded
    assert [(r.source, r.model_name) for r in feed] == [
        ("anomaly_detector", "m2"), ("anomaly_detector", "m1"), ("alertmanager", "unknown")]


def test_feed_keeps_distinct_alerts_behind_repeats(spark):
    import datetime as dt
    from vigil.operators.alerts import ALERT_COLUMNS, alert_feed
    t = dt.datetime(2024, 1, 30)
    cols = "model_name string, title string, fired_at timestamp, alert_type string, source string, description string, severity string, resolved boolean, anomaly_score double"
    rows = [("m", "same", t, "external", f"inst{i}", "", "warning", False, None) for i in range(60)]
    rows += [("m", f"t{i:02d}", t - dt.timedelta(minutes=i + 1), "external", "x", "", "warning", False, None) for i in range(30)]
    ext = spark.createDataFrame(rows, cols)
    out = alert_feed(ext.where("false"), ext, limit=20)
    assert set(ALERT_COLUMNS) <= set(out.columns)
    assert [r["title"] for r in out.orderBy("fired_at", ascending=False).collect()] == ["same"] + [f"t{i:02d}" for i in range(19)]


def test_upsert_rerun_wins_ties(spark):
    import datetime as dt
    from vigil.operators.maintenance import upsert_latest
    t = dt.datetime(2024, 1, 30)
    cols = "k string, computed_at timestamp, severity string, psi double"
    old = spark.createDataFrame([("a", t, "none", 0.01), ("b", t, "low", 1.0)], cols)
    new = spark.createDataFrame([("a", t, "high", 0.4), ("b", t, "high", 9.0)], cols)
    got = {r["k"]: (r["severity"], r["psi"]) for r in upsert_latest(old, new, ["k"]).collect()}
    assert got == {"a": ("high", 0.4), "b": ("high", 9.0)}


def test_tree_streams_differ_for_names_with_a_common_prefix():
    import numpy as np
    from vigil.operators.anomaly import _grow
    z = np.random.default_rng(0).standard_normal((64, 4))
    assert _grow("gpt-prod-eu", 0, z, 1) != _grow("gpt-prod-us", 0, z, 1)
