"""Documented variants behind options (elapsed rates, exact GPU match,
histogram quantiles, training null policy, drift history + latest)."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from vigil.operators import ingest as I
from vigil.operators.counters import with_rates
from vigil.sources import captures as C
from vigil.sources.exposition import parse_samples
from conftest import fact_rows, ts


def test_elapsed_rate(spark):
    rows = [{"time": ts("2024-01-30 00:00:00"), "seq": 1, "model_name": "m", "request_success_total": 10},
            {"time": ts("2024-01-30 00:00:30"), "seq": 2, "model_name": "m", "request_success_total": 40},
            {"time": ts("2024-01-30 00:00:30"), "seq": 3, "model_name": "m", "request_success_total": 40}]
    got = with_rates(fact_rows(spark, rows), rate_basis="elapsed").orderBy("seq").collect()
    assert [r.throughput_rps for r in got] == [None, 1.0, None]     # 30 / 30 s; zero elapsed -> NULL
    got_i = with_rates(fact_rows(spark, rows)).orderBy("seq").collect()
    assert got_i[1].throughput_rps == 2.0                            # 30 / configured 15 s


def test_exact_gpu_match_averages_gpus(spark):
    ev = spark.createDataFrame([(7, "click", 1, "2024-01-01 00:00:00", 1.0, '{"k": 3}')],
                               "event_id long, event_type string, user_id long, ts string, value double, props string")
    ev = C.with_counter_base(ev.withColumn("ts", F.to_timestamp_ntz("ts")))
    g = {r.model_name: r for r in I.gpu_metrics(C.gpu_scrapes(ev), C.registry(spark), match="exact").collect()}
    util0 = float((7 * 37) % 101)
    assert g["click"].gpu_util_pct == pytest.approx(util0 + 1.5)    # node-1's two GPUs (offsets 1, 2)
    assert g["signup"].gpu_util_pct == util0                          # node-10 only


def test_histogram_quantile(spark):
    text = "\n".join(['lat_bucket{le="0.1"} 10', 'lat_bucket{le="0.5"} 60', 'lat_bucket{le="1"} 90',
                      'lat_bucket{le="+Inf"} 100', "lat_sum 40", "lat_count 100"])
    s = parse_samples(spark.createDataFrame([(1, text)], "scrape_id long, text string"))
    r50 = I.histogram_quantile(s, "lat", 0.5).collect()[0]
    assert r50.q50 == pytest.approx(0.1 + 0.4 * (50 - 10) / 50)
    r99 = I.histogram_quantile(s, "lat", 0.99).collect()[0]
    assert r99.q99 == 1.0                                             # falls in +Inf bucket


def test_null_policy_and_drift_history(spark):
    from vigil.operators.anomaly import training_rows
    from vigil.operators.drift import drift_scan
    from vigil.sources.sinks import write_drift_results
    rows = [{"time": ts("2024-01-30 00:00:00"), "seq": i, "model_name": "m", "model_type": "llm",
             "latency_p95_ms": 1.0, "gpu_util_pct": None if i % 2 else 5.0, "kv_cache_usage_pct": 1.0,
             "requests_waiting": 1} for i in range(10)]
    df = fact_rows(spark, rows, extra_cols=["throughput_rps"])
    assert training_rows(df, "2024-01-31 00:00:00").count() == 10
    assert training_rows(df, "2024-01-31 00:00:00", null_policy="skip").count() == 5
    root = tempfile.mkdtemp(prefix="vigil-drift-")
    big = fact_rows(spark, [{"time": ts(f"2024-01-{d:02d} 01:00:00"), "seq": d * 100 + i, "model_name": "m",
                             "latency_p95_ms": float(i + d)} for d in range(1, 31) for i in range(5)],
                    extra_cols=["throughput_rps"])
    v1 = write_drift_results(drift_scan(big, "2024-01-30 00:00:00", "30d", "10d", ["latency"], "series"), root)
    v2 = write_drift_results(drift_scan(big, "2024-01-31 00:00:00", "30d", "10d", ["latency"], "series"), root, v1)
    hist = spark.read.parquet(os.path.join(root, "history"))
    assert hist.count() == 2
    latest = spark.read.parquet(v2).collect()
    assert len(latest) == 1 and str(latest[0].computed_at) == "2024-01-31 00:00:00"
