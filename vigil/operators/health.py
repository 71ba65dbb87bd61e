"""Model health snapshot (A1, H1, J4; the get_model_health query)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import HEALTH, HEALTH_METRICS
from ..functions.exprs import rnd
from ..windows import enum_window_seconds, minus_seconds, ts_lit, since
from .panels import latest_by

SEVERITY_RANK = {"none": 0, "low": 1, "medium": 2, "high": 3}


def health_status(score: Column, kv: Column, queue: Column, free: Column, temp: Column,
                  drift_sev: Column, t=HEALTH) -> Column:
    """critical first, then degraded; NULL inputs never fire."""
    crit = ((score < t.score_critical) | (kv >= t.kv_critical) | (queue >= t.queue_critical)
            | (free < t.vram_free_critical) | (temp >= t.temp_critical) | (drift_sev == "high"))
    degr = ((score < t.score_warning) | (kv >= t.kv_warning) | (queue >= t.queue_warning)
            | (free < t.vram_free_warning) | (temp >= t.temp_warning) | (drift_sev == "medium"))
    return (F.when(F.coalesce(crit, F.lit(False)), "critical")
             .when(F.coalesce(degr, F.lit(False)), "degraded")
             .otherwise("healthy"))


def severity_rank(col: Column) -> Column:
    expr = F.lit(None).cast("int")
    for name, rank in SEVERITY_RANK.items():
        expr = F.when(col == name, rank).otherwise(expr)
    return expr


def latest_drift(drift: DataFrame, as_of) -> DataFrame:
    """Per model: severity of the newest drift row (ties broken by metric)
    and the worst severity among each metric's newest row."""
    d = drift.where(F.col("computed_at") <= ts_lit(as_of)).where(F.col("severity").isNotNull())
    newest = latest_by(d, ["model_name"], ["computed_at", "metric"], ["severity"])
    per_metric = latest_by(d, ["model_name", "metric"], ["computed_at"], ["severity"])
    worst = per_metric.groupBy("model_name").agg(
        F.max(F.struct(severity_rank(F.col("severity")).alias("r"), F.col("severity").alias("s")))
        .getField("s").alias("worst_drift_severity"))
    return newest.select("model_name", F.col("severity").alias("drift_severity")).join(
        worst, "model_name", "left")


def model_health(telemetry: DataFrame, events: DataFrame, drift: DataFrame, as_of,
                 time_window: str = "15m", model_name: str | None = None) -> DataFrame:
    secs = enum_window_seconds(time_window, "15m")
    m = since(telemetry, as_of, secs)
    if model_name:
        m = m.where(F.col("model_name") == model_name)
    snap = m.groupBy("model_name", "model_type").agg(
        *[rnd(F.avg(c), 4).alias(c) for c in HEALTH_METRICS])
    ev = latest_by(events.where(F.col("computed_at") <= ts_lit(as_of)), ["model_name"],
                   ["computed_at"], ["anomaly_score", "is_anomaly", "cold_start_mode"])
    dr = latest_drift(drift, as_of)
    x = snap.join(ev, "model_name", "left").join(dr, "model_name", "left")
    status = health_status(F.col("anomaly_score"), F.col("kv_cache_usage_pct"),
                           F.col("requests_waiting"), F.col("gpu_mem_free_mb"),
                           F.col("gpu_temp_celsius"), F.col("drift_severity"))
    return x.select(
        "model_name", "model_type", status.alias("status"), F.lit(time_window).alias("time_window"),
        *HEALTH_METRICS,
        rnd("anomaly_score", 6).alias("anomaly_score"),
        F.coalesce("is_anomaly", F.lit(False)).alias("is_anomaly"),
        F.coalesce("cold_start_mode", F.lit(False)).alias("cold_start_mode"),
        "drift_severity", "worst_drift_severity")
