"""The six query tools as DataFrame functions (Q-HEALTH ... Q-SAT).

Each takes the fact table (and result tables where needed) plus an
explicit ``as_of``; a model filter of ``None`` means all models, and every
function answers for all matching models in one Spark job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import COMPARE_METRICS, DRIFT_FRESH_MINUTES, FORECAST_FRESH_MINUTES
from .operators import advice, alerts, compare, drift, forecast, health, maintenance, rules


def get_model_health(telemetry: DataFrame, events: DataFrame, drift_scores: DataFrame, as_of,
                     model_name: str | None = None, time_window: str = "15m") -> DataFrame:
    return health.model_health(telemetry, events, drift_scores, as_of, time_window, model_name)


def detect_drift(telemetry: DataFrame, as_of, model_name: str | None = None, metric: str | None = None,
                 reference_window: str = "7d", comparison_window: str = "1h",
                 stored: DataFrame | None = None) -> DataFrame:
    """Drift with interpretation; with ``stored`` results, keys computed in the
    last 6 minutes are served from the table and only stale keys recompute."""
    t = telemetry if model_name is None else telemetry.where(F.col("model_name") == model_name)
    metrics = [metric] if metric else None

    def compute(keys: DataFrame | None = None) -> DataFrame:
        x = t if keys is None else t.join(keys.select("model_name").distinct(), "model_name", "left_semi")
        r = drift.drift_scan(x, as_of, reference_window, comparison_window, metrics)
        return r if keys is None else r.join(keys, ["model_name", "metric"], "left_semi")

    if stored is None:
        res = compute()
    else:
        names = F.array(*[F.lit(m) for m in metrics or drift.DRIFT_METRICS])
        req = t.select("model_name").distinct().select("model_name", F.explode(names).alias("metric"))
        res = maintenance.serve_with_cache(req, stored, compute, ["model_name", "metric"], as_of,
                                           DRIFT_FRESH_MINUTES)
    return advice.with_drift_advice(res)


def get_root_cause(telemetry: DataFrame, events: DataFrame, as_of, model_name: str | None = None,
                   lookback_minutes: int = 30, baselines: DataFrame | None = None) -> DataFrame:
    r = rules.root_cause(telemetry, events, as_of, lookback_minutes, baselines)
    return r if model_name is None else r.where(F.col("model_name") == model_name)


def compare_models(telemetry: DataFrame, as_of, model_a: str, model_b: str,
                   metric: str = "latency_p95_ms", time_window: str = "24h") -> DataFrame:
    if metric not in COMPARE_METRICS:
        raise ValueError(f"invalid metric {metric!r}; valid: {COMPARE_METRICS}")
    pairs = telemetry.sparkSession.createDataFrame([(model_a, model_b)], "model_a string, model_b string")
    return compare.compare_models(telemetry, pairs, as_of, metric, time_window)


def get_alerts(stored_alerts: DataFrame, external: DataFrame | None = None, model_name: str | None = None,
               severity: str | None = None, include_resolved: bool = False, limit: int = 20) -> DataFrame:
    return alerts.alert_feed(stored_alerts, external, model_name, severity, include_resolved, limit)


def predict_saturation(telemetry: DataFrame, as_of, model_name: str | None = None,
                       metric: str | None = None, horizon_hours: int = 2,
                       method: str = "auto", store=None) -> tuple[DataFrame, DataFrame]:
    """(snapshot with recommendation, points limited to the requested hours).
    Forecasts always cover the 6-hour horizon; risk refers to it.  With a
    ``store`` (``store.ResultStore``) snapshots stored in the last 35 minutes
    are served and only the other series are forecast, and stored."""
    if store is not None:
        snap, pts = store.serve_forecast(telemetry, as_of, [metric] if metric else None, horizon_hours, method)
        if model_name is not None:
            snap, pts = (x.where(F.col("model_name") == model_name) for x in (snap, pts))
        return advice.with_saturation_advice(snap), pts
    t = telemetry if model_name is None else telemetry.where(F.col("model_name") == model_name)
    snap, pts = forecast.forecast(t, as_of, [metric] if metric else None, method=method,
                                  requested_hours=horizon_hours)
    return advice.with_saturation_advice(snap), forecast.rounded_points(pts, horizon_hours)


__all__ = ["get_model_health", "detect_drift", "get_root_cause", "compare_models", "get_alerts",
           "predict_saturation", "FORECAST_FRESH_MINUTES"]
