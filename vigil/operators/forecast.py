"""Saturation forecasting.

Series are 15-minute bucket averages over the last 14 days, so one
(model, metric) series holds at most 1344 points whatever the raw volume:
windows over a series are bounded by construction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FORECAST_MAX_HORIZON_H, FORECAST_MIN_BUCKETS, SATURATION_THRESHOLDS
from ..functions.exprs import rnd
from ..windows import clamp_horizon, minus_seconds, ts_lit, since
from .panels import bucket_start, long_metrics

SERIES = ["model_name", "metric"]
BUCKET_S = 900


def bucket_series(telemetry: DataFrame, as_of, metrics: Sequence[str] | None = None,
                  days: int = 14, seconds: int = BUCKET_S) -> DataFrame:
    """AVG per (model, metric, 15-min bucket) over the trailing window (A4)."""
    metrics = list(metrics or SATURATION_THRESHOLDS)
    for m in metrics:
        if m not in SATURATION_THRESHOLDS:
            raise ValueError(f"unknown forecast metric {m!r}; valid: {list(SATURATION_THRESHOLDS)}")
    x = since(telemetry, as_of, days * 86400).select(
        "model_name", bucket_start("time", seconds).alias("bucket"), *metrics)
    return (long_metrics(x, metrics, ["model_name", "bucket"])
            .groupBy("model_name", "metric", "bucket").agg(F.avg("value").alias("y")))


def series_fit(series: DataFrame) -> DataFrame:
    """Least-squares line on the row index (gaps ignored), population std of
    y, median step between buckets (A22, W4, W5, M10)."""
    w = Window.partitionBy(*SERIES).orderBy("bucket")
    idx = series.select(
        "*", (F.row_number().over(w) - 1).cast("double").alias("x"),
        (F.unix_micros(F.col("bucket").cast("timestamp"))
         - F.unix_micros(F.lag("bucket").over(w).cast("timestamp"))).alias("_gap_us"))
    agg = idx.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("y", "x").alias("_slope"), F.regr_intercept("y", "x").alias("_icpt"),
        F.stddev_pop("y").alias("_std"), F.avg("y").alias("_mean"),
        F.max_by("y", "bucket").alias("_last_y"),
        F.percentile("_gap_us", 0.5).alias("_step_us"), F.max("bucket").alias("last_bucket"))
    one = F.col("n") < 2
    step = F.when(one | F.col("_step_us").isNull() | (F.col("_step_us") == 0), F.lit(900.0 * 1e6)) \
            .otherwise(F.col("_step_us"))
    return agg.select(
        *SERIES, "n", "last_bucket",
        F.when(one, F.lit(0.0)).otherwise(F.coalesce("_slope", F.lit(0.0))).alias("slope"),
        F.when(one, F.col("_last_y")).otherwise(F.coalesce("_icpt", F.col("_mean"))).alias("intercept"),
        F.when(one, F.lit(0.0)).otherwise(F.col("_std")).alias("std"),
        step.alias("step_us"))


def linear_points(fit: DataFrame, horizon_hours: int = FORECAST_MAX_HORIZON_H) -> DataFrame:
    """h x 4 future points after the last bucket, band = +-2 std."""
    steps = int(horizon_hours) * 4
    x = fit.select("*", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    yhat = F.col("slope") * (F.col("n") - 1 + F.col("step")) + F.col("intercept")
    ds = F.timestamp_micros(F.unix_micros(F.col("last_bucket").cast("timestamp"))
                            + (F.col("step") * F.col("step_us")).cast("long")).cast("timestamp_ntz")
    return x.select(*SERIES, "step", ds.alias("ds"), yhat.alias("yhat"),
                    (yhat - 2.0 * F.col("std")).alias("yhat_lower"),
                    (yhat + 2.0 * F.col("std")).alias("yhat_upper"))


def threshold_col(metric: Column) -> Column:
    expr = F.lit(None).cast("double")
    for m, thr in SATURATION_THRESHOLDS.items():
        expr = F.when(metric == m, F.lit(thr)).otherwise(expr)
    return expr


def risk_from_hours(hours: Column) -> Column:
    return (F.when(hours.isNull(), "low").when(hours <= 1.0, "critical").when(hours <= 3.0, "high")
             .when(hours <= 6.0, "medium").otherwise("low"))


def saturation(points: DataFrame, as_of) -> DataFrame:
    """First point whose upper band reaches the metric threshold (M12);
    hours until it, measured from ``as_of``, give the risk."""
    p = points.select("*", threshold_col(F.col("metric")).alias("threshold"))
    hit = p.where(F.col("yhat_upper") >= F.col("threshold")).groupBy(*SERIES).agg(
        F.min("ds").alias("saturation_time"))
    base = p.select(*SERIES, "threshold").distinct()
    x = base.join(hit, SERIES, "left")
    hours = (F.unix_micros(F.col("saturation_time").cast("timestamp"))
             - F.unix_micros(ts_lit(as_of).cast("timestamp"))) / 3.6e9
    return x.select(*SERIES, "threshold", "saturation_time", risk_from_hours(hours).alias("saturation_risk"),
                    hours.alias("_hours"))


def forecast(telemetry: DataFrame, as_of, metrics: Sequence[str] | None = None,
             horizon_hours: int = FORECAST_MAX_HORIZON_H, method: str = "linear",
             requested_hours: int | None = None, series: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Returns (snapshots, points) for every model x metric, from the given
    bucket ``series`` or else from a scan.

    method='linear' is the cold-start fit for all series; 'auto' uses the
    seasonal fit where a series has at least 672 buckets."""
    if series is None:
        series = bucket_series(telemetry, as_of, metrics)
    fit = series_fit(series)
    pts = linear_points(fit, horizon_hours)
    cold = F.col("n") < FORECAST_MIN_BUCKETS
    if method == "auto":
        from .seasonal import seasonal_points
        seas = seasonal_points(series, fit.where(~cold).select(*SERIES), horizon_hours)
        pts = pts.join(fit.where(cold).select(*SERIES), SERIES, "left_semi").unionByName(seas)
        cold_flag = cold
    elif method == "linear":
        cold_flag = F.lit(True)
    else:
        raise ValueError(f"unknown method {method!r}")
    sat = saturation(pts, as_of)
    req = clamp_horizon(requested_hours or horizon_hours)
    snap = fit.join(sat, SERIES, "left").select(
        ts_lit(as_of).alias("computed_at"), *SERIES, F.lit(horizon_hours).alias("horizon_hours"),
        F.col("threshold").alias("saturation_threshold"), "saturation_time", "saturation_risk",
        F.col("n").cast("int").alias("n_training_points"), cold_flag.alias("cold_start_mode"),
        (F.col("_hours") <= req).alias("saturation_within_horizon"))
    return snap, pts


def rounded_points(points: DataFrame, requested_hours: int | None = None) -> DataFrame:
    """Points as returned by the tool: prefix of h x 4 steps, rounded 4 (L4)."""
    p = points
    if requested_hours is not None:
        p = p.where(F.col("step") <= clamp_horizon(requested_hours) * 4)
    return p.select(*SERIES, "step", "ds", *[rnd(c, 4).alias(c) for c in ["yhat", "yhat_lower", "yhat_upper"]])


def snapshot_rows(snap: DataFrame, points: DataFrame) -> DataFrame:
    """forecast_snapshots rows: the snapshot plus its points as
    array<struct<timestamp, yhat, yhat_lower, yhat_upper>> in step order (S10).
    A series has at most horizon x 4 points, so the gather is bounded."""
    p = rounded_points(points).groupBy(*SERIES).agg(F.sort_array(F.collect_list(F.struct(
        "step", F.col("ds").alias("timestamp"), "yhat", "yhat_lower", "yhat_upper"))).alias("_p"))
    p = p.select(*SERIES, F.transform("_p", lambda s: s.dropFields("step")).alias("points"))
    return snap.join(p, SERIES, "left")
