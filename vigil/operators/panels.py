"""Time-bucketed aggregates behind the dashboard panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import rnd

# the seven panels of the overview dashboard (metric column per panel)
PANEL_METRICS = ["latency_p95_ms", "kv_cache_usage_pct", "gpu_util_pct", "requests_waiting",
                 "throughput_rps", "gpu_mem_free_mb", "gpu_temp_celsius"]
LATENCY_METRICS = ["latency_p50_ms", "latency_p95_ms", "latency_p99_ms"]


def bucket_start(time_col: str, seconds: int) -> Column:
    """Epoch-aligned bucket start; equals ``window(time, '<seconds> seconds').start``."""
    return F.window(time_col, f"{int(seconds)} seconds").getField("start")


def long_metrics(df: DataFrame, metrics: Sequence[str], ids: Sequence[str]) -> DataFrame:
    wide = df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics])
    return wide.unpivot(list(ids), list(metrics), "metric", "value").where(
        F.col("value").isNotNull())


def bucketed_avg(df: DataFrame, metrics: Sequence[str], seconds: int,
                 time_from=None, time_to=None, models: Sequence[str] | None = None,
                 digits: int = 6) -> DataFrame:
    """AVG per (model, metric, bucket); NULL samples are skipped."""
    x = df
    if time_from is not None:
        x = x.where(F.col("time") >= time_from)
    if time_to is not None:
        x = x.where(F.col("time") < time_to)
    if models:
        x = x.where(F.col("model_name").isin(list(models)))
    x = x.select("model_name", bucket_start("time", seconds).alias("bucket"), *metrics)
    lng = long_metrics(x, metrics, ["model_name", "bucket"])
    return (lng.groupBy("model_name", "metric", "bucket")
               .agg(rnd(F.avg("value"), digits).alias("avg_value"),
                    F.count(F.lit(1)).alias("n")))


def legend_reductions(series: DataFrame, keys: Sequence[str], ts_col: str, value: str,
                      digits: int = 6) -> DataFrame:
    """Panel legend: last (by time), mean and max per series."""
    return series.groupBy(*keys).agg(
        F.max_by(value, ts_col).alias("last_value"),
        rnd(F.avg(value), digits).alias("mean_value"),
        F.max(value).alias("max_value"))


def liveness(df: DataFrame) -> DataFrame:
    """COUNT(*) and MAX(time) per model."""
    return df.groupBy("model_name").agg(F.count(F.lit(1)).alias("n_rows"),
                                        F.max("time").alias("last_time"))


def distinct_models(df: DataFrame) -> DataFrame:
    """DISTINCT (model, type); a model seen with two types keeps the smallest (A10).

    Distinct pairs first (hash aggregate on the keys), then the per-model
    minimum over that tiny table: a string ``min`` over the raw rows would
    plan a sort-based aggregate over the whole fact table."""
    pairs = df.select("model_name", "model_type").distinct()
    return pairs.groupBy("model_name").agg(F.min("model_type").alias("model_type"))


def heatmap(df: DataFrame, metric: str, seconds: int) -> DataFrame:
    """AVG(metric) per bucket and model, one row a cell (A23): every model of
    the data has its cells, whatever its name."""
    x = df.select(bucket_start("time", seconds).alias("bucket"), "model_name", metric)
    return x.groupBy("bucket", "model_name").agg(rnd(F.avg(metric), 6).alias("avg_value"))


_FIXED = ("int", "bigint", "smallint", "tinyint", "double", "float", "boolean", "timestamp", "timestamp_ntz",
          "date")


def latest_by(df: DataFrame, keys: Sequence[str], ts_cols: Sequence[str],
              values: Sequence[str]) -> DataFrame:
    """Newest row per key (W2), without sorting the input.

    One ordering column and fixed-width values: per-column ``max_by`` -- a
    hash aggregate with map-side combine, so even a hot key costs one small
    record per task in the shuffle (the ordering column must be unique
    within a key).  Otherwise (a tie-break column, or string/array values,
    which would force a sort-based aggregate): a hash ``max`` of the first
    ordering column, a semi-join back to the rows holding it, and a struct
    ``max`` over those few survivors only.
    """
    types = dict(df.dtypes)
    fixed = all(types[v] in _FIXED or types[v].startswith("decimal") for v in values)
    if len(ts_cols) == 1 and fixed:
        ts = ts_cols[0]
        return df.groupBy(*keys).agg(F.max(ts).alias(ts), *[F.max_by(v, ts).alias(v) for v in values])
    lead = ts_cols[0]
    top = df.groupBy(*keys).agg(F.max(lead).alias(lead))
    survivors = df.join(top, [*keys, lead], "left_semi")
    packed = F.struct(*[F.col(c) for c in ts_cols], *[F.col(v) for v in values])
    agg = survivors.groupBy(*keys).agg(F.max(packed).alias("_m"))
    return agg.select(*keys, *[F.col("_m").getField(c).alias(c) for c in [*ts_cols, *values]])
