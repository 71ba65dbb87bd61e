"""Statistical comparison of models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import COMPARE_METRICS
from ..functions.exprs import finite, rnd
from ..functions.stats import student_t_two_sided_p
from ..windows import enum_window_seconds, minus_seconds, since
from .scan import exact_quantiles


def metric_values(telemetry: DataFrame, as_of, metric: str, time_window: str) -> DataFrame:
    if metric not in COMPARE_METRICS:
        raise ValueError(f"invalid metric {metric!r}; valid: {COMPARE_METRICS}")
    secs = enum_window_seconds(time_window, "24h")
    x = since(telemetry, as_of, secs).select(
        "model_name", F.col(metric).cast("double").alias("v"))
    return x.where(finite("v"))


def model_stats(telemetry: DataFrame, as_of, metric: str = "latency_p95_ms",
                time_window: str = "24h", n_chunks: int = 64) -> DataFrame:
    """n, mean, p50/p95/p99 (linear interpolation) per model, rounded 4,
    plus the unrounded mean and sample variance for the t-test."""
    vals = metric_values(telemetry, as_of, metric, time_window)
    moments = vals.groupBy("model_name").agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("_mean"), F.var_samp("v").alias("_var"))
    q = exact_quantiles(vals, ["model_name"], "v", [0.5, 0.95, 0.99], n_chunks)
    x = moments.join(q.drop("n"), "model_name", "left")
    return x.select(
        "model_name", F.lit(metric).alias("metric"), F.col("n").cast("long").alias("n"),
        rnd("_mean", 4).alias("mean"),
        *[rnd(F.col("q")[i], 4).alias(name) for i, name in enumerate(["p50", "p95", "p99"])],
        "_mean", "_var")


def welch(stats: DataFrame, pairs: DataFrame) -> DataFrame:
    """Welch t statistic and Welch-Satterthwaite df for requested (model_a, model_b)."""
    a = stats.select(*[F.col(c).alias(f"{c}_a") for c in stats.columns])
    b = stats.select(*[F.col(c).alias(f"{c}_b") for c in stats.columns])
    x = (pairs.join(a, pairs.model_a == a.model_name_a, "left")
              .join(b, pairs.model_b == b.model_name_b, "left"))
    sa, sb = F.col("_var_a") / F.col("n_a"), F.col("_var_b") / F.col("n_b")
    both = (F.col("n_a") >= 2) & (F.col("n_b") >= 2)
    t = F.try_divide(F.col("_mean_a") - F.col("_mean_b"), F.sqrt(sa + sb))
    df_ = F.try_divide((sa + sb) * (sa + sb),
                       sa * sa / (F.col("n_a") - 1) + sb * sb / (F.col("n_b") - 1))
    diff = F.when(F.col("mean_a").isNotNull() & F.col("mean_b").isNotNull() & (F.col("mean_b") != 0),
                  rnd((F.col("mean_a") - F.col("mean_b")) / F.col("mean_b") * 100.0, 2))
    return x.select(
        "model_a", "model_b", F.coalesce("metric_a", "metric_b").alias("metric"),
        F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"),
        F.col("mean_a"), F.col("mean_b"), *[F.col(f"{q}_{s}") for s in "ab" for q in ("p50", "p95", "p99")],
        F.when(both, t).alias("_t"), F.when(both, df_).alias("_df"), diff.alias("difference_pct"))


def compare_models(telemetry: DataFrame, pairs: DataFrame, as_of, metric: str = "latency_p95_ms",
                   time_window: str = "24h") -> DataFrame:
    """Full comparison for each requested pair, with the two-sided p-value
    (pandas UDF over the per-pair table) and the summary sentence."""
    st = model_stats(telemetry, as_of, metric, time_window)
    w = welch(st, pairs)
    w = w.withColumn("_p", student_t_two_sided_p(F.col("_t"), F.col("_df")))
    p = rnd("_p", 6)
    sig = F.coalesce(p < 0.05, F.lit(False))
    direction = F.when(F.col("difference_pct") > 0, "higher").otherwise("lower")
    summary = F.when(
        F.col("difference_pct").isNotNull(),
        F.format_string("mean %s: %s is %.1f%% %s than %s, p %s 0.05", F.lit(metric), F.col("model_a"),
                        rnd(F.abs("difference_pct"), 1), direction, F.col("model_b"),
                        F.when(sig, "under").otherwise("not under")),
    ).otherwise(F.format_string("%s has too few values of %s or %s",
                                F.lit(metric), F.col("model_a"), F.col("model_b")))
    status = F.when((F.col("n_a") == 0) & (F.col("n_b") == 0), "no_data").otherwise("ok")
    return w.select("model_a", "model_b", "metric", status.alias("status"), "n_a", "n_b",
                    "mean_a", "mean_b", *[f"{q}_{s}" for s in "ab" for q in ("p50", "p95", "p99")], "difference_pct", rnd("_t", 6).alias("t_statistic"),
                    p.alias("p_value"), sig.alias("statistically_significant"),
                    summary.alias("summary"))


def busiest_model_pairs(telemetry: DataFrame, as_of, time_window: str = "24h") -> DataFrame:
    """Pairs (m, busiest) for every other model m; busiest = most rows in the
    window (ties: greatest name).  A global max over per-model counts:
    partial aggregation, one row per task reaches the final merge."""
    secs = enum_window_seconds(time_window, "24h")
    counts = (since(telemetry, as_of, secs)
                       .groupBy("model_name").agg(F.count(F.lit(1)).alias("n")))
    top = counts.agg(F.max(F.struct("n", "model_name")).getField("model_name").alias("model_b"))
    models = telemetry.select(F.col("model_name").alias("model_a")).distinct()
    # `top` is exactly one row, so this is a broadcast filter, not a pair explosion
    return models.join(F.broadcast(top), F.col("model_a") != F.col("model_b"))
