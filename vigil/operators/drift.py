"""Distribution drift: KS two-sample test + PSI + severity.

One job for all models x metrics: a single scan of the window, unpivoted to
(model, metric, value), collapsed to distinct values with per-side counts.
Everything else (ECDFs, decile edges, bin counts) is computed on that table
with balanced running sums, so no (model, metric) group is ever gathered in
one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import (DRIFT_METRICS, DRIFT_MIN_SAMPLES, PSI_BINS, PSI_CLIP, PSI_EDGE_EPS,
                      PSI_HIGH, PSI_LOW, PSI_MEDIUM)
from ..functions.exprs import rnd
from ..functions.stats import ks_exact_pvalue, ks_series_pvalue
from ..windows import minus_seconds, ts_lit, window_seconds, since
from .scan import quantile_hits, running_sums, value_chunks

GROUP = ["model_name", "metric"]


def severity(psi: Column, p_value: Column) -> Column:
    """none < .1 <= low (medium when p < .01) < .2 <= medium < .25 <= high."""
    return (F.when(psi < PSI_LOW, "none")
             .when(psi < PSI_MEDIUM, F.when(p_value < 0.01, "medium").otherwise("low"))
             .when(psi < PSI_HIGH, "medium")
             .otherwise("high"))


def tag_windows(telemetry: DataFrame, as_of, reference_window: str, comparison_window: str,
                metrics: Sequence[str], strict: bool = False) -> DataFrame:
    """(model_name, metric, v, is_cmp) for the reference window
    [as_of - ref, as_of - cmp) and the comparison window [as_of - cmp, as_of]."""
    ref_s, cmp_s = window_seconds(reference_window), window_seconds(comparison_window)
    base = since(telemetry, as_of, ref_s)
    if strict:
        base = base.where(F.col("time") < ts_lit(as_of))
    cut = minus_seconds(as_of, cmp_s)
    wide = base.select(
        "model_name",
        (F.col("time") >= cut).cast("int").alias("is_cmp"),
        *[F.col(DRIFT_METRICS[m]).cast("double").alias(m) for m in metrics])
    return (wide.unpivot(["model_name", "is_cmp"], list(metrics), "metric", "v")
                .where(F.col("v").isNotNull()))


def distinct_counts(tagged: DataFrame) -> DataFrame:
    """(model, metric, v) -> n_r, n_c.  Map-side partial aggregation shrinks
    the shuffle to distinct values per task."""
    return tagged.groupBy(*GROUP, "v").agg(
        F.sum(1 - F.col("is_cmp")).cast("long").alias("n_r"),
        F.sum("is_cmp").cast("long").alias("n_c"))


def ecdf_table(dv: DataFrame, n_chunks: int = 64, materialized: bool = True) -> DataFrame:
    """Adds inclusive running counts cum_n_r / cum_n_c in value order.

    The table feeds four consumers (totals, KS, quantiles, bins); it is
    written once to the shared folder so it is computed once and the
    downstream plans stay small."""
    ecdf = running_sums(value_chunks(dv, GROUP, "v", n_chunks), GROUP, ["v"], ["n_r", "n_c"],
                        totals_prefix="tot_")
    if materialized:
        from ..sources.sinks import materialize
        ecdf = materialize(ecdf, "drift_ecdf")
    return ecdf


def group_stats(ecdf: DataFrame) -> DataFrame:
    """Sizes, means and the KS statistic in one aggregation over the ECDF."""
    gap = F.abs(F.try_divide(F.col("cum_n_r"), F.col("tot_n_r"))
                - F.try_divide(F.col("cum_n_c"), F.col("tot_n_c")))
    return ecdf.groupBy(*GROUP).agg(
        F.first("tot_n_r").alias("n_reference"), F.first("tot_n_c").alias("n_comparison"),
        F.try_divide(F.sum(F.col("v") * F.col("n_r")), F.first("tot_n_r")).alias("reference_mean"),
        F.try_divide(F.sum(F.col("v") * F.col("n_c")), F.first("tot_n_c")).alias("comparison_mean"),
        F.max(gap).alias("ks_statistic"))


def psi_table(ecdf: DataFrame, stats: DataFrame, n_bins: int = PSI_BINS, mode: str = "clipped") -> DataFrame:
    """PSI with reference decile edges (deduplicated, last edge + eps),
    half-open bins, out-of-range comparison values dropped, proportions
    clipped at 1e-6.  A constant reference gives 0; no reference gives NULL.

    ``mode='open'`` is the documented variant: the outer edges are -inf and
    +inf (nothing is dropped), edges are not deduplicated (empty bins stay)
    and 1e-6 is added to every proportion instead of clipping."""
    probs = [i / n_bins for i in range(n_bins + 1)]
    q = quantile_hits(ecdf, GROUP, "v", "n_r", "cum_n_r", "tot_n_r", probs)
    if mode == "open":
        return _psi_open(ecdf, stats, q, n_bins)
    if mode != "clipped":
        raise ValueError(f"unknown psi mode {mode!r}")
    edges = q.select(*GROUP, F.array_distinct("q").alias("e"))
    edges = edges.select(*GROUP, F.when(
        F.size("e") >= 2,
        F.concat(F.slice("e", 1, F.size("e") - 1),
                 F.array(F.element_at("e", -1) + F.lit(PSI_EDGE_EPS)))).alias("e"))
    usable = edges.where(F.col("e").isNotNull())
    # one row per bin: [lo, hi), the last bin closed at hi
    bins = usable.select(
        F.col("model_name").alias("_bm"), F.col("metric").alias("_bk"),
        F.posexplode(F.arrays_zip(F.slice("e", 1, F.size("e") - 1).alias("lo"),
                                  F.slice("e", 2, F.size("e")).alias("hi"))).alias("bin", "_iv"),
        (F.size("e") - 2).alias("_last"))
    bins = bins.select("_bm", "_bk", "bin", "_last", F.col("_iv.lo").alias("_lo"), F.col("_iv.hi").alias("_hi"))
    v = ecdf["v"]
    cond = ((ecdf["model_name"] == bins["_bm"]) & (ecdf["metric"] == bins["_bk"])
            & (v >= bins["_lo"]) & ((v < bins["_hi"]) | ((bins["bin"] == bins["_last"]) & (v <= bins["_hi"]))))
    binned = (ecdf.join(bins, cond, "inner")
                  .groupBy(*GROUP, "bin").agg(F.sum("n_r").alias("b_r"), F.sum("n_c").alias("b_c")))
    all_bins = bins.select(F.col("_bm").alias("model_name"), F.col("_bk").alias("metric"), "bin")
    counted = all_bins.join(binned, [*GROUP, "bin"], "left").join(
        stats.select(*GROUP, "n_reference", "n_comparison"), GROUP)
    # a side without rows has no proportions; its group is reported as insufficient_data
    rp = F.greatest(F.try_divide(F.coalesce(F.col("b_r"), F.lit(0)), F.col("n_reference")), F.lit(PSI_CLIP))
    cp = F.greatest(F.try_divide(F.coalesce(F.col("b_c"), F.lit(0)), F.col("n_comparison")), F.lit(PSI_CLIP))
    psi = counted.groupBy(*GROUP).agg(F.sum((cp - rp) * F.log(cp / rp)).alias("psi"))
    return edges.join(psi, GROUP, "left").select(*GROUP, F.coalesce("psi", F.lit(0.0)).alias("psi"))


def _psi_open(ecdf: DataFrame, stats: DataFrame, q: DataFrame, n_bins: int) -> DataFrame:
    interior = F.slice("q", 2, n_bins - 1)
    lows = F.concat(F.array(F.lit(float("-inf"))), interior)
    highs = F.concat(interior, F.array(F.lit(float("inf"))))
    bins = q.select(F.col("model_name").alias("_bm"), F.col("metric").alias("_bk"),
                    F.posexplode(F.arrays_zip(lows.alias("lo"), highs.alias("hi"))).alias("bin", "_iv"))
    bins = bins.select("_bm", "_bk", "bin", F.col("_iv.lo").alias("_lo"), F.col("_iv.hi").alias("_hi"))
    v = ecdf["v"]
    cond = ((ecdf["model_name"] == bins["_bm"]) & (ecdf["metric"] == bins["_bk"])
            & (v >= bins["_lo"]) & (v < bins["_hi"]))
    binned = (ecdf.join(bins, cond, "inner")
                  .groupBy(*GROUP, "bin").agg(F.sum("n_r").alias("b_r"), F.sum("n_c").alias("b_c")))
    all_bins = bins.select(F.col("_bm").alias("model_name"), F.col("_bk").alias("metric"), "bin")
    counted = all_bins.join(binned, [*GROUP, "bin"], "left").join(
        stats.select(*GROUP, "n_reference", "n_comparison"), GROUP)
    rp = F.try_divide(F.coalesce(F.col("b_r"), F.lit(0)), F.col("n_reference")) + F.lit(PSI_CLIP)
    cp = F.try_divide(F.coalesce(F.col("b_c"), F.lit(0)), F.col("n_comparison")) + F.lit(PSI_CLIP)
    psi = counted.groupBy(*GROUP).agg(F.sum((cp - rp) * F.log(cp / rp)).alias("psi"))
    return q.select(*GROUP).join(psi, GROUP, "left")


def drift_scan(telemetry: DataFrame, as_of, reference_window: str = "7d",
               comparison_window: str = "1h", metrics: Sequence[str] | None = None,
               p_method: str = "auto", strict: bool = False, n_chunks: int = 64,
               psi_mode: str = "clipped") -> DataFrame:
    """Drift check for every model x metric.

    ``p_method``: 'series' (asymptotic, JVM-side), 'exact' (lattice paths in
    a pandas UDF over the per-group result), or 'auto' (exact when
    max(n, m) <= 10000, series above).
    """
    metrics = list(metrics or DRIFT_METRICS)
    for m in metrics:
        if m not in DRIFT_METRICS:
            raise ValueError(f"unknown drift metric {m!r}; valid: {list(DRIFT_METRICS)}")
    tagged = tag_windows(telemetry, as_of, reference_window, comparison_window, metrics, strict)
    return drift_from_counts(distinct_counts(tagged), telemetry.select("model_name").distinct(), as_of, reference_window,
                             comparison_window, metrics, p_method, n_chunks, psi_mode)


def drift_from_counts(dv: DataFrame, models: DataFrame, as_of, reference_window: str, comparison_window: str,
                      metrics: Sequence[str], p_method: str = "auto", n_chunks: int = 64,
                      psi_mode: str = "clipped") -> DataFrame:
    """Drift rows from per-side counts of distinct values (``distinct_counts``),
    wherever they come from: one scan, or merged per-day state."""
    ecdf = ecdf_table(dv, n_chunks)
    stats = group_stats(ecdf)
    psi = psi_table(ecdf, stats, mode=psi_mode)

    grid = models.select(
        "model_name", F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric"))
    res = grid.join(stats, GROUP, "left").join(psi, GROUP, "left")
    n_r = F.coalesce(F.col("n_reference"), F.lit(0)).cast("int")
    n_c = F.coalesce(F.col("n_comparison"), F.lit(0)).cast("int")
    ok = (n_r >= DRIFT_MIN_SAMPLES) & (n_c >= DRIFT_MIN_SAMPLES)
    series = ks_series_pvalue(F.col("n_reference"), F.col("n_comparison"), F.col("ks_statistic"))
    if p_method == "series":
        p = series
    elif p_method in ("exact", "auto"):
        # the UDF runs on every row whatever stands around it: rows that are not
        # its own reach it as nulls, which cost nothing
        mine = ok if p_method == "exact" else ok & (F.greatest("n_reference", "n_comparison") <= 10000)
        exact = ks_exact_pvalue(*[F.when(mine, F.col(c)) for c in ("n_reference", "n_comparison", "ks_statistic")])
        p = F.when(mine, exact).otherwise(series)
    else:
        raise ValueError(f"unknown p_method {p_method!r}")
    res = res.select("*", F.when(ok, p).alias("_p"))
    ref_mean, cmp_mean = F.col("reference_mean"), F.col("comparison_mean")
    drift_pct = F.when(ref_mean != 0, (cmp_mean - ref_mean) / ref_mean * 100.0).otherwise(0.0)
    return res.select(
        ts_lit(as_of).alias("computed_at"),
        "model_name", "metric",
        F.when(ok, "ok").otherwise("insufficient_data").alias("status"),
        F.when(ok, severity(F.col("psi"), F.col("_p"))).alias("severity"),
        F.when(ok, rnd("ks_statistic", 6)).alias("ks_statistic"),
        F.when(ok, rnd("_p", 6)).alias("ks_p_value"),
        F.when(ok, rnd("psi", 6)).alias("psi"),
        F.when(ok, rnd(ref_mean, 4)).alias("reference_mean"),
        F.when(ok, rnd(cmp_mean, 4)).alias("comparison_mean"),
        F.when(ok, rnd(drift_pct, 2)).alias("drift_pct"),
        n_r.alias("n_reference"), n_c.alias("n_comparison"),
        F.lit(reference_window).alias("reference_window"),
        F.lit(comparison_window).alias("comparison_window"))
