"""Counter deltas and rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import COUNTER_INTERVAL_S
from .scan import CHUNK, last_non_null_before, with_chunk

KEYS = ["model_name"]
ORDER = ["time", "seq"]
RATES = ["throughput_rps", "avg_prompt_tokens", "avg_completion_tokens"]


def counter_deltas(df: DataFrame, counters: Sequence[str], time_chunk: str = "minute",
                   with_elapsed: bool = False) -> DataFrame:
    """Adds ``delta_<c>``: current minus the previous non-NULL value of the
    same model; NULL on the first value, on NULL and on a reset (cur < prev).
    ``with_elapsed`` also adds ``elapsed_<c>``: seconds since that previous
    value was observed.  Rows that carry a chunk of their time keep it, and
    with it their partitioning."""
    x = df if CHUNK in df.columns else with_chunk(df, F.date_trunc(time_chunk, "time"))
    tcols = []
    if with_elapsed:
        for c in counters:
            x = x.withColumn(f"_t_{c}", F.when(F.col(c).isNotNull(), F.unix_micros(F.col("time").cast("timestamp"))))
            tcols.append(f"_t_{c}")
    x = last_non_null_before(x, KEYS, ORDER, list(counters) + tcols, prefix="_prev_")
    cols = [F.col(c) for c in df.columns]
    for c in counters:
        cur, prev = F.col(c), F.col(f"_prev_{c}")
        cols.append(F.when(cur >= prev, (cur - prev).cast("double")).alias(f"delta_{c}"))
        if with_elapsed:
            cols.append(((F.col(f"_t_{c}") - F.col(f"_prev__t_{c}")) / 1e6).alias(f"elapsed_{c}"))
    return x.select(*cols)


def with_rates(df: DataFrame, interval_s: float = COUNTER_INTERVAL_S,
               time_chunk: str = "minute", rate_basis: str = "interval") -> DataFrame:
    """Adds ``throughput_rps`` and the documented per-request averages.

    throughput_rps        = delta(request_success_total) / interval
    avg_prompt_tokens     = delta(prompt_tokens_total) / delta(request_success_total)
    avg_completion_tokens = delta(generation_tokens_total) / delta(request_success_total)
    ``rate_basis='interval'`` divides by the configured scrape interval (the
    collector's behaviour); ``'elapsed'`` divides by the seconds actually
    elapsed since the previous observation (NULL when that is 0).
    """
    counters = ["request_success_total", "prompt_tokens_total", "generation_tokens_total"]
    elapsed = rate_basis == "elapsed"
    if rate_basis not in ("interval", "elapsed"):
        raise ValueError(f"unknown rate_basis {rate_basis!r}")
    x = counter_deltas(df, counters, time_chunk, with_elapsed=elapsed)
    d_req = F.col("delta_request_success_total")
    denom = F.col("elapsed_request_success_total") if elapsed else F.lit(float(interval_s))
    return x.select(
        *df.columns,
        F.try_divide(d_req, denom).alias("throughput_rps"),
        F.try_divide(F.col("delta_prompt_tokens_total"), d_req).alias("avg_prompt_tokens"),
        F.try_divide(F.col("delta_generation_tokens_total"), d_req).alias("avg_completion_tokens"),
    )


def vram_util_pct() -> Column:
    """used / (used + free) * 100, NULL when either side is missing or both are 0."""
    used, free = F.col("gpu_mem_used_mb"), F.col("gpu_mem_free_mb")
    return F.try_divide(used, used + free) * 100.0


def rtf_from_tokens(df: DataFrame, tts_tokens_per_second: float, interval_s: float = COUNTER_INTERVAL_S) -> Column:
    """Documented alternative RTF (P14): delta(generated tokens) / tokens per
    audio second / interval.  Needs ``delta_generation_tokens_total`` from
    ``counter_deltas``; NULL unless the model is TTS."""
    return F.when(F.col("model_type") == "tts",
                  F.col("delta_generation_tokens_total") / F.lit(float(tts_tokens_per_second)) / F.lit(float(interval_s)))
