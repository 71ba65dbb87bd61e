"""The telemetry fact table (one row per model and scrape tick).

``telemetry_from_events`` projects the driver's ``events`` table onto the
fact-table schema (FIXTURES.md F1).  The projection needs a per-model row
number; it is computed with the balanced two-level scan so the hot model
does not end up in one task.  Chunks are minutes: if one model held a third
of 100 TB over 90 days, a (model, minute) window partition is ~250 MB,
while the per-model chunk summary stays at 1440 rows per day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.counters import RATES, with_rates
from ..operators.scan import CHUNK, row_numbers, with_chunk

TELEMETRY_SCHEMA = T.StructType([
    T.StructField("time", T.TimestampNTZType()),
    T.StructField("seq", T.LongType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("model_type", T.StringType()),
    *[T.StructField(c, T.DoubleType()) for c in [
        "latency_p50_ms", "latency_p95_ms", "latency_p99_ms", "ttft_p50_ms", "ttft_p95_ms",
        "tpot_mean_ms"]],
    *[T.StructField(c, T.LongType()) for c in [
        "request_success_total", "prompt_tokens_total", "generation_tokens_total"]],
    T.StructField("requests_running", T.IntegerType()),
    T.StructField("requests_waiting", T.IntegerType()),
    *[T.StructField(c, T.DoubleType()) for c in [
        "kv_cache_usage_pct", "gpu_util_pct", "gpu_mem_used_mb", "gpu_mem_free_mb",
        "gpu_temp_celsius", "gpu_power_watts"]],
    T.StructField("pod_cpu_millicores", T.IntegerType()),
    T.StructField("pod_mem_mb", T.DoubleType()),
    T.StructField("rtf", T.DoubleType()),
])

DOUBLE_METRICS = [f.name for f in TELEMETRY_SCHEMA.fields if isinstance(f.dataType, T.DoubleType)]


def sanitize(df: DataFrame, columns=None) -> DataFrame:
    """NaN and +-inf become NULL (Spark orders NaN above every number)."""
    cols = columns if columns is not None else [c for c, t in df.dtypes if t in ("double", "float")]
    return df.select(*[
        F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), F.lit(None).cast("double"))
        .otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
        for c in df.columns])


def telemetry_from_events(events: DataFrame, time_chunk: str = "minute") -> DataFrame:
    return project_events(_numbered(events, time_chunk))


def rated_events(events: DataFrame, time_chunk: str = "minute") -> DataFrame:
    """Numbered events with their counters and rates, as ``project_events``
    takes them: ordered once, on narrow rows, in the (model, minute) partitions
    of the row numbers.  ``project_events(rated_events(e))`` has the rows of
    ``with_rates(telemetry_from_events(e))``."""
    return with_rates(_numbered(events, time_chunk), time_chunk=time_chunk).drop(CHUNK)


def _numbered(events: DataFrame, time_chunk: str) -> DataFrame:
    e = events.select(
        F.col("ts").alias("time"), F.col("event_id").alias("seq"), F.col("event_type").alias("model_name"), "user_id", "value",
        F.regexp_extract("props", r"([0-9]+)", 1).cast("int").alias("k"))
    e = row_numbers(with_chunk(e, F.date_trunc(time_chunk, "time")), ["model_name"], ["time", "seq"], out="rn")
    k, ctr = F.col("k"), (F.col("rn") % 400) * 3
    return e.select(
        "*",
        ctr.cast("long").alias("request_success_total"),
        (ctr * (50 + k)).cast("long").alias("prompt_tokens_total"),
        (ctr * (20 + k)).cast("long").alias("generation_tokens_total"))


def project_events(e: DataFrame) -> DataFrame:
    """The fact rows of numbered events, with their rates if they have them."""
    v, k, eid = F.col("value"), F.col("k"), F.col("seq")
    is_tts = F.col("model_name") == "purchase"
    out = e.select(
        "time",
        "seq",
        "model_name",
        F.when(is_tts, "tts").otherwise("llm").alias("model_type"),
        (v * 5.0).alias("latency_p50_ms"),
        (v * 10.0).alias("latency_p95_ms"),
        (v * 14.0).alias("latency_p99_ms"),
        (v * 2.0).alias("ttft_p50_ms"),
        F.when(k % 10 == 0, F.lit(None).cast("double")).otherwise(v * 4.0).alias("ttft_p95_ms"),
        (F.lit(20.0) + k.cast("double") / 10.0).alias("tpot_mean_ms"),
        "request_success_total",
        "prompt_tokens_total",
        "generation_tokens_total",
        (F.col("user_id") % 12).cast("int").alias("requests_running"),
        (F.col("user_id") % 30).cast("int").alias("requests_waiting"),
        k.cast("double").alias("kv_cache_usage_pct"),
        ((eid * 37) % 101).cast("double").alias("gpu_util_pct"),
        (F.lit(40000.0) - ((eid * 7919) % 40000).cast("double")).alias("gpu_mem_used_mb"),
        (F.lit(1024.0) + ((eid * 7919) % 40000).cast("double")).alias("gpu_mem_free_mb"),
        (F.lit(60.0) + ((eid * 13) % 31).cast("double")).alias("gpu_temp_celsius"),
        (F.lit(200.0) + ((eid * 17) % 200).cast("double")).alias("gpu_power_watts"),
        ((eid * 29) % 4000).cast("int").alias("pod_cpu_millicores"),
        (F.lit(1000.0) + ((eid * 31) % 8000).cast("double")).alias("pod_mem_mb"),
        F.when(is_tts, v / 40.0).alias("rtf"),
        *[c for c in RATES if c in e.columns],
    )
    return sanitize(out, DOUBLE_METRICS)
