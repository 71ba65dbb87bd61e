"""Human-readable interpretation / recommendation lookups.

The texts are our own wording, generated from a small rule (metric label x
severity phrase) into a dimension table that is broadcast-joined, with a
default when a (metric, level) pair is missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRIC_LABELS = {
    "prompt_tokens": "prompt size", "completion_tokens": "completion size", "latency": "p95 latency",
    "throughput": "throughput", "rtf": "real-time factor",
    "requests_waiting": "queue depth", "kv_cache_usage_pct": "KV cache usage", "gpu_util_pct": "GPU utilisation",
}
DRIFT_PHRASES = {"none": "is stable", "low": "has shifted slightly", "medium": "has shifted noticeably",
                 "high": "has shifted strongly"}
DRIFT_ACTIONS = {"medium": "compare recent inputs and configuration with the reference window",
                 "high": "open a root-cause analysis and review recent releases"}
RISK_ACTIONS = {"low": "no capacity action is needed", "medium": "plan extra capacity within the day",
                "high": "add capacity within hours", "critical": "add capacity or shed load now"}

# what to do about each diagnosis rule (R0: none matched)
RULE_ACTIONS = {
    "R0": "No action; keep watching.",
    "R1": "Give the cache more memory, or admit fewer or shorter requests.",
    "R2": "Profile the host: tokeniser threads, request handling and storage.",
    "R3": "Add a replica or spread the load.",
    "R4": "Look at prompt lengths and at how prefill is batched.",
    "R5": "Check cooling and power limits of the node.",
    "R6": "Free GPU memory: smaller batches, or fewer models on the card.",
    "R7": "Lower the synthesis load or move it to a faster card.",
    "R8": "Check the listed metrics together with recent changes.",
}


def drift_texts() -> list[tuple[str, str, str, str]]:
    rows = []
    for m, label in list(METRIC_LABELS.items())[:5]:
        for sev, phrase in DRIFT_PHRASES.items():
            interp = f"The {label} distribution {phrase}."
            rec = ("No action needed; keep monitoring." if sev in ("none", "low")
                   else f"For {label}: {DRIFT_ACTIONS[sev]}.")
            rows.append((m, sev, interp, rec))
    return rows


def saturation_texts() -> list[tuple[str, str, str]]:
    return [(m, risk, f"Forecast {label}: {action}.")
            for m, label in list(METRIC_LABELS.items())[5:] + [("rtf", METRIC_LABELS["rtf"])]
            for risk, action in RISK_ACTIONS.items()]


def with_drift_advice(drift: DataFrame) -> DataFrame:
    spark: SparkSession = drift.sparkSession
    dim = spark.createDataFrame(drift_texts(), "metric string, severity string, interpretation string, "
                                               "recommendation string")
    x = drift.join(F.broadcast(dim), ["metric", "severity"], "left")
    return x.select(*drift.columns,
                    F.coalesce("interpretation", F.format_string("Drift severity %s for %s.", F.col("severity"),
                                                                 F.col("metric"))).alias("interpretation"),
                    F.coalesce("recommendation", F.lit("Review the metric and recent changes.")).alias("recommendation"))


def with_saturation_advice(snap: DataFrame) -> DataFrame:
    dim = snap.sparkSession.createDataFrame(saturation_texts(), "metric string, saturation_risk string, "
                                                                "recommendation string")
    x = snap.join(F.broadcast(dim), ["metric", "saturation_risk"], "left")
    return x.select(*snap.columns, F.coalesce("recommendation", F.lit(
        "Watch the trend and plan capacity accordingly.")).alias("recommendation"))
