"""Thresholds and fixed values.

FIXED VALUES: the numbers and names below must equal the behaviour being
reproduced (metric allow-lists, thresholds, window names), so they are stated
plainly here, once, and referenced everywhere else.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---- FIXED VALUES (must match the reproduced behaviour) --------------------

# drift: metric name -> telemetry column
DRIFT_METRICS = {
    "prompt_tokens": "prompt_tokens_total",
    "completion_tokens": "generation_tokens_total",
    "latency": "latency_p95_ms",
    "throughput": "throughput_rps",
    "rtf": "rtf",
}
DRIFT_MIN_SAMPLES = 30
PSI_LOW, PSI_MEDIUM, PSI_HIGH = 0.1, 0.2, 0.25
PSI_BINS = 10
PSI_EDGE_EPS = 1e-9
PSI_CLIP = 1e-6

# enumerated windows (health defaults to 15m, compare to 24h)
ENUM_WINDOWS_MINUTES = {"5m": 5, "15m": 15, "1h": 60, "6h": 360, "24h": 1440}

# compare: allowed metrics
COMPARE_METRICS = [
    "latency_p95_ms", "latency_p99_ms", "latency_p50_ms",
    "ttft_p95_ms", "tpot_mean_ms",
    "throughput_rps", "kv_cache_usage_pct",
    "requests_waiting", "gpu_util_pct", "rtf",
]

# health snapshot averages, in output order
HEALTH_METRICS = [
    "latency_p95_ms", "latency_p99_ms", "ttft_p95_ms", "tpot_mean_ms",
    "throughput_rps", "requests_running", "requests_waiting",
    "kv_cache_usage_pct", "gpu_util_pct", "gpu_mem_free_mb",
    "gpu_temp_celsius", "gpu_power_watts", "rtf",
]

# root-cause snapshot averages
RCA_METRICS = [
    "latency_p95_ms", "ttft_p95_ms", "tpot_mean_ms", "kv_cache_usage_pct",
    "requests_waiting", "gpu_util_pct", "gpu_temp_celsius", "gpu_mem_free_mb", "rtf",
]

# anomaly features by model type (slot 3 differs)
FEATURES_LLM = ["latency_p95_ms", "gpu_util_pct", "kv_cache_usage_pct", "requests_waiting"]
FEATURES_TTS = ["latency_p95_ms", "gpu_util_pct", "rtf", "requests_waiting"]
COLD_START_SCORE = -0.1
FOREST_TREES = 100
FOREST_SAMPLE = 256
FOREST_CONTAMINATION = 0.05
FOREST_SEED = 42
TRAIN_MIN_ROWS = 10

# forecast: metric -> saturation threshold
SATURATION_THRESHOLDS = {
    "requests_waiting": 20.0,
    "kv_cache_usage_pct": 90.0,
    "gpu_util_pct": 95.0,
    "rtf": 1.0,
}
FORECAST_MIN_BUCKETS = 672
FORECAST_MAX_HORIZON_H = 6
COUNTER_INTERVAL_S = 15.0

# result-cache freshness
DRIFT_FRESH_MINUTES = 6
FORECAST_FRESH_MINUTES = 35

# retention
RETENTION_DAYS = {"inference_metrics": 90, "anomaly_events": 90, "drift_scores": 90,
                  "forecast_snapshots": 30}

# alert score bands (inclusive at both cut points)
ALERT_CRITICAL_SCORE = -0.15
ALERT_WARNING_SCORE = -0.05


@dataclass(frozen=True)
class HealthThresholds:
    score_critical: float = -0.15      # strict <
    score_warning: float = -0.05       # strict <
    kv_critical: float = 90.0          # >=
    kv_warning: float = 75.0
    queue_critical: float = 20.0       # >=
    queue_warning: float = 5.0
    vram_free_critical: float = 2048.0  # strict <
    vram_free_warning: float = 4096.0
    temp_critical: float = 87.0        # >=
    temp_warning: float = 80.0


@dataclass(frozen=True)
class RuleThresholds:
    kv_pct: float = 90.0
    kv_queue: float = 5.0
    latency_factor: float = 2.0
    cpu_gpu_util: float = 30.0
    capacity_queue: float = 20.0
    capacity_gpu_util: float = 90.0
    ttft_factor: float = 2.0
    tpot_stable: float = 0.2
    thermal_c: float = 85.0
    vram_free_mb: float = 2048.0
    vram_missing_default: float = 99999.0
    rtf: float = 1.0
    multi_dim_score: float = -0.15


@dataclass(frozen=True)
class ThresholdAlertRules:
    """Documented alert table (warning, critical) per metric."""
    latency_factor: tuple = (2.0, 3.0)          # x 7-day baseline, strict >
    requests_waiting: tuple = (5.0, 20.0)       # strict >
    kv_cache_usage_pct: tuple = (75.0, 90.0)    # strict >
    gpu_mem_free_mb: tuple = (4096.0, 2048.0)   # strict <
    gpu_temp_celsius: tuple = (80.0, 87.0)      # strict >
    rtf: tuple = (0.8, 1.0)                     # strict >, TTS only


HEALTH = HealthThresholds()
RULES = RuleThresholds()
THRESHOLD_ALERTS = ThresholdAlertRules()

# diagnosis titles (rule id -> root cause)
ROOT_CAUSES = {
    "R1": "KV cache saturation causing request queuing",
    "R2": "CPU-side bottleneck: tokenisation or pre/post-processing delay",
    "R3": "Model at full GPU capacity: request throughput exceeds serving capacity",
    "R4": "Prefill bottleneck: long prompts or chunked prefill queue congestion",
    "R5": "GPU thermal throttling reducing effective compute throughput",
    "R6": "VRAM near exhaustion causing OOM risk and potential evictions",
    "R7": "TTS Real-Time Factor exceeded: synthesis speed below real-time requirement",
    "R8": "Multi-dimensional anomaly: correlated degradation across multiple metrics",
}
# matched / max conditions per rule
RULE_CONDITIONS = {"R1": (2, 2), "R2": (2, 2), "R3": (2, 2), "R4": (2, 2),
                   "R5": (1, 1), "R6": (1, 1), "R7": (1, 1), "R8": (1, 2)}

# ---- end of fixed values ---------------------------------------------------
