"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

The fact-table projection is plain window SQL here; the Spark side computes
the same values with balanced scans.  Float outputs are rounded half away
from zero on the binary value on both sides (``R``).
"""

from __future__ import annotations

from ..config import DRIFT_METRICS, PSI_BINS, PSI_CLIP, PSI_EDGE_EPS, ROOT_CAUSES
from ..operators.advice import RULE_ACTIONS

AS_OF = "2024-01-31 00:00:00"


def R(expr: str, digits: int) -> str:
    """``expr`` rounded half away from zero in plain IEEE arithmetic; never -0.0."""
    scale = f"{10.0 ** digits!r}"
    return (f"(CASE WHEN ({expr}) < 0 THEN -floor(-({expr}) * {scale} + 0.5) / {scale} "
            f"ELSE floor(({expr}) * {scale} + 0.5) / {scale} END + 0.0)")


def ks_p(n: str, m: str, d: str) -> str:
    """Two-sided asymptotic p of the KS statistic ``d``: 2 sum (-1)^(k-1) exp(-2 k^2 l^2) over 100 terms,
    l = (sqrt(e) + 0.12 + 0.11 / sqrt(e)) d, e = nm / (n + m)."""
    e = f"(CAST({n} AS DOUBLE) * {m} / ({n} + {m}))"
    lam = f"((sqrt({e}) + 0.12 + 0.11 / sqrt({e})) * {d})"
    terms = f"list_transform(range(1, 101), lambda k: pow(-1.0, k - 1) * exp(-2.0 * k * k * {lam} * {lam}))"
    return f"(CASE WHEN {lam} < 0.2 THEN 1.0 ELSE least(greatest(2.0 * list_reduce({terms}, lambda a, b: a + b, 0.0), 0.0), 1.0) END)"


def ts(s: str) -> str:
    return f"TIMESTAMP '{s}'"


def minus(as_of: str, seconds: int) -> str:
    return f"({ts(as_of)} - INTERVAL {int(seconds)} SECOND)"


TELEMETRY_CTE = """
_e AS (
  SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
         ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn
  FROM events),
_base AS (
  SELECT ts AS time, event_id AS seq, event_type AS model_name,
    CASE WHEN event_type = 'purchase' THEN 'tts' ELSE 'llm' END AS model_type,
    value * 5.0 AS latency_p50_ms, value * 10.0 AS latency_p95_ms, value * 14.0 AS latency_p99_ms,
    value * 2.0 AS ttft_p50_ms, CASE WHEN k % 10 = 0 THEN NULL ELSE value * 4.0 END AS ttft_p95_ms,
    20.0 + CAST(k AS DOUBLE) / 10.0 AS tpot_mean_ms,
    CAST((rn % 400) * 3 AS BIGINT) AS request_success_total,
    CAST((rn % 400) * 3 * (50 + k) AS BIGINT) AS prompt_tokens_total,
    CAST((rn % 400) * 3 * (20 + k) AS BIGINT) AS generation_tokens_total,
    CAST(user_id % 12 AS INT) AS requests_running, CAST(user_id % 30 AS INT) AS requests_waiting,
    CAST(k AS DOUBLE) AS kv_cache_usage_pct,
    CAST((event_id * 37) % 101 AS DOUBLE) AS gpu_util_pct,
    40000.0 - CAST((event_id * 7919) % 40000 AS DOUBLE) AS gpu_mem_used_mb,
    1024.0 + CAST((event_id * 7919) % 40000 AS DOUBLE) AS gpu_mem_free_mb,
    60.0 + CAST((event_id * 13) % 31 AS DOUBLE) AS gpu_temp_celsius,
    200.0 + CAST((event_id * 17) % 200 AS DOUBLE) AS gpu_power_watts,
    CAST((event_id * 29) % 4000 AS INT) AS pod_cpu_millicores,
    1000.0 + CAST((event_id * 31) % 8000 AS DOUBLE) AS pod_mem_mb,
    CASE WHEN event_type = 'purchase' THEN value / 40.0 END AS rtf
  FROM _e),
_prev AS (
  SELECT *,
    last_value(request_success_total IGNORE NULLS) OVER _w AS _p_req,
    last_value(prompt_tokens_total IGNORE NULLS) OVER _w AS _p_prompt,
    last_value(generation_tokens_total IGNORE NULLS) OVER _w AS _p_gen
  FROM _base
  WINDOW _w AS (PARTITION BY model_name ORDER BY time, seq
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
_deltas AS (
  SELECT * EXCLUDE (_p_req, _p_prompt, _p_gen),
    CASE WHEN request_success_total >= _p_req THEN CAST(request_success_total - _p_req AS DOUBLE) END AS _d_req,
    CASE WHEN prompt_tokens_total >= _p_prompt THEN CAST(prompt_tokens_total - _p_prompt AS DOUBLE) END AS _d_prompt,
    CASE WHEN generation_tokens_total >= _p_gen THEN CAST(generation_tokens_total - _p_gen AS DOUBLE) END AS _d_gen
  FROM _prev),
telemetry AS (
  SELECT * EXCLUDE (_d_req, _d_prompt, _d_gen),
    _d_req / 15.0 AS throughput_rps,
    CASE WHEN _d_req <> 0 THEN _d_prompt / _d_req END AS avg_prompt_tokens,
    CASE WHEN _d_req <> 0 THEN _d_gen / _d_req END AS avg_completion_tokens
  FROM _deltas)
"""


def with_telemetry(*ctes: str, body: str) -> str:
    parts = [TELEMETRY_CTE.strip()] + [c.strip() for c in ctes]
    return "WITH " + ",\n".join(parts) + "\n" + body


# ---------------------------------------------------------------- drift ----

def bucket(col: str, seconds: int) -> str:
    if seconds == 60:
        return f"date_trunc('minute', {col})"
    return f"time_bucket(INTERVAL {int(seconds)} SECOND, {col})"


SEVERITY_SQL = """CASE WHEN psi < 0.1 THEN 'none'
  WHEN psi < 0.2 THEN CASE WHEN p < 0.01 THEN 'medium' ELSE 'low' END
  WHEN psi < 0.25 THEN 'medium' ELSE 'high' END"""


def drift_ctes(as_of: str, ref: str = "30d", cmp: str = "10d", sfx: str = "", metrics=None) -> list[str]:
    """CTEs ending in ``_drift_rows{sfx}`` (the drift_scan output)."""
    from ..windows import window_seconds
    ref_s, cmp_s = window_seconds(ref), window_seconds(cmp)
    metrics = list(metrics or DRIFT_METRICS)
    n = lambda base: f"{base}{sfx}"
    cols = ", ".join(f"CAST({DRIFT_METRICS[m]} AS DOUBLE) AS {m}" for m in metrics)
    probs = ", ".join(f"{i / PSI_BINS!r}" for i in range(PSI_BINS + 1))
    return [
        f"""{n('_tag')} AS (
  SELECT model_name, metric, v, is_cmp FROM (
    SELECT model_name, CAST(time >= {minus(as_of, cmp_s)} AS INT) AS is_cmp, {cols}
    FROM telemetry WHERE time >= {minus(as_of, ref_s)} AND time <= {ts(as_of)})
  UNPIVOT (v FOR metric IN ({", ".join(metrics)})))""",
        f"""{n('_dv')} AS (
  SELECT model_name, metric, v, CAST(SUM(1 - is_cmp) AS BIGINT) AS n_r, CAST(SUM(is_cmp) AS BIGINT) AS n_c
  FROM {n('_tag')} GROUP BY model_name, metric, v)""",
        f"""{n('_tot')} AS (
  SELECT model_name, metric, CAST(SUM(n_r) AS BIGINT) AS nr, CAST(SUM(n_c) AS BIGINT) AS nc,
         SUM(v * n_r) / SUM(n_r) AS rm, SUM(v * n_c) / SUM(n_c) AS cm
  FROM {n('_dv')} GROUP BY model_name, metric)""",
        f"""{n('_ec')} AS (
  SELECT d.*, SUM(n_r) OVER _w AS cr, SUM(n_c) OVER _w AS cc FROM {n('_dv')} d
  WINDOW _w AS (PARTITION BY model_name, metric ORDER BY v ROWS UNBOUNDED PRECEDING))""",
        f"""{n('_ks')} AS (
  SELECT e.model_name, e.metric, MAX(ABS(cr / t.nr - cc / t.nc)) AS d
  FROM {n('_ec')} e JOIN {n('_tot')} t USING (model_name, metric) GROUP BY e.model_name, e.metric)""",
        f"""{n('_q')} AS (
  SELECT model_name, metric, list_sort(list_distinct(quantile_cont(v, [{probs}]))) AS q
  FROM {n('_tag')} WHERE is_cmp = 0 GROUP BY model_name, metric)""",
        f"""{n('_edges')} AS (
  SELECT model_name, metric,
    list_concat(q[1:len(q) - 1], [q[len(q)] + {PSI_EDGE_EPS!r}]) AS e
  FROM {n('_q')} WHERE len(q) >= 2)""",
        f"""{n('_bins')} AS (
  SELECT model_name, metric, unnest(range(0, len(e) - 1)) AS bin FROM {n('_edges')})""",
        f"""{n('_binned')} AS (
  SELECT d.model_name, d.metric,
    least(len(list_filter(e, lambda b: b <= d.v)), len(e) - 1) - 1 AS bin,
    SUM(n_r) AS b_r, SUM(n_c) AS b_c
  FROM {n('_dv')} d JOIN {n('_edges')} g USING (model_name, metric)
  WHERE d.v >= e[1] AND d.v <= e[len(e)]
  GROUP BY ALL)""",
        f"""{n('_psi')} AS (
  SELECT b.model_name, b.metric,
    SUM((greatest(COALESCE(x.b_c, 0) / t.nc, {PSI_CLIP!r}) - greatest(COALESCE(x.b_r, 0) / t.nr, {PSI_CLIP!r}))
        * ln(greatest(COALESCE(x.b_c, 0) / t.nc, {PSI_CLIP!r}) / greatest(COALESCE(x.b_r, 0) / t.nr, {PSI_CLIP!r}))) AS psi
  FROM {n('_bins')} b LEFT JOIN {n('_binned')} x USING (model_name, metric, bin)
  JOIN {n('_tot')} t ON t.model_name = b.model_name AND t.metric = b.metric
  GROUP BY b.model_name, b.metric)""",
        f"""{n('_grid')} AS (
  SELECT model_name, unnest([{", ".join(repr(m) for m in metrics)}]) AS metric
  FROM (SELECT DISTINCT model_name FROM telemetry))""",
        f"""{n('_drift')} AS (
  SELECT g.model_name, g.metric,
    CAST(COALESCE(t.nr, 0) AS INT) AS n_reference, CAST(COALESCE(t.nc, 0) AS INT) AS n_comparison,
    COALESCE(t.nr, 0) >= 30 AND COALESCE(t.nc, 0) >= 30 AS ok,
    t.rm, t.cm, k.d,
    CASE WHEN q.model_name IS NOT NULL THEN COALESCE(p.psi, 0.0) END AS psi,
    {ks_p("t.nr", "t.nc", "k.d")} AS p
  FROM {n('_grid')} g
  LEFT JOIN {n('_tot')} t ON t.model_name = g.model_name AND t.metric = g.metric
  LEFT JOIN {n('_ks')} k ON k.model_name = g.model_name AND k.metric = g.metric
  LEFT JOIN {n('_q')} q ON q.model_name = g.model_name AND q.metric = g.metric
  LEFT JOIN {n('_psi')} p ON p.model_name = g.model_name AND p.metric = g.metric)""",
        f"""{n('_drift_rows')} AS (
  SELECT {ts(as_of)} AS computed_at, model_name, metric,
  CASE WHEN ok THEN 'ok' ELSE 'insufficient_data' END AS status,
  CASE WHEN ok THEN {SEVERITY_SQL} END AS severity,
  CASE WHEN ok THEN {R('d', 6)} END AS ks_statistic,
  CASE WHEN ok THEN {R('p', 6)} END AS ks_p_value,
  CASE WHEN ok THEN {R('psi', 6)} END AS psi,
  CASE WHEN ok THEN {R('rm', 4)} END AS reference_mean,
  CASE WHEN ok THEN {R('cm', 4)} END AS comparison_mean,
  CASE WHEN ok THEN {R('CASE WHEN rm <> 0 THEN (cm - rm) / rm * 100.0 ELSE 0.0 END', 2)} END AS drift_pct,
  n_reference, n_comparison, '{ref}' AS reference_window, '{cmp}' AS comparison_window
  FROM {n('_drift')})""",
    ]


def drift_scan_sql(as_of: str = AS_OF) -> str:
    return with_telemetry(*drift_ctes(as_of), body="SELECT * FROM _drift_rows")


def drift_history_sql() -> str:
    import datetime as dt
    ctes, parts = [], []
    for d in (2, 1, 0):
        a = (dt.datetime.fromisoformat(AS_OF) - dt.timedelta(days=d)).strftime("%Y-%m-%d %H:%M:%S")
        ctes += drift_ctes(a, sfx=f"_{d}")
        parts.append(f"SELECT * FROM _drift_rows_{d}")
    return with_telemetry(*ctes, body=" UNION ALL ".join(parts))


def drift_incremental_sql() -> str:
    return with_telemetry(*drift_ctes("2024-01-30 13:37:00", "20d", "36h"), body="SELECT * FROM _drift_rows")


def drift_psi_sql(as_of: str = AS_OF) -> str:
    return with_telemetry(*drift_ctes(as_of), body="SELECT model_name, metric, psi FROM _drift_rows WHERE status = 'ok'")


def drift_ks_sql(as_of: str = AS_OF) -> str:
    return with_telemetry(*drift_ctes(as_of), body="""SELECT model_name, metric, n_reference, n_comparison,
  ks_statistic, ks_p_value FROM _drift_rows WHERE status = 'ok'""")


# ------------------------------------------------------ shared pieces -----

def events_cte(as_of: str = AS_OF) -> str:
    """``_events``: z-score events of every model and minute."""
    vec = ", ".join(f"COALESCE(avg({e}), 0.0) AS {s}" for s, e in SLOT_SQL.items())
    z = ", ".join(f"CASE WHEN b.std_{s} > 1e-12 THEN abs((v.{s} - b.mean_{s}) / b.std_{s}) END" for s in SLOT_SQL)
    dev = {s: f"CASE WHEN b.mean_{s} <> 0 THEN abs((v.{s} - b.mean_{s}) / b.mean_{s}) * 100.0 ELSE abs(v.{s}) * 100.0 END"
           for s in SLOT_SQL}
    devs = ", ".join(f"{R(d, 2)} AS d_{s}" for s, d in dev.items())
    name = {s: f"CASE WHEN model_type = 'tts' THEN '{tts}' ELSE '{llm}' END" for s, (llm, tts) in SLOT_NAMES.items()}
    dims = ", ".join(f"{{{{'d': -d_{s}, 'i': {i}, 'f': {name[s]}}}}}" for i, s in enumerate(SLOT_SQL)).replace("{{", "{").replace("}}", "}")
    return ",\n".join([*train_ctes(as_of), f"""_wv AS (
  SELECT model_name, model_type, {bucket('time', 60)} AS bucket, {vec}
  FROM telemetry GROUP BY model_name, model_type, {bucket('time', 60)})""", f"""_wz AS (
  SELECT v.model_name, v.model_type, v.bucket, COALESCE(greatest({z}), 0.0) AS z, {devs}
  FROM _wv v JOIN _abase b USING (model_name))""", f"""_events AS (
  SELECT model_name, bucket + INTERVAL 60 SECOND AS computed_at, {R('-0.05 * (z - 2.0)', 6)} AS anomaly_score,
    z > 3.0 AS is_anomaly, TRUE AS cold_start_mode,
    CASE WHEN d_f0 >= greatest(d_f1, d_f2, d_f3) THEN {name['f0']} WHEN d_f1 >= greatest(d_f2, d_f3) THEN {name['f1']}
         WHEN d_f2 >= d_f3 THEN {name['f2']} ELSE {name['f3']} END AS top_feature,
    array_to_string(list_transform(list_sort([{dims}])[1:3], lambda x: x.f), ', ') AS top_dims,
    {R('d_f0 + d_f1 + d_f2 + d_f3', 2)} AS total_deviation FROM _wz)"""])

PANEL_METRICS = ["latency_p95_ms", "kv_cache_usage_pct", "gpu_util_pct", "requests_waiting",
                 "throughput_rps", "gpu_mem_free_mb", "gpu_temp_celsius"]
LATENCY_METRICS = ["latency_p50_ms", "latency_p95_ms", "latency_p99_ms"]
HEALTH_METRICS = ["latency_p95_ms", "latency_p99_ms", "ttft_p95_ms", "tpot_mean_ms",
                  "throughput_rps", "requests_running", "requests_waiting",
                  "kv_cache_usage_pct", "gpu_util_pct", "gpu_mem_free_mb",
                  "gpu_temp_celsius", "gpu_power_watts", "rtf"]
RCA_METRICS = ["latency_p95_ms", "ttft_p95_ms", "tpot_mean_ms", "kv_cache_usage_pct",
               "requests_waiting", "gpu_util_pct", "gpu_temp_celsius", "gpu_mem_free_mb", "rtf"]
SAT_METRICS = {"requests_waiting": 20.0, "kv_cache_usage_pct": 90.0, "gpu_util_pct": 95.0, "rtf": 1.0}


def bucketed_avg_cte(name: str, metrics, seconds: int, where: str = "TRUE", digits: int = 6) -> str:
    cols = ", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in metrics)
    return f"""{name} AS (
  SELECT model_name, metric, bucket, {R('avg(value)', digits)} AS avg_value, count(*) AS n
  FROM (SELECT model_name, {bucket('time', seconds)} AS bucket, {cols} FROM telemetry WHERE {where})
  UNPIVOT (value FOR metric IN ({", ".join(metrics)}))
  GROUP BY model_name, metric, bucket)"""


# ------------------------------------------------------- health / latest --

def health_sql(as_of: str = AS_OF, window_s: int = 86400, window: str = "24h") -> str:
    aggs = ", ".join(f"{R(f'avg({c})', 4)} AS {c}" for c in HEALTH_METRICS)
    ctes = drift_ctes(as_of) + [events_cte(), f"""_snap AS (
  SELECT model_name, model_type, {aggs} FROM telemetry
  WHERE time >= {minus(as_of, window_s)} AND time <= {ts(as_of)} GROUP BY model_name, model_type)""",
        f"""_evl AS (
  SELECT model_name, arg_max(anomaly_score, computed_at) AS anomaly_score,
    arg_max(is_anomaly, computed_at) AS is_anomaly, arg_max(cold_start_mode, computed_at) AS cold_start_mode
  FROM _events WHERE computed_at <= {ts(as_of)} GROUP BY model_name)""",
        f"""_dr AS (SELECT * FROM _drift_rows WHERE computed_at <= {ts(as_of)} AND severity IS NOT NULL)""",
        """_dnew AS (
  SELECT model_name, severity AS drift_severity FROM (
    SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY computed_at DESC, metric DESC) AS rk FROM _dr)
  WHERE rk = 1)""",
        """_dworst AS (
  SELECT model_name, arg_max(severity, CASE severity WHEN 'none' THEN 0 WHEN 'low' THEN 1
    WHEN 'medium' THEN 2 WHEN 'high' THEN 3 END) AS worst_drift_severity
  FROM (SELECT *, row_number() OVER (PARTITION BY model_name, metric ORDER BY computed_at DESC) AS rk FROM _dr)
  WHERE rk = 1 GROUP BY model_name)"""]
    crit = ("anomaly_score < -0.15 OR kv_cache_usage_pct >= 90.0 OR requests_waiting >= 20.0 "
            "OR gpu_mem_free_mb < 2048.0 OR gpu_temp_celsius >= 87.0 OR drift_severity = 'high'")
    degr = ("anomaly_score < -0.05 OR kv_cache_usage_pct >= 75.0 OR requests_waiting >= 5.0 "
            "OR gpu_mem_free_mb < 4096.0 OR gpu_temp_celsius >= 80.0 OR drift_severity = 'medium'")
    body = f"""SELECT s.model_name, s.model_type,
  CASE WHEN {crit} THEN 'critical' WHEN {degr} THEN 'degraded' ELSE 'healthy' END AS status,
  '{window}' AS time_window, {", ".join("s." + c for c in HEALTH_METRICS)},
  {R('e.anomaly_score', 6)} AS anomaly_score, COALESCE(e.is_anomaly, FALSE) AS is_anomaly,
  COALESCE(e.cold_start_mode, FALSE) AS cold_start_mode, d.drift_severity, w.worst_drift_severity
FROM _snap s LEFT JOIN _evl e USING (model_name) LEFT JOIN _dnew d USING (model_name)
LEFT JOIN _dworst w USING (model_name)"""
    return with_telemetry(*ctes, body=body)


def latest_sql() -> str:
    body = """SELECT t.model_name, t.last_time, t.last_seq, t.latency_p95_ms, t.requests_waiting,
  e.last_event_at, e.anomaly_score, e.is_anomaly
FROM (SELECT model_name, max(time) AS last_time,
        arg_max(seq, (time, seq)) AS last_seq, arg_max(latency_p95_ms, (time, seq)) AS latency_p95_ms,
        arg_max(requests_waiting, (time, seq)) AS requests_waiting FROM telemetry GROUP BY model_name) t
LEFT JOIN (SELECT model_name, max(computed_at) AS last_event_at,
        arg_max(anomaly_score, computed_at) AS anomaly_score, arg_max(is_anomaly, computed_at) AS is_anomaly
      FROM _events GROUP BY model_name) e USING (model_name)"""
    return with_telemetry(events_cte(), body=body)


def liveness_sql() -> str:
    return with_telemetry(body="SELECT model_name, count(*) AS n_rows, max(time) AS last_time FROM telemetry GROUP BY model_name")


def distinct_models_sql() -> str:
    return with_telemetry(body="SELECT model_name, min(model_type) AS model_type FROM telemetry GROUP BY model_name")


# ------------------------------------------------------------- panels -----

def bucket_1m_sql() -> str:
    return with_telemetry(bucketed_avg_cte("_b", PANEL_METRICS, 60), body="SELECT * FROM _b")


def latency_panels_sql() -> str:
    return with_telemetry(bucketed_avg_cte("_b", LATENCY_METRICS, 60), body="SELECT * FROM _b")


def series_cte(as_of: str = AS_OF, metrics=None, name: str = "_series") -> str:
    metrics = list(metrics or SAT_METRICS)
    cols = ", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in metrics)
    return f"""{name} AS (
  SELECT model_name, metric, bucket, avg(value) AS y
  FROM (SELECT model_name, {bucket('time', 900)} AS bucket, {cols} FROM telemetry
        WHERE time >= {minus(as_of, 14 * 86400)} AND time <= {ts(as_of)})
  UNPIVOT (value FOR metric IN ({", ".join(metrics)}))
  GROUP BY model_name, metric, bucket)"""


def bucket_15m_sql() -> str:
    return with_telemetry(series_cte(), body=f"SELECT model_name, metric, bucket, {R('y', 6)} AS avg_value FROM _series")


def panel_legend_sql() -> str:
    return with_telemetry(bucketed_avg_cte("_b", PANEL_METRICS, 60), body=f"""SELECT model_name, metric,
  arg_max(avg_value, bucket) AS last_value, {R('avg(avg_value)', 6)} AS mean_value, max(avg_value) AS max_value
FROM _b GROUP BY model_name, metric""")


def anomaly_panel_sql() -> str:
    return with_telemetry(events_cte(), body=f"""SELECT model_name, {bucket('computed_at', 60)} AS bucket,
  {R('avg(anomaly_score)', 6)} AS avg_score FROM _events GROUP BY ALL""")


def psi_panel_sql() -> str:
    import datetime as dt
    ctes, parts = [], []
    for d in (2, 1, 0):
        a = (dt.datetime.fromisoformat(AS_OF) - dt.timedelta(days=d)).strftime("%Y-%m-%d %H:%M:%S")
        ctes += drift_ctes(a, sfx=f"_{d}")
        parts.append(f"SELECT * FROM _drift_rows_{d}")
    ctes.append("_hist AS (" + " UNION ALL ".join(parts) + ")")
    return with_telemetry(*ctes, body=f"""SELECT concat_ws(' / ', model_name, metric) AS series,
  {bucket('computed_at', 300)} AS bucket, {R('avg(psi)', 6)} AS avg_psi
FROM _hist WHERE psi IS NOT NULL GROUP BY ALL""")


def rtf_panel_sql() -> str:
    return with_telemetry(bucketed_avg_cte("_b", ["rtf"], 60, "model_name IN ('purchase')"),
                          body="SELECT bucket, 'TTS RTF' AS series, avg_value FROM _b")


def gpu_heatmap_sql(as_of: str = AS_OF) -> str:
    return with_telemetry(body=f"""SELECT {bucket('time', 300)} AS bucket, model_name, {R('avg(gpu_util_pct)', 6)} AS avg_value
FROM telemetry WHERE time >= {minus(as_of, 86400)} AND time <= {ts(as_of)} GROUP BY {bucket('time', 300)}, model_name""")


# ------------------------------------------------------------ counters -----

def counter_rate_sql() -> str:
    return with_telemetry(body=f"SELECT model_name, time, seq, request_success_total, {R('throughput_rps', 6)} AS throughput_rps FROM telemetry")


def avg_tokens_sql() -> str:
    return with_telemetry(body=f"""SELECT model_name, time, seq, {R('avg_prompt_tokens', 6)} AS avg_prompt_tokens,
  {R('avg_completion_tokens', 6)} AS avg_completion_tokens FROM telemetry""")


def vram_sql() -> str:
    return with_telemetry(body=f"""SELECT model_name, time, seq,
  {R('gpu_mem_used_mb / (gpu_mem_used_mb + gpu_mem_free_mb) * 100.0', 6)} AS gpu_mem_utilization_pct FROM telemetry""")


# ------------------------------------------------------------- compare -----

def _stats_ctes(as_of: str, metric: str, window_s: int) -> list[str]:
    return [f"""_vals AS (
  SELECT model_name, CAST({metric} AS DOUBLE) AS v FROM telemetry
  WHERE time >= {minus(as_of, window_s)} AND time <= {ts(as_of)} AND {metric} IS NOT NULL AND isfinite(CAST({metric} AS DOUBLE)))""",
            f"""_st AS (
  SELECT model_name, '{metric}' AS metric, count(*) AS n, {R('avg(v)', 4)} AS mean,
    {R('quantile_cont(v, 0.5)', 4)} AS p50, {R('quantile_cont(v, 0.95)', 4)} AS p95,
    {R('quantile_cont(v, 0.99)', 4)} AS p99, avg(v) AS _mean, var_samp(v) AS _var
  FROM _vals GROUP BY model_name)"""]


def compare_stats_sql(as_of: str = AS_OF, metric: str = "latency_p95_ms") -> str:
    return with_telemetry(*_stats_ctes(as_of, metric, 86400),
                          body="SELECT model_name, metric, n, mean, p50, p95, p99 FROM _st")


def compare_welch_sql(as_of: str = AS_OF, metric: str = "latency_p95_ms") -> str:
    ctes = _stats_ctes(as_of, metric, 86400) + [f"""_busy AS (
  SELECT model_name AS model_b FROM (SELECT model_name, count(*) AS n FROM telemetry
    WHERE time >= {minus(as_of, 86400)} AND time <= {ts(as_of)} GROUP BY model_name) ORDER BY n DESC, model_name DESC LIMIT 1)""",
        """_pairs AS (SELECT m.model_name AS model_a, b.model_b FROM (SELECT DISTINCT model_name FROM telemetry) m, _busy b
  WHERE m.model_name <> b.model_b)""",
        """_w AS (
  SELECT p.model_a, p.model_b, COALESCE(a.metric, b.metric) AS metric,
    COALESCE(a.n, 0) AS n_a, COALESCE(b.n, 0) AS n_b, a.mean AS mean_a, b.mean AS mean_b,
    a._var / a.n AS sa, b._var / b.n AS sb, a._mean AS ma, b._mean AS mb,
    COALESCE(a.n, 0) >= 2 AND COALESCE(b.n, 0) >= 2 AS both_ok, a.n AS na, b.n AS nb
  FROM _pairs p LEFT JOIN _st a ON a.model_name = p.model_a LEFT JOIN _st b ON b.model_name = p.model_b)"""]
    t = "(ma - mb) / sqrt(sa + sb)"
    dfx = "((sa + sb) * (sa + sb)) / (sa * sa / (na - 1) + sb * sb / (nb - 1))"
    body = f"""SELECT model_a, model_b, metric, n_a, n_b, mean_a, mean_b,
  CASE WHEN both_ok THEN {R(t, 6)} END AS t_statistic, CASE WHEN both_ok THEN {R(dfx, 4)} END AS welch_df,
  CASE WHEN mean_a IS NOT NULL AND mean_b IS NOT NULL AND mean_b <> 0
       THEN {R('(mean_a - mean_b) / mean_b * 100.0', 2)} END AS difference_pct
FROM _w"""
    return with_telemetry(*ctes, body=body)


def compare_models_sql(as_of: str = AS_OF, metric: str = "latency_p95_ms") -> str:
    """p by Simpson's rule over the Student density, 4,000 steps."""
    inner = compare_welch_sql(as_of, metric)
    head = inner.rsplit("SELECT model_a, model_b, metric", 1)[0]
    t, dfx = "(ma - mb) / sqrt(sa + sb)", "((sa + sb) * (sa + sb)) / (sa * sa / (na - 1) + sb * sb / (nb - 1))"
    q = ", ".join(f"{s}.{c} AS {c}_{s}" for s in "ab" for c in ("p50", "p95", "p99"))
    return head.rstrip() + f""",
_wx AS (SELECT *, {t} AS t, {dfx} AS df FROM _w),
_dens AS (SELECT model_a, t, df, exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) AS c,
  sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
      * pow(1 + (i * abs(t) / 4000) * (i * abs(t) / 4000) / df, -(df + 1) / 2)) AS area
  FROM _wx, (SELECT unnest(range(0, 4001)) AS i) WHERE both_ok AND sa + sb > 0 GROUP BY model_a, t, df),
_pv AS (SELECT model_a, {R('1 - 2 * c * area * abs(t) / 12000', 6)} AS p FROM _dens),
_full AS (SELECT w.*, v.p, {q}, CASE WHEN mean_a IS NOT NULL AND mean_b IS NOT NULL AND mean_b <> 0
    THEN {R('(mean_a - mean_b) / mean_b * 100.0', 2)} END AS diff
  FROM _wx w LEFT JOIN _pv v USING (model_a) LEFT JOIN _st a ON a.model_name = w.model_a LEFT JOIN _st b ON b.model_name = w.model_b)
SELECT model_a, model_b, metric, CASE WHEN n_a = 0 AND n_b = 0 THEN 'no_data' ELSE 'ok' END AS status, n_a, n_b, mean_a, mean_b,
  p50_a, p95_a, p99_a, p50_b, p95_b, p99_b, diff AS difference_pct, CASE WHEN both_ok THEN {R('t', 6)} END AS t_statistic,
  p AS p_value, COALESCE(p < 0.05, FALSE) AS statistically_significant,
  CASE WHEN diff IS NOT NULL THEN printf('mean %s: %s is %.1f%% %s than %s, p %s 0.05', '{metric}', model_a, {R('abs(diff)', 1)},
      CASE WHEN diff > 0 THEN 'higher' ELSE 'lower' END, model_b, CASE WHEN COALESCE(p < 0.05, FALSE) THEN 'under' ELSE 'not under' END)
    ELSE printf('%s has too few values of %s or %s', '{metric}', model_a, model_b) END AS summary
FROM _full"""


# ---------------------------------------------------------- root cause -----

RULE_CONDITIONS = {"R1": (2, 2), "R2": (2, 2), "R3": (2, 2), "R4": (2, 2),
                   "R5": (1, 1), "R6": (1, 1), "R7": (1, 1), "R8": (1, 2)}


def rule_inputs_sql(src: str) -> str:
    """Columns kv..dims from a relation with snapshot averages, baselines
    (b_lat0, b_ttft0, b_tpot0), ev_score, ev_dev, ev_dims, model_type."""
    c = lambda x, d="0.0": f"COALESCE(CAST({x} AS DOUBLE), {d})"
    return f"""SELECT *, {c('kv_cache_usage_pct')} AS kv, {c('requests_waiting')} AS rw, {c('latency_p95_ms')} AS lat,
  {c('gpu_util_pct')} AS gpu, {c('gpu_temp_celsius')} AS temp, {c('gpu_mem_free_mb', '99999.0')} AS free,
  {c('ttft_p95_ms')} AS ttft, {c('tpot_mean_ms')} AS tpot, {c('rtf')} AS rtf_v, {c('ev_score')} AS score,
  COALESCE(b_lat0, CASE WHEN {c('latency_p95_ms')} <> 0 THEN {c('latency_p95_ms')} ELSE 1.0 END) AS b_lat,
  COALESCE(b_ttft0, CASE WHEN {c('ttft_p95_ms')} <> 0 THEN {c('ttft_p95_ms')} ELSE 1.0 END) AS b_ttft,
  COALESCE(b_tpot0, CASE WHEN {c('tpot_mean_ms')} <> 0 THEN {c('tpot_mean_ms')} ELSE 1.0 END) AS b_tpot,
  COALESCE(ev_dev, 0.0) AS dev, COALESCE(ev_dims, '') AS dims
FROM {src}"""


def rules_select_sql() -> str:
    tdev = "(abs(tpot - b_tpot) / greatest(b_tpot, 1e-06))"
    conds = {
        "R1": "kv > 90.0 AND rw > 5.0",
        "R2": "lat > 2.0 * b_lat AND gpu < 30.0",
        "R3": "rw > 20.0 AND gpu > 90.0",
        "R4": f"ttft > 2.0 * b_ttft AND {tdev} < 0.2",
        "R5": "temp > 85.0",
        "R6": "free < 2048.0",
        "R7": "model_type = 'tts' AND rtf_v > 1.0",
        "R8": "score < -0.15",
    }
    r1 = lambda x: R(x, 1)
    ev = {
        "R1": f"concat_ws(' | ', printf('cache fill %.1f%%, limit 90%%', {r1('kv')}), "
              f"printf('queue length %d, limit 5', CAST(trunc(rw) AS BIGINT)))",
        "R2": f"concat_ws(' | ', printf('p95 latency %.1f ms, usual %.1f ms, factor %.1f', {r1('lat')}, "
              f"{r1('b_lat')}, {r1('lat / greatest(b_lat, 1.0)')}), "
              f"printf('GPU load %.1f%%, under 30%%', {r1('gpu')}))",
        "R3": f"concat_ws(' | ', printf('queue length %d, limit 20', CAST(trunc(rw) AS BIGINT)), "
              f"printf('GPU load %.1f%%, over 90%%', {r1('gpu')}))",
        "R4": f"concat_ws(' | ', printf('first-token p95 %.1f ms, usual %.1f ms, factor %.1f', {r1('ttft')}, "
              f"{r1('b_ttft')}, {r1('ttft / greatest(b_ttft, 1.0)')}), "
              f"printf('per-token time %.1f ms, %.1f%% off its usual value', {r1('tpot')}, {r1(tdev + ' * 100.0')}))",
        "R5": f"printf('GPU at %.1f C, limit 85 C', {r1('temp')})",
        "R6": f"printf('%.0f MB of GPU memory left, limit 2048 MB', {R('free', 0)})",
        "R7": f"printf('real-time factor %.3f, limit 1', {R('rtf_v', 3)})",
        "R8": f"concat_ws(' | ', printf('detector score %.4f, limit -0.15', "
              f"{R('score', 4)}), 'furthest off: ' || dims)",
    }
    rid = "CASE " + " ".join(f"WHEN {c} THEN '{k}'" for k, c in conds.items()) + " END"
    cause = "CASE " + " ".join(f"WHEN {c} THEN '{ROOT_CAUSES[k]}'" for k, c in conds.items()) + " END"
    conf = "CASE " + " ".join(
        f"WHEN {c} THEN {R(f'least(greatest({0.6 * (RULE_CONDITIONS[k][0] / RULE_CONDITIONS[k][1])!r} + 0.4 * least(dev / 100.0, 1.0), 0.0), 1.0)', 4)}"
        for k, c in conds.items()) + " ELSE 0.0 END"
    evid = "CASE " + " ".join(f"WHEN {c} THEN {ev[k]}" for k, c in conds.items()) + " ELSE '' END"
    return (f"COALESCE({rid}, 'R0') AS rule_id, ({rid}) IS NOT NULL AS anomaly_detected, "
            f"{cause} AS root_cause, {conf} AS confidence, {evid} AS evidence")


def root_cause_rows_sql() -> str:
    ctes = [events_cte(), """_mm AS (SELECT model_name, avg(latency_p95_ms) AS b_lat0, avg(ttft_p95_ms) AS b_ttft0,
  avg(tpot_mean_ms) AS b_tpot0 FROM telemetry GROUP BY model_name)""",
            f"""_rin AS (SELECT t.*, m.b_lat0, m.b_ttft0, m.b_tpot0, e.anomaly_score AS ev_score,
  e.total_deviation AS ev_dev, e.top_dims AS ev_dims
  FROM telemetry t LEFT JOIN _mm m USING (model_name)
  ASOF LEFT JOIN _events e ON e.model_name = t.model_name AND t.time >= e.computed_at)""",
            f"_ri AS ({rule_inputs_sql('_rin')})"]
    return with_telemetry(*ctes, body=f"SELECT model_name, time, seq, {rules_select_sql()} FROM _ri")


def root_cause_latest_sql(as_of: str = AS_OF, lookback_minutes: int = 1440) -> str:
    lo = minus(as_of, lookback_minutes * 60)
    avgs = ", ".join(f"avg({c}) AS {c}" for c in RCA_METRICS)
    ctes = [events_cte(), f"""_evr AS (SELECT model_name, max(computed_at) AS computed_at,
  arg_max(anomaly_score, computed_at) AS ev_score, arg_max(is_anomaly, computed_at) AS is_anomaly,
  arg_max(cold_start_mode, computed_at) AS cold_start_mode, arg_max(total_deviation, computed_at) AS ev_dev,
  arg_max(top_dims, computed_at) AS ev_dims
  FROM _events WHERE computed_at >= {lo} AND computed_at <= {ts(as_of)} GROUP BY model_name)""",
            f"""_snap AS (SELECT model_name, {avgs} FROM telemetry
  WHERE time >= {lo} AND time <= {ts(as_of)} GROUP BY model_name)""",
            "_types AS (SELECT model_name, min(model_type) AS model_type FROM telemetry GROUP BY model_name)",
            f"""_usual AS (SELECT model_name, avg(latency_p95_ms) AS b_lat0, avg(ttft_p95_ms) AS b_ttft0,
  avg(tpot_mean_ms) AS b_tpot0 FROM telemetry
  WHERE time >= {minus(as_of, 7 * 86400)} AND time < {ts(as_of)} GROUP BY model_name)""",
            """_rin AS (SELECT ty.model_name, COALESCE(ty.model_type, 'llm') AS model_type, e.* EXCLUDE (model_name),
  s.* EXCLUDE (model_name), u.b_lat0, u.b_ttft0, u.b_tpot0
  FROM _types ty LEFT JOIN _evr e USING (model_name) LEFT JOIN _snap s USING (model_name)
  LEFT JOIN _usual u USING (model_name))""",
            f"_ri AS ({rule_inputs_sql('_rin')})",
            f"_diag AS (SELECT *, {rules_select_sql()} FROM _ri)"]
    rule = "CASE WHEN computed_at IS NULL THEN 'R0' ELSE rule_id END"
    action = f"CASE {rule} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RULE_ACTIONS.items()) + " END"
    body = f"""SELECT model_name, model_type, CASE WHEN computed_at IS NULL THEN 'no_anomaly' ELSE 'ok' END AS status,
  CAST({lookback_minutes} AS INT) AS lookback_minutes,
  {R('ev_score', 6)} AS anomaly_score, is_anomaly, cold_start_mode,
  computed_at IS NOT NULL AND anomaly_detected AS anomaly_detected, {rule} AS rule_id,
  CASE WHEN computed_at IS NOT NULL THEN root_cause END AS root_cause,
  CASE WHEN computed_at IS NOT NULL THEN confidence ELSE 0.0 END AS confidence,
  CASE WHEN computed_at IS NOT NULL THEN evidence ELSE '' END AS evidence, {action} AS recommendation,
  {", ".join(f"{R(c, 4)} AS {c}" for c in RCA_METRICS)}, computed_at FROM _diag"""
    return with_telemetry(*ctes, body=body)


# -------------------------------------------------------------- alerts -----

def threshold_ctes(as_of: str = AS_OF) -> list[str]:
    checks = [
        ("latency_p95_ms", "lat", ">", "2.0 * bl", "3.0 * bl"),
        ("requests_waiting", "rw", ">", "5.0", "20.0"),
        ("kv_cache_usage_pct", "kv", ">", "75.0", "90.0"),
        ("gpu_mem_free_mb", "free", "<", "4096.0", "2048.0"),
        ("gpu_temp_celsius", "temp", ">", "80.0", "87.0"),
        ("rtf", "rtf_t", ">", "0.8", "1.0"),
    ]
    parts = []
    for metric, v, op, w, c in checks:
        parts.append(f"""SELECT model_name, bucket, '{metric}' AS metric, {v} AS value,
    CASE WHEN {v} {op} {c} THEN 'critical' WHEN {v} {op} {w} THEN 'warning' END AS severity,
    CASE WHEN {v} {op} {c} THEN {c} ELSE {w} END AS threshold, '{op}' AS op FROM _tb""")
    return [
        f"""_mb AS (SELECT model_name, {bucket('time', 60)} AS bucket, sum(CAST(latency_p95_ms AS DECIMAL(38, 9))) AS s,
    count(latency_p95_ms) AS n FROM telemetry WHERE time < {ts(as_of)} GROUP BY ALL)""",
        """_bl AS (SELECT model_name, bucket, CAST(sum(s) OVER w AS DOUBLE) / nullif(sum(n) OVER w, 0) AS bl FROM _mb
  WINDOW w AS (PARTITION BY model_name ORDER BY bucket RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING))""",
        f"""_tb AS (SELECT b.*, l.bl FROM (
  SELECT model_name, model_type, {bucket('time', 60)} AS bucket, avg(latency_p95_ms) AS lat,
    avg(requests_waiting) AS rw, avg(kv_cache_usage_pct) AS kv, avg(gpu_mem_free_mb) AS free,
    avg(gpu_temp_celsius) AS temp, avg(CASE WHEN model_type = 'tts' THEN rtf END) AS rtf_t
  FROM telemetry WHERE time < {ts(as_of)} GROUP BY ALL) b LEFT JOIN _bl l USING (model_name, bucket))""",
        "_checks AS (" + "\n  UNION ALL ".join(parts) + ")",
        f"""_thr AS (SELECT 'threshold' AS source, 'threshold' AS alert_type, model_name,
  printf('%s %s %.4f', metric, op, {R('threshold', 4)}) AS title,
  printf('%s averaged %.4f', metric, {R('value', 4)}) AS description, severity, bucket AS fired_at,
  FALSE AS resolved, CAST(NULL AS DOUBLE) AS anomaly_score
  FROM _checks WHERE severity IS NOT NULL)""",
    ]


DRIFT_ALERTS_CTE = """_dal AS (SELECT 'drift' AS source, 'drift' AS alert_type, model_name,
  'Drift detected: ' || metric AS title, printf('PSI %.6f, KS p-value %.6f', psi, ks_p_value) AS description,
  CASE WHEN psi > 0.25 THEN 'high' ELSE 'medium' END AS severity, computed_at AS fired_at,
  FALSE AS resolved, CAST(NULL AS DOUBLE) AS anomaly_score FROM _drift_rows WHERE psi > 0.2)"""

DETECTOR_CTE = f"""_det AS (SELECT 'anomaly_detector' AS source, 'anomaly' AS alert_type, model_name,
  'Unusual ' || COALESCE(top_feature, 'unknown') AS title,
  printf('detector score %.4f', {R('anomaly_score', 4)}) AS description,
  CASE WHEN anomaly_score <= -0.15 THEN 'critical' WHEN anomaly_score <= -0.05 THEN 'warning' ELSE 'info' END AS severity,
  computed_at AS fired_at, FALSE AS resolved, anomaly_score FROM _events WHERE is_anomaly)"""


def external_cte(as_of: str = AS_OF) -> str:
    return f"""_ext AS (SELECT 'alertmanager' AS source, 'external' AS alert_type, model_name,
  CASE WHEN hour(hr) % 2 = 1 THEN 'GpuTemperatureHigh' ELSE 'GPU temperature high' END AS title,
  printf('peak %.1f C', peak) AS description,
  CASE WHEN model_name = 'error' THEN 'critical' ELSE 'warning' END AS severity,
  hr AS fired_at, hr < {minus(as_of, 86400)} AS resolved, CAST(NULL AS DOUBLE) AS anomaly_score
  FROM (SELECT model_name, date_trunc('hour', time) AS hr, max(gpu_temp_celsius) AS peak FROM telemetry
        GROUP BY ALL HAVING max(gpu_temp_celsius) >= 90))"""


ALERT_COLS = "source, alert_type, model_name, title, description, severity, fired_at, resolved"


def threshold_alerts_sql() -> str:
    return with_telemetry(*threshold_ctes(),
                          body="SELECT source, alert_type, model_name, title, description, severity, fired_at FROM _thr")


def drift_alerts_sql() -> str:
    return with_telemetry(*drift_ctes(AS_OF, cmp="1d"), DRIFT_ALERTS_CTE,
                          body="SELECT source, alert_type, model_name, title, description, severity, fired_at FROM _dal")


def external_alerts_sql() -> str:
    return with_telemetry(external_cte(), body=f"SELECT {ALERT_COLS} FROM _ext")


def feed_ctes(severity: str | None = None, include_resolved: bool = False, limit: int = 20) -> list[str]:
    sev = f" AND severity = '{severity}'" if severity else ""
    res = "" if include_resolved else " AND NOT resolved"
    order = "fired_at DESC, model_name, title, alert_type"
    once = ("row_number() OVER (PARTITION BY model_name, title, fired_at"
            " ORDER BY alert_type, source, description, severity, resolved, anomaly_score)")
    return drift_ctes(AS_OF) + threshold_ctes() + [
        events_cte(), DRIFT_ALERTS_CTE, DETECTOR_CTE, external_cte(),
        f"""_stored AS (SELECT * FROM _det UNION ALL SELECT * FROM _thr UNION ALL SELECT * FROM _dal)""",
        f"""_stop AS (SELECT *, 0 AS _src FROM _stored WHERE TRUE{sev} QUALIFY {once} = 1 ORDER BY {order} LIMIT {limit})""",
        f"""_xtop AS (SELECT *, 1 AS _src FROM _ext WHERE TRUE{sev}{res} QUALIFY {once} = 1 ORDER BY {order} LIMIT {limit})""",
        """_dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_name, title, fired_at
    ORDER BY _src, alert_type, source, description, severity, resolved, anomaly_score) AS _rk
    FROM (SELECT * FROM _stop UNION ALL SELECT * FROM _xtop)) WHERE _rk = 1)""",
        f"""_feed AS (SELECT * FROM _dd ORDER BY _src, {order} LIMIT {limit})""",
    ]


def alert_feed_sql(**kw) -> str:
    return with_telemetry(*feed_ctes(**kw), body=f"SELECT {ALERT_COLS} FROM _feed")


def alert_totals_sql() -> str:
    return with_telemetry(*feed_ctes(), body="""SELECT CAST(count_if(NOT resolved) AS BIGINT) AS total_active,
  CAST(count_if(severity = 'critical' AND NOT resolved) AS BIGINT) AS total_critical FROM _feed""")


def alert_durations_sql(as_of: str = AS_OF) -> str:
    body = f"""SELECT model_name, title, severity, fired_at, resolved_at,
  CASE WHEN resolved_at IS NOT NULL THEN CAST(floor((epoch_us(resolved_at) - epoch_us(fired_at)) / 60000000) AS BIGINT) END AS duration_minutes
FROM (SELECT model_name, title, severity, fired_at, CASE WHEN resolved THEN fired_at + INTERVAL 1 HOUR END AS resolved_at FROM _ext)
WHERE resolved_at IS NULL OR resolved_at >= {minus(as_of, 48 * 3600)}"""
    return with_telemetry(external_cte(), body=body)


# ------------------------------------------------------------ forecast -----

def fit_ctes(as_of: str = AS_OF, metrics=None, horizon_hours: int = 6) -> list[str]:
    thr = "CAST(CASE metric " + " ".join(f"WHEN '{m}' THEN {t!r}" for m, t in SAT_METRICS.items()) + " END AS DOUBLE)"
    return [series_cte(as_of, metrics), """_idx AS (SELECT *, CAST(row_number() OVER _w - 1 AS DOUBLE) AS x,
  CAST(epoch_us(bucket) - epoch_us(lag(bucket) OVER _w) AS DOUBLE) AS gap FROM _series
  WINDOW _w AS (PARTITION BY model_name, metric ORDER BY bucket))""",
            """_fit0 AS (SELECT model_name, metric, count(*) AS n, regr_slope(y, x) AS sl, regr_intercept(y, x) AS ic,
  stddev_pop(y) AS sd, avg(y) AS mean_y, arg_max(y, bucket) AS last_y, quantile_cont(gap, 0.5) AS med,
  max(bucket) AS last_bucket FROM _idx GROUP BY model_name, metric)""",
            """_fit AS (SELECT model_name, metric, n, last_bucket,
  CASE WHEN n < 2 THEN 0.0 ELSE COALESCE(sl, 0.0) END AS slope,
  CASE WHEN n < 2 THEN last_y ELSE COALESCE(ic, mean_y) END AS intercept,
  CASE WHEN n < 2 THEN 0.0 ELSE sd END AS std,
  CASE WHEN n < 2 OR med IS NULL OR med = 0 THEN 900000000.0 ELSE med END AS step_us FROM _fit0)""",
            f"""_pts AS (SELECT model_name, metric, CAST(r.step AS INT) AS step,
  last_bucket + to_microseconds(CAST(trunc(r.step * step_us) AS BIGINT)) AS ds,
  slope * (n - 1 + r.step) + intercept AS yhat,
  slope * (n - 1 + r.step) + intercept - 2.0 * std AS yhat_lower,
  slope * (n - 1 + r.step) + intercept + 2.0 * std AS yhat_upper, {thr} AS threshold
  FROM _fit CROSS JOIN (SELECT range AS step FROM range(1, {horizon_hours * 4 + 1})) r)"""]


def forecast_linear_sql() -> str:
    return with_telemetry(*fit_ctes(), body=f"""SELECT model_name, metric, step, ds, {R('yhat', 4)} AS yhat,
  {R('yhat_lower', 4)} AS yhat_lower, {R('yhat_upper', 4)} AS yhat_upper FROM _pts""")


def saturation_sql(as_of: str = AS_OF, requested_hours: int = 2) -> str:
    hours = f"((epoch_us(s.saturation_time) - epoch_us({ts(as_of)})) / 3600000000.0)"
    body = f"""SELECT {ts(as_of)} AS computed_at, f.model_name, f.metric, CAST(6 AS INT) AS horizon_hours,
  t.threshold AS saturation_threshold, s.saturation_time,
  CASE WHEN {hours} IS NULL THEN 'low' WHEN {hours} <= 1.0 THEN 'critical' WHEN {hours} <= 3.0 THEN 'high'
       WHEN {hours} <= 6.0 THEN 'medium' ELSE 'low' END AS saturation_risk,
  CAST(f.n AS INT) AS n_training_points, TRUE AS cold_start_mode,
  {hours} <= {requested_hours} AS saturation_within_horizon
FROM _fit f
LEFT JOIN (SELECT DISTINCT model_name, metric, threshold FROM _pts) t USING (model_name, metric)
LEFT JOIN (SELECT model_name, metric, min(ds) AS saturation_time FROM _pts WHERE yhat_upper >= threshold
           GROUP BY model_name, metric) s USING (model_name, metric)"""
    return with_telemetry(*fit_ctes(as_of), body=body)


def forecast_cached_sql() -> str:
    old = "('gpu_util_pct', 'requests_waiting')"
    return (f"SELECT * FROM ({saturation_sql('2024-01-30 23:40:00')}) WHERE metric IN {old} UNION ALL "
            f"SELECT * FROM ({saturation_sql()}) WHERE metric NOT IN {old}")


def queue_overlay_sql() -> str:
    body = f"""SELECT model_name, bucket AS ts, {R('y', 4)} AS value, 'history' AS kind FROM _series
UNION ALL
SELECT model_name, ds AS ts, {R('yhat', 4)} AS value, 'forecast' AS kind FROM _pts WHERE step <= 8"""
    return with_telemetry(*fit_ctes(metrics=["requests_waiting"]), body=body)


# --------------------------------------------------------- maintenance -----

def upsert_sql() -> str:
    body = f"""SELECT model_name, computed_at, latency_p95_ms, n FROM (
  SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY computed_at DESC) AS rk FROM (
    SELECT model_name, date_trunc('day', time) + INTERVAL 1 DAY AS computed_at,
      {R('avg(latency_p95_ms)', 4)} AS latency_p95_ms, count(*) AS n
    FROM telemetry GROUP BY model_name, date_trunc('day', time)))
WHERE rk = 1"""
    return with_telemetry(body=body)


def table_maintenance_sql() -> str:
    body = f"""SELECT model_name, CASE WHEN late THEN day + INTERVAL 25 HOUR ELSE day + INTERVAL 1 DAY END AS computed_at, latency_p95_ms,
  CASE WHEN late THEN n + 1000 ELSE n END AS n, strftime(day, '%Y-%m-%d') AS day FROM (
    SELECT model_name, date_trunc('day', time) AS day, {R('avg(latency_p95_ms)', 4)} AS latency_p95_ms, count(*) AS n,
      date_trunc('day', time) >= TIMESTAMP '2024-01-28 00:00:00' AS late
    FROM telemetry GROUP BY model_name, date_trunc('day', time)) WHERE day >= TIMESTAMP '2024-01-11 00:00:00'"""
    return with_telemetry(body=body)


def retention_sql(as_of: str = AS_OF, days: int = 20) -> str:
    return with_telemetry(body=f"""SELECT model_name, count(*) AS n_kept, min(time) AS oldest_kept
FROM telemetry WHERE time >= {minus(as_of, days * 86400)} GROUP BY model_name""")


def stale_keys_sql(as_of: str = AS_OF, fresh_minutes: int = 6) -> str:
    cols = [DRIFT_METRICS[m] for m in DRIFT_METRICS]
    back = "CASE col " + " ".join(f"WHEN '{c}' THEN '{m}'" for m, c in DRIFT_METRICS.items()) + " END"
    ctes = [f"""_keys AS (SELECT model_name, unnest([{", ".join(repr(m) for m in DRIFT_METRICS)}]) AS metric
  FROM (SELECT DISTINCT model_name FROM telemetry))""",
            bucketed_avg_cte("_sb", cols, 60),
            f"""_fresh AS (SELECT DISTINCT model_name, {back.replace('col', 'metric', 1)} AS metric FROM _sb
  WHERE bucket + INTERVAL 60 SECOND >= {minus(as_of, fresh_minutes * 60)})"""]
    return with_telemetry(*ctes, body="""SELECT k.model_name, k.metric FROM _keys k
WHERE NOT EXISTS (SELECT 1 FROM _fresh f WHERE f.model_name = k.model_name AND f.metric = k.metric)""")


# ------------------------------------------------------------- anomaly -----

SLOT_SQL = {
    "f0": "latency_p95_ms", "f1": "gpu_util_pct",
    "f2": "CASE WHEN model_type = 'tts' THEN rtf ELSE kv_cache_usage_pct END",
    "f3": "CAST(requests_waiting AS DOUBLE)",
}
SLOT_NAMES = {"f0": ("latency_p95_ms", "latency_p95_ms"), "f1": ("gpu_util_pct", "gpu_util_pct"),
              "f2": ("kv_cache_usage_pct", "rtf"), "f3": ("requests_waiting", "requests_waiting")}


def train_ctes(as_of: str = AS_OF, days: int = 7) -> list[str]:
    cols = ", ".join(f"COALESCE(CAST({e} AS DOUBLE), 0.0) AS {s}" for s, e in SLOT_SQL.items())
    aggs = ", ".join(f"avg({s}) AS mean_{s}, stddev_pop({s}) AS std_{s}" for s in SLOT_SQL)
    return [f"""_train AS (SELECT model_name, model_type, {cols} FROM telemetry
  WHERE time >= {minus(as_of, days * 86400)} AND time <= {ts(as_of)})""",
            f"""_abase AS (SELECT model_name, count(*) AS n, min(model_type) AS model_type, {aggs}
  FROM _train GROUP BY model_name)"""]


def anomaly_baselines_sql() -> str:
    cols = ", ".join(f"{R(f'mean_{s}', 6)} AS mean_{s}" for s in SLOT_SQL) + ", " + \
        ", ".join(f"{R(f'std_{s}', 6)} AS std_{s}" for s in SLOT_SQL)
    return with_telemetry(*train_ctes(), body=f"SELECT model_name, model_type, n AS n_training_samples, {cols} FROM _abase")


def train_quarantine_sql() -> str:
    return with_telemetry(*train_ctes(), body="""SELECT model_name, CASE WHEN model_name = 'error' THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN model_name <> 'error' THEN CAST(n AS BIGINT) END AS n_training_samples FROM _abase WHERE n >= 10""")


def contributing_dims_sql() -> str:
    vec_cols = ", ".join(f"avg({e}) AS {s}" for s, e in SLOT_SQL.items())
    parts = []
    for i, s in enumerate(SLOT_SQL):
        llm, tts = SLOT_NAMES[s]
        base = f"b.bm_{s}"
        val = f"COALESCE(v.{s}, 0.0)"
        dev = f"CASE WHEN {base} <> 0 THEN abs(({val} - {base}) / {base}) * 100.0 ELSE abs({val}) * 100.0 END"
        parts.append(f"""SELECT v.model_name, v.bucket, {i} AS slot,
    CASE WHEN v.model_type = 'tts' THEN '{tts}' ELSE '{llm}' END AS feature,
    {R(val, 4)} AS value, {R(base, 4)} AS baseline, {R(dev, 2)} AS deviation_pct
  FROM _vec v JOIN _bm b USING (model_name)""")
    ctes = train_ctes() + [
        f"""_vec AS (SELECT model_name, model_type, {bucket('time', 60)} AS bucket, {vec_cols}
  FROM telemetry GROUP BY model_name, model_type, {bucket('time', 60)})""",
        "_bm AS (SELECT model_name, " + ", ".join(f"{R(f'mean_{s}', 6)} AS bm_{s}" for s in SLOT_SQL) + " FROM _abase)",
        "_dims AS (" + "\n  UNION ALL ".join(parts) + ")"]
    body = """SELECT model_name, bucket, CAST(row_number() OVER (PARTITION BY model_name, bucket
    ORDER BY deviation_pct DESC, slot) AS INT) AS rank, feature, value, baseline, deviation_pct FROM _dims"""
    return with_telemetry(*ctes, body=body)


# ----------------------------------------------------------- ingestion -----

def _p6(x: str) -> str:
    """value after a round trip through the '%.6f' text rendering"""
    return f"CAST(printf('%.6f', {x}) AS DOUBLE)"


_CAP = """_cap AS (SELECT event_id, ts, user_id, event_type, value,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, event_id * 3 AS ctr FROM events)"""
_TPOT = "((20.0 + CAST(k AS DOUBLE) / 10.0) / 1000.0)"
_CNT = "CAST(user_id + 1 AS DOUBLE)"


def exposition_samples_sql() -> str:
    m = "event_type"
    rows = [
        (2, "'vllm:e2e_request_latency_seconds'", "'0.5'", "NULL", _p6("value * 5.0 / 1000.0"), "TRUE"),
        (3, "'vllm:e2e_request_latency_seconds'", "'0.95'", "NULL", _p6("value * 10.0 / 1000.0"), "TRUE"),
        (4, "'vllm:e2e_request_latency_seconds'", "'0.99'", "NULL", _p6("value * 14.0 / 1000.0"), "TRUE"),
        (5, "'vllm:time_to_first_token_seconds'", "'0.5'", "NULL", _p6("value * 2.0 / 1000.0"), "TRUE"),
        (6, "'vllm:time_to_first_token_seconds'", "'0.95'", "NULL", _p6("value * 4.0 / 1000.0"), "k % 10 <> 0"),
        (7, "'vllm:time_per_output_token_seconds_sum'", "NULL", "NULL", _p6(f"{_TPOT} * (user_id + 1)"), "TRUE"),
        (8, "'vllm:time_per_output_token_seconds_count'", "NULL", "NULL", _CNT, "TRUE"),
        (9, "'vllm:num_requests_running'", "NULL", "'v1, \"fast\" {x}'", "CAST(user_id % 12 AS DOUBLE)", "TRUE"),
        (10, "'vllm:num_requests_waiting'", "NULL", "NULL", "CAST(user_id % 30 AS DOUBLE)", "TRUE"),
        (11, "'vllm:gpu_cache_usage_perc'", "NULL", "NULL",
         _p6("CASE WHEN k % 2 = 0 THEN CAST(k AS DOUBLE) / 100.0 ELSE CAST(k AS DOUBLE) END"), "TRUE"),
        (12, "'vllm:request_success_total'", "NULL", "NULL", "CAST(ctr AS DOUBLE)", "TRUE"),
        (13, "'vllm:request_prompt_tokens_total'", "NULL", "NULL", "CAST(ctr * (50 + k) AS DOUBLE)", "TRUE"),
        (14, "'vllm:request_generation_tokens_total'", "NULL", "NULL", "CAST(ctr * (20 + k) AS DOUBLE)", "TRUE"),
    ]
    parts = []
    for idx, name, q, eng, val, cond in rows:
        ordinal = f"CAST({idx} - CASE WHEN k % 10 = 0 AND {idx} > 6 THEN 1 ELSE 0 END AS INT)"
        parts.append(f"""SELECT event_id AS scrape_id, {ordinal} AS ordinal, {name} AS name, {m} AS model_label,
    CAST({q} AS VARCHAR) AS quantile_label, CAST({eng} AS VARCHAR) AS engine_label, {val} AS value
  FROM _cap WHERE {cond}""")
    return "WITH " + _CAP + "\n" + "\nUNION ALL\n".join(parts)


GPU_BASE = {
    "gpu_util_pct": "CAST((event_id * 37) % 101 AS DOUBLE)",
    "gpu_mem_used_mb": "(40000.0 - CAST((event_id * 7919) % 40000 AS DOUBLE))",
    "gpu_mem_free_mb": "(1024.0 + CAST((event_id * 7919) % 40000 AS DOUBLE))",
    "gpu_temp_celsius": "(60.0 + CAST((event_id * 13) % 31 AS DOUBLE))",
    "gpu_power_watts": "(200.0 + CAST((event_id * 17) % 200 AS DOUBLE))",
}
# model -> offset of the first host whose label contains its node selector
GPU_MATCH = {"click": 0, "error": 3, "purchase": 4, "signup": 0}


def _gpu_cte() -> str:
    parts = []
    for model, off in GPU_MATCH.items():
        cols = ", ".join(f"{R(_p6(f'{e} + {float(off)!r}'), 6)} AS {c}" for c, e in GPU_BASE.items())
        parts.append(f"SELECT event_id AS tick_id, '{model}' AS model_name, {cols} FROM _cap")
    return "_gpu AS (" + " UNION ALL ".join(parts) + ")"


def gpu_node_match_sql() -> str:
    return "WITH " + _CAP + ",\n" + _gpu_cte() + "\nSELECT * FROM _gpu"


def _pods_cte() -> str:
    own_cpu = ("(CAST(event_id % 4000 AS DOUBLE) + CAST((event_id * 7) % 1000000 AS DOUBLE) / 1000.0"
               " + CAST((event_id * 1000003) % 4000000000 AS DOUBLE) / 1000000.0 + CAST(event_id % 2 AS DOUBLE) * 1000.0)")
    own_mem = ("(CAST(512 + event_id % 512 AS DOUBLE) * 1048576.0 + CAST(event_id % 3 + 1 AS DOUBLE) * 1073741824.0"
               " + CAST(1048576 + event_id % 1048576 AS DOUBLE) * 1024.0 + CAST(134217728 + event_id AS DOUBLE))")
    ui_cpu = "CAST(event_id % 50 AS DOUBLE)"
    ui_mem = "(CAST(64 + event_id % 64 AS DOUBLE) * 1048576.0)"
    return f"""_pods AS (
  SELECT event_id AS tick_id, event_type AS model_name,
    {own_cpu} + CASE WHEN event_type = 'view' THEN {ui_cpu} ELSE 0.0 END AS cpu,
    ({own_mem} + CASE WHEN event_type = 'view' THEN {ui_mem} ELSE 0.0 END) / 1048576.0 AS mem
  FROM _cap
  UNION ALL
  SELECT event_id, 'view', {ui_cpu}, {ui_mem} / 1048576.0 FROM _cap WHERE event_type <> 'view')"""


def pod_usage_sql() -> str:
    return ("WITH " + _CAP + ",\n" + _pods_cte() + f"""
SELECT tick_id, model_name, {R('cpu', 6)} AS pod_cpu_millicores, {R('mem', 6)} AS pod_mem_mb FROM _pods""")


def scrape_metrics_sql() -> str:
    kv = _p6("CASE WHEN k % 2 = 0 THEN CAST(k AS DOUBLE) / 100.0 ELSE CAST(k AS DOUBLE) END")
    tpot_s = f"({_p6(f'{_TPOT} * (user_id + 1)')} / {_CNT})"
    cols = {
        "latency_p50_ms": f"{_p6('value * 5.0 / 1000.0')} * 1000.0",
        "latency_p95_ms": f"{_p6('value * 10.0 / 1000.0')} * 1000.0",
        "latency_p99_ms": f"{_p6('value * 14.0 / 1000.0')} * 1000.0",
        "ttft_p50_ms": f"{_p6('value * 2.0 / 1000.0')} * 1000.0",
        "ttft_p95_ms": f"CASE WHEN k % 10 <> 0 THEN {_p6('value * 4.0 / 1000.0')} * 1000.0 END",
        "tpot_mean_ms": f"{tpot_s} * 1000.0",
        "requests_running": "CAST(user_id % 12 AS DOUBLE)",
        "requests_waiting": "CAST(user_id % 30 AS DOUBLE)",
        "kv_cache_usage_pct": f"CASE WHEN {kv} <= 1.0 THEN {kv} * 100.0 ELSE {kv} END",
        "request_success_total": "CAST(ctr AS DOUBLE)",
        "prompt_tokens_total": "CAST(ctr * (50 + k) AS DOUBLE)",
        "generation_tokens_total": "CAST(ctr * (20 + k) AS DOUBLE)",
        "rtf": f"CASE WHEN event_type = 'purchase' AND {tpot_s} > 0 THEN 86.0 / (1.0 / {tpot_s}) END",
    }
    sel = ", ".join(f"{R(e, 6)} AS {c}" for c, e in cols.items())
    gsel = ", ".join(f"g.{c}" for c in GPU_BASE)
    body = f"""SELECT c.event_id AS scrape_id, c.ts AS scrape_ts, c.event_type AS model_name,
  CASE WHEN c.event_type = 'purchase' THEN 'tts' ELSE 'llm' END AS model_type, {sel}, {gsel},
  {R('p.cpu', 6)} AS pod_cpu_millicores, {R('p.mem', 6)} AS pod_mem_mb
FROM _cap c
LEFT JOIN _gpu g ON g.tick_id = c.event_id AND g.model_name = c.event_type
LEFT JOIN _pods p ON p.tick_id = c.event_id AND p.model_name = c.event_type"""
    return "WITH " + _CAP + ",\n" + _gpu_cte() + ",\n" + _pods_cte() + "\n" + body


def tick_assembly_sql(tolerance: int = 3) -> str:
    def side(name: str, src: str, every: int, miss: int, off: int) -> str:
        return f"""{name} AS (SELECT g.*, c.ts + to_seconds((g.tick_id % {2 * off + 1}) - {off}) - INTERVAL {tolerance} SECOND AS seen
  FROM {src} g JOIN _cap c ON c.event_id = g.tick_id WHERE g.tick_id % {every} <> {miss}
  QUALIFY row_number() OVER (PARTITION BY g.model_name, seen ORDER BY g.tick_id DESC) = 1)"""

    def near(s: str, expr: str, col: str) -> str:
        return f"CASE WHEN c.ts - {s}.seen <= INTERVAL {2 * tolerance} SECOND THEN {expr} END AS {col}"
    lat = _p6("value * 10.0 / 1000.0") + " * 1000.0"
    cols = ", ".join([*(near("g", f"g.{c}", c) for c in GPU_BASE), near("p", R("p.cpu", 6), "pod_cpu_millicores"), near("p", R("p.mem", 6), "pod_mem_mb")])
    return "WITH " + ",\n".join([_CAP, _gpu_cte(), _pods_cte(), side("_gt", "_gpu", 3, 0, 4), side("_pt", "_pods", 4, 1, 2)]) + f"""
SELECT c.event_id AS scrape_id, c.event_type AS model_name, {R(lat, 6)} AS latency_p95_ms, {cols}
FROM _cap c ASOF LEFT JOIN _gt g ON g.model_name = c.event_type AND c.ts >= g.seen
ASOF LEFT JOIN _pt p ON p.model_name = c.event_type AND c.ts >= p.seen"""


# ----------------------------------------------------------- streaming -----

def stream_bucket_sql(metrics=("requests_waiting", "kv_cache_usage_pct", "gpu_util_pct", "rtf")) -> str:
    cols = ", ".join(f"{R(f'avg({m})', 6)} AS {m}" for m in metrics)
    return with_telemetry(body=f"""SELECT model_name, {bucket('time', 900)} AS bucket, {cols}
FROM telemetry GROUP BY model_name, {bucket('time', 900)}""")


# -------------------------------------------------------------- advice -----

def _values(rows) -> str:
    esc = lambda s: "'" + s.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(esc(v) for v in r) + ")" for r in rows)


def drift_advice_sql() -> str:
    from ..operators.advice import drift_texts
    dim = f"_dim(metric, severity, interpretation, recommendation) AS ({_values(drift_texts())})"
    body = """SELECT d.model_name, d.metric, d.severity,
  COALESCE(x.interpretation, printf('Drift severity %s for %s.', d.severity, d.metric)) AS interpretation,
  COALESCE(x.recommendation, 'Review the metric and recent changes.') AS recommendation
FROM _drift_rows d LEFT JOIN _dim x ON x.metric = d.metric AND x.severity = d.severity
WHERE d.status = 'ok'"""
    return with_telemetry(*drift_ctes(AS_OF), dim, body=body)


def saturation_advice_sql() -> str:
    from ..operators.advice import saturation_texts
    dim = f"_sdim(metric, saturation_risk, recommendation) AS ({_values(saturation_texts())})"
    inner = saturation_sql()
    return f"""WITH {dim}, _sat AS ({inner})
SELECT s.model_name, s.metric, s.saturation_risk,
  COALESCE(x.recommendation, 'Watch the trend and plan capacity accordingly.') AS recommendation
FROM _sat s LEFT JOIN _sdim x ON x.metric = s.metric AND x.saturation_risk = s.saturation_risk"""
