"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

All of them read the driver tables (the fact table is projected from
``events``) so their work grows with the data.  The fixed ``AS_OF`` makes
results reproducible; windows are chosen so every model has data at the
smallest scale.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import anomaly as _an
from ..operators import drift as _drift
from ..operators.ledger import RunLedger
from ..sources.tables import read_table
from ..sources.tablestore import Table, data_stamp
from ..sources.telemetry import project_events, rated_events
from ..store import ResultStore
from ..windows import as_of_value, minus_seconds, since, ts_lit

AS_OF = "2024-01-31 00:00:00"
REF_WINDOW, CMP_WINDOW = "30d", "10d"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


_FACT_TABLES: dict[tuple, str] = {}


def build_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingestion: project ``events`` onto the fact schema and derive the
    counter rates (the collector's work), as one Spark plan."""
    return project_events(rated_events(read_table(spark, sf_dir, "events")))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored fact table for ``sf_dir``.

    Written once per session (date-partitioned Parquet under the shared
    checkpoint folder) and read back, the way the collector's table is
    stored; keyed by names, sizes and times of the events files, wherever
    they lie, so new data re-ingest.  The ``date`` partition column is kept so time windows
    (``windows.since``) prune partitions."""
    return spark.read.parquet(telemetry_path(spark, sf_dir))


def telemetry_path(spark: SparkSession, sf_dir: str) -> str:
    """Path of the stored, date-partitioned fact table for ``sf_dir``."""
    src = f"{sf_dir.rstrip('/')}/events.parquet"
    key = (id(spark.sparkContext._jsc), src, data_stamp(spark, src))
    path = _FACT_TABLES.get(key)
    if path is None:
        from ..sources.sinks import shared_path, write_table
        # rows of a date together: else every task writes a file of every date, and
        # each reader opens tasks x dates small files; a large date is split (AQE).
        # Rows move narrow and are projected where they are written
        rated = rated_events(read_table(spark, sf_dir, "events")).withColumn("date", F.to_date("time")).hint("rebalance", "date")
        fact = project_events(rated).withColumn("date", F.to_date("time"))
        path = write_table(fact, shared_path(spark, "telemetry"), ["date"])
        _FACT_TABLES[key] = path
    return path


# ------------------------------------------------------- stored results ----

_STORES: dict[str, str] = {}


def result_store(spark: SparkSession, sf_dir: str) -> ResultStore:
    """The result tables that the jobs keep for this fact table."""
    fact = telemetry_path(spark, sf_dir)
    if fact not in _STORES:
        from ..sources.sinks import shared_path
        _STORES[fact] = shared_path(spark, "results")
    return ResultStore(spark, _STORES[fact])


def stored_drift(spark, sf_dir, points=None, comparison_window: str = CMP_WINDOW) -> DataFrame:
    """Stored drift rows of the given ``as_of`` points (default: ``AS_OF``).
    Points the drift job has not done yet are run first, from the per-day state
    (backfill); later calls only read."""
    st, points = result_store(spark, sf_dir), [as_of_value(p) for p in points or [AS_OF]]
    ledger, job = RunLedger(spark, f"{st.root}/ledger"), f"drift-{REF_WINDOW}-{comparison_window}"
    tel = telemetry(spark, sf_dir)
    ledger.run(job, points, lambda p: st.run_drift(tel, p, REF_WINDOW, comparison_window, p_method="series"))
    missed = ledger.due(job, points)
    if missed:
        raise RuntimeError(f"drift runs not completed: {[r.asDict() for r in ledger.runs(job).where('status <> \'done\'').collect()]}")
    return st.drift().where(F.col("computed_at").isin([ts_lit(p) for p in points])
                            & (F.col("reference_window") == REF_WINDOW) & (F.col("comparison_window") == comparison_window))


def stored_forest(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(baselines, nodes) of the stored forests; the training job runs once."""
    st = result_store(spark, sf_dir)
    ledger = RunLedger(spark, f"{st.root}/ledger")
    ledger.run("train", [AS_OF], lambda p: st.save_artifacts(*_an.train(telemetry(spark, sf_dir), p)))
    if ledger.due("train", [AS_OF]):
        raise RuntimeError(f"training not completed: {ledger.runs('train').collect()}")
    return st.load_artifacts()


def forest_events(spark, sf_dir) -> DataFrame:
    """Detector events of the stored forest, written by the scoring job once."""
    st = result_store(spark, sf_dir)
    ledger = RunLedger(spark, f"{st.root}/ledger")
    ledger.run("score", [AS_OF], lambda p: st.events.replace(
        _an.score_windows(telemetry(spark, sf_dir), *stored_forest(spark, sf_dir)).withColumn("date", F.to_date("computed_at"))))
    if ledger.due("score", [AS_OF]):
        raise RuntimeError(f"scoring not completed: {ledger.runs('score').collect()}")
    return st.events.read().drop("date")


# ------------------------------------------------------------------ drift --

def _drift_all(spark, sf_dir, p_method="series"):
    return _drift.drift_scan(telemetry(spark, sf_dir), AS_OF, REF_WINDOW, CMP_WINDOW,
                             p_method=p_method)


@query("drift_scan")
def q_drift_scan(spark, sf_dir):
    return _drift_all(spark, sf_dir)


@query("drift_psi")
def q_drift_psi(spark, sf_dir):
    return _drift_all(spark, sf_dir).where(F.col("status") == "ok").select(
        "model_name", "metric", "psi")


@query("drift_ks")
def q_drift_ks(spark, sf_dir):
    return _drift_all(spark, sf_dir).where(F.col("status") == "ok").select(
        "model_name", "metric", "n_reference", "n_comparison", "ks_statistic", "ks_p_value")


# ------------------------------------------------------- shared inputs ----

from ..operators import alerts as _alerts  # noqa: E402
from ..operators import compare as _cmp  # noqa: E402
from ..operators import forecast as _fc  # noqa: E402
from ..operators import maintenance as _mnt  # noqa: E402
from ..operators import panels as _pan  # noqa: E402
from ..operators.counters import vram_util_pct  # noqa: E402
from ..operators.health import model_health  # noqa: E402
from ..operators.rules import root_cause, root_cause_rows, rule_baselines  # noqa: E402
from ..functions.exprs import rnd  # noqa: E402

HEALTH_WINDOW = "24h"
COMPARE_METRIC = "latency_p95_ms"
ALERT_LIMIT = 20


def events(tel: DataFrame) -> DataFrame:
    """Detector events: the z-score scorer replayed over every minute against
    the baselines of the training window."""
    stats = _an.baselines(_an.training_rows(tel, AS_OF))
    return _an.zscore_events(_an.window_vectors(tel), stats).select(
        "computed_at", "model_name", "anomaly_score", "is_anomaly", "cold_start_mode",
        F.col("dims")[0]["feature"].alias("top_feature"), _an.top_dims(F.col("dims")).alias("top_dims"),
        rnd(F.aggregate("dims", F.lit(0.0), lambda acc, d: acc + d["deviation_pct"]), 2).alias("total_deviation"))


# ------------------------------------------------------- health / latest --

@query("health_snapshot")
def q_health(spark, sf_dir):
    tel = telemetry(spark, sf_dir)
    return model_health(tel, events(tel), stored_drift(spark, sf_dir), AS_OF, HEALTH_WINDOW)


@query("health_forest")
def q_health_forest(spark, sf_dir):
    """The health snapshot on the stored forest's events."""
    return model_health(telemetry(spark, sf_dir), forest_events(spark, sf_dir), stored_drift(spark, sf_dir), AS_OF, HEALTH_WINDOW)


@query("latest_per_model")
def q_latest(spark, sf_dir):
    tel = telemetry(spark, sf_dir)
    ev = _pan.latest_by(events(tel), ["model_name"], ["computed_at"], ["anomaly_score", "is_anomaly"])
    last = _pan.latest_by(tel, ["model_name"], ["time", "seq"], ["latency_p95_ms", "requests_waiting"])
    return (last.join(ev.withColumnRenamed("computed_at", "last_event_at"), "model_name", "left")
                .select("model_name", F.col("time").alias("last_time"), F.col("seq").alias("last_seq"),
                        "latency_p95_ms", "requests_waiting", "last_event_at", "anomaly_score",
                        "is_anomaly"))


@query("liveness")
def q_liveness(spark, sf_dir):
    return _pan.liveness(telemetry(spark, sf_dir))


@query("distinct_models")
def q_distinct_models(spark, sf_dir):
    return _pan.distinct_models(telemetry(spark, sf_dir))


# ------------------------------------------------------------- panels -----

@query("bucket_1m")
def q_bucket_1m(spark, sf_dir):
    return _pan.bucketed_avg(telemetry(spark, sf_dir), _pan.PANEL_METRICS, 60)


@query("bucket_15m")
def q_bucket_15m(spark, sf_dir):
    s = _fc.bucket_series(telemetry(spark, sf_dir), AS_OF)
    return s.select("model_name", "metric", "bucket", rnd("y", 6).alias("avg_value"))


@query("panel_legend")
def q_panel_legend(spark, sf_dir):
    b = _pan.bucketed_avg(telemetry(spark, sf_dir), _pan.PANEL_METRICS, 60)
    return _pan.legend_reductions(b, ["model_name", "metric"], "bucket", "avg_value")


@query("anomaly_score_panel")
def q_anomaly_panel(spark, sf_dir):
    ev = events(telemetry(spark, sf_dir))
    return (ev.groupBy("model_name", _pan.bucket_start("computed_at", 60).alias("bucket"))
              .agg(rnd(F.avg("anomaly_score"), 6).alias("avg_score")))


#: as_of points of the stored drift history: the last three day ends
HISTORY = [as_of_value(AS_OF) - _dt.timedelta(days=d) for d in (2, 1, 0)]


@query("drift_history")
def q_drift_history(spark, sf_dir):
    """Drift rows of three runs, backfilled by the run ledger."""
    return stored_drift(spark, sf_dir, HISTORY)


@query("drift_incremental")
def q_drift_incremental(spark, sf_dir):
    """Drift from per-day state that two updates built, for windows that cut
    through days; equals a full scan."""
    from ..operators.daystate import DayState
    from ..sources.sinks import shared_path
    tel, state = telemetry(spark, sf_dir), DayState(spark, shared_path(spark, "daystate"))
    state.update(tel, "2024-01-20 06:00:00")
    state.update(tel, INCREMENTAL[0])
    return state.drift(tel, *INCREMENTAL, p_method="series")


INCREMENTAL = ("2024-01-30 13:37:00", "20d", "36h")


@query("psi_panel")
def q_psi_panel(spark, sf_dir):
    """5-minute AVG PSI per 'model / metric' over the stored drift history (one
    run at each day end of the last 3 days)."""
    h = stored_drift(spark, sf_dir, HISTORY).where(F.col("psi").isNotNull())
    return (h.groupBy(F.concat_ws(" / ", "model_name", "metric").alias("series"),
                      _pan.bucket_start("computed_at", 300).alias("bucket"))
             .agg(rnd(F.avg("psi"), 6).alias("avg_psi")))


@query("rtf_panel")
def q_rtf_panel(spark, sf_dir):
    b = _pan.bucketed_avg(telemetry(spark, sf_dir), ["rtf"], 60, models=["purchase"])
    return b.select("bucket", F.lit("TTS RTF").alias("series"), "avg_value")


@query("latency_panels")
def q_latency_panels(spark, sf_dir):
    return _pan.bucketed_avg(telemetry(spark, sf_dir), _pan.LATENCY_METRICS, 60)


@query("gpu_heatmap")
def q_gpu_heatmap(spark, sf_dir):
    tel = since(telemetry(spark, sf_dir), AS_OF, 86400)
    return _pan.heatmap(tel, "gpu_util_pct", 300)


# ------------------------------------------------------------ counters -----

@query("counter_rate")
def q_counter_rate(spark, sf_dir):
    return telemetry(spark, sf_dir).select("model_name", "time", "seq", "request_success_total",
                                           rnd("throughput_rps", 6).alias("throughput_rps"))


@query("avg_tokens_per_request")
def q_avg_tokens(spark, sf_dir):
    return telemetry(spark, sf_dir).select("model_name", "time", "seq",
                                           rnd("avg_prompt_tokens", 6).alias("avg_prompt_tokens"),
                                           rnd("avg_completion_tokens", 6).alias("avg_completion_tokens"))


@query("vram_util")
def q_vram(spark, sf_dir):
    return telemetry(spark, sf_dir).select("model_name", "time", "seq",
                                           rnd(vram_util_pct(), 6).alias("gpu_mem_utilization_pct"))


# ------------------------------------------------------------- compare -----

@query("compare_stats")
def q_compare_stats(spark, sf_dir):
    st = _cmp.model_stats(telemetry(spark, sf_dir), AS_OF, COMPARE_METRIC, "24h")
    return st.drop("_mean", "_var")


@query("compare_welch")
def q_compare_welch(spark, sf_dir):
    tel = telemetry(spark, sf_dir)
    st = _cmp.model_stats(tel, AS_OF, COMPARE_METRIC, "24h")
    w = _cmp.welch(st, _cmp.busiest_model_pairs(tel, AS_OF, "24h"))
    return w.select("model_a", "model_b", "metric", "n_a", "n_b", "mean_a", "mean_b",
                    rnd("_t", 6).alias("t_statistic"), rnd("_df", 4).alias("welch_df"),
                    "difference_pct")


@query("compare_models")
def q_compare_models(spark, sf_dir):
    tel = telemetry(spark, sf_dir)
    return _cmp.compare_models(tel, _cmp.busiest_model_pairs(tel, AS_OF, "24h"), AS_OF,
                               COMPARE_METRIC, "24h")


# ---------------------------------------------------------- root cause -----

@query("root_cause")
def q_root_cause(spark, sf_dir):
    tel = telemetry(spark, sf_dir)
    d = root_cause_rows(tel, events(tel))
    return d.select("model_name", "time", "seq", "rule_id", "anomaly_detected", "root_cause",
                    "confidence", "evidence")


@query("root_cause_latest")
def q_root_cause_latest(spark, sf_dir):
    tel = telemetry(spark, sf_dir)
    return root_cause(tel, events(tel), AS_OF, lookback_minutes=1440, baselines=rule_baselines(tel, AS_OF))


@query("root_cause_forest")
def q_root_cause_forest(spark, sf_dir):
    """The diagnosis on the stored forest's events."""
    tel = telemetry(spark, sf_dir)
    return root_cause(tel, forest_events(spark, sf_dir), AS_OF, lookback_minutes=1440, baselines=rule_baselines(tel, AS_OF))


# -------------------------------------------------------------- alerts -----

def external_feed(tel: DataFrame) -> DataFrame:
    """Captured external-alert payloads rendered from the fact table: one per
    (model, hour) whose peak GPU temperature reaches 90 C.  Payloads of the
    'error' model carry no model label (falls back to job); odd hours carry
    no summary (falls back to alertname); alerts older than a day are
    resolved."""
    h = (tel.groupBy("model_name", F.date_trunc("hour", "time").alias("hour"))
            .agg(F.max("gpu_temp_celsius").alias("peak")).where(F.col("peak") >= 90))
    odd = (F.hour("hour") % 2) == 1
    labels = F.when(F.col("model_name") == "error",
                    F.create_map(F.lit("alertname"), F.lit("GpuTemperatureHigh"), F.lit("job"), F.col("model_name"),
                                 F.lit("severity"), F.lit("critical")))\
              .otherwise(F.create_map(F.lit("alertname"), F.lit("GpuTemperatureHigh"), F.lit("model_name"),
                                      F.col("model_name"), F.lit("severity"), F.lit("warning")))
    ann = F.when(odd, F.create_map(F.lit("description"), F.format_string("peak %.1f C", F.col("peak"))))\
           .otherwise(F.create_map(F.lit("summary"), F.lit("GPU temperature high"),
                                   F.lit("description"), F.format_string("peak %.1f C", F.col("peak"))))
    state = F.when(F.col("hour") < minus_seconds(AS_OF, 86400), "resolved").otherwise("active")
    return h.select(labels.alias("labels"), ann.alias("annotations"),
                    F.struct(state.alias("state")).alias("status"),
                    F.date_format("hour", "yyyy-MM-dd'T'HH:mm:ss").alias("startsAt"),
                    F.date_format(F.col("hour") + F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd'T'HH:mm:ss").alias("endsAt"))


def stored_alerts(tel: DataFrame, detector: DataFrame, drift: DataFrame) -> DataFrame:
    return (_alerts.detector_alerts(detector)
            .unionByName(_alerts.threshold_alerts(tel, AS_OF))
            .unionByName(_alerts.drift_alerts(drift)))


@query("threshold_alerts")
def q_threshold_alerts(spark, sf_dir):
    return _alerts.threshold_alerts(telemetry(spark, sf_dir), AS_OF).drop("anomaly_score", "resolved")


@query("drift_alerts")
def q_drift_alerts(spark, sf_dir):
    """Of one day against the 30 days before: short windows drift more."""
    return _alerts.drift_alerts(stored_drift(spark, sf_dir, comparison_window="1d")).drop("anomaly_score", "resolved")


@query("external_alerts")
def q_external_alerts(spark, sf_dir):
    return _alerts.external_alerts(external_feed(telemetry(spark, sf_dir))).drop("anomaly_score")


def _feed(spark, sf_dir, **kw):
    tel = telemetry(spark, sf_dir)
    return _alerts.alert_feed(stored_alerts(tel, events(tel), stored_drift(spark, sf_dir)), _alerts.external_alerts(external_feed(tel)),
                              limit=ALERT_LIMIT, **kw)


@query("alert_feed")
def q_alert_feed(spark, sf_dir):
    return _feed(spark, sf_dir).drop("_src", "anomaly_score")


@query("alert_feed_critical")
def q_alert_feed_critical(spark, sf_dir):
    return _feed(spark, sf_dir, severity="critical", include_resolved=True).drop("_src", "anomaly_score")


@query("alert_feed_forest")
def q_alert_feed_forest(spark, sf_dir):
    """The feed with the stored forest's events in place of z-score events."""
    tel = telemetry(spark, sf_dir)
    return _alerts.alert_feed(stored_alerts(tel, forest_events(spark, sf_dir), stored_drift(spark, sf_dir)),
                              _alerts.external_alerts(external_feed(tel)), limit=ALERT_LIMIT).drop("_src", "anomaly_score")


@query("alert_totals")
def q_alert_totals(spark, sf_dir):
    return _alerts.alert_totals(_feed(spark, sf_dir))


@query("alert_durations")
def q_alert_durations(spark, sf_dir):
    ext = _alerts.external_alerts(external_feed(telemetry(spark, sf_dir)))
    # resolved alerts end one hour after they fire (the captured endsAt)
    x = ext.select("model_name", "title", "severity", "fired_at",
                   F.when(F.col("resolved"), F.col("fired_at") + F.expr("INTERVAL 1 HOUR")).alias("resolved_at"))
    return _alerts.alert_durations(x, AS_OF, window_hours=48)


# ------------------------------------------------------------ forecast -----

@query("forecast_linear")
def q_forecast_linear(spark, sf_dir):
    _, pts = _fc.forecast(telemetry(spark, sf_dir), AS_OF, method="linear")
    return _fc.rounded_points(pts)


@query("saturation")
def q_saturation(spark, sf_dir):
    snap, _ = _fc.forecast(telemetry(spark, sf_dir), AS_OF, method="linear", requested_hours=2)
    return snap


#: (as_of of the stored forecasts, their metrics): fresh enough at AS_OF
CACHED = ("2024-01-30 23:40:00", ["gpu_util_pct", "requests_waiting"])


@query("forecast_cached")
def q_forecast_cached(spark, sf_dir):
    """Saturation served at AS_OF: two metrics from snapshots stored 20 minutes
    before, the others computed now."""
    from ..sources.sinks import shared_path
    tel, st = telemetry(spark, sf_dir), ResultStore(spark, shared_path(spark, "forecast_cache"))
    st.serve_forecast(tel, CACHED[0], CACHED[1], method="linear")
    return st.serve_forecast(tel, AS_OF, requested_hours=2, method="linear")[0]


@query("queue_overlay")
def q_queue_overlay(spark, sf_dir):
    """Queue history (15-min buckets) ++ forecast points as one series."""
    tel = telemetry(spark, sf_dir)
    hist = _fc.bucket_series(tel, AS_OF, ["requests_waiting"]).select(
        "model_name", F.col("bucket").alias("ts"), rnd("y", 4).alias("value"), F.lit("history").alias("kind"))
    _, pts = _fc.forecast(tel, AS_OF, ["requests_waiting"], method="linear")
    fut = _fc.rounded_points(pts, 2).select("model_name", F.col("ds").alias("ts"),
                                            F.col("yhat").alias("value"), F.lit("forecast").alias("kind"))
    return hist.unionByName(fut)


# --------------------------------------------------------- maintenance -----

def _daily_snapshots(tel: DataFrame) -> DataFrame:
    return (tel.groupBy("model_name", F.date_trunc("day", "time").alias("day"))
               .agg(rnd(F.avg("latency_p95_ms"), 4).alias("latency_p95_ms"),
                    F.count(F.lit(1)).alias("n"))
               .select("model_name", (F.col("day") + F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz").alias("computed_at"),
                       "latency_p95_ms", "n"))


@query("upsert_latest")
def q_upsert(spark, sf_dir):
    snaps = _daily_snapshots(telemetry(spark, sf_dir))
    older = snaps.where(F.col("computed_at") < ts_lit("2024-01-20 00:00:00"))
    newer = snaps.where(F.col("computed_at") >= ts_lit("2024-01-20 00:00:00"))
    return _mnt.upsert_latest(older, newer, ["model_name"])


@query("retention")
def q_retention(spark, sf_dir):
    kept = _mnt.retain(telemetry(spark, sf_dir), AS_OF, days=20)
    return kept.groupBy("model_name").agg(F.count(F.lit(1)).alias("n_kept"),
                                          F.min("time").alias("oldest_kept"))


@query("table_maintenance")
def q_table_maintenance(spark, sf_dir):
    """Daily snapshots in a partitioned table: append, upsert of the last three
    days with corrected rows, retention by partition; then read back."""
    from ..sources.sinks import shared_path
    snaps = _daily_snapshots(telemetry(spark, sf_dir)).withColumn("day", F.to_date(F.col("computed_at") - F.expr("INTERVAL 1 DAY")))
    t = Table(spark, shared_path(spark, "maintenance"), "day")
    t.append(snaps)
    late = snaps.where(F.col("day") >= F.lit("2024-01-28").cast("date"))
    t.upsert(late.withColumns({"computed_at": F.col("computed_at") + F.expr("INTERVAL 1 HOUR"), "n": F.col("n") + 1000}), ["model_name", "day"])
    t.drop_before("2024-01-11")
    return t.read().withColumn("day", F.col("day").cast("string"))


@query("stale_keys")
def q_stale_keys(spark, sf_dir):
    """Drift keys whose stored result (one per minute bucket replayed) is
    older than the 6-minute freshness window."""
    tel = telemetry(spark, sf_dir)
    keys = tel.select("model_name").distinct().select(
        "model_name", F.explode(F.array(*[F.lit(m) for m in _drift.DRIFT_METRICS])).alias("metric"))
    stored = (_pan.bucketed_avg(tel, [_drift.DRIFT_METRICS[m] for m in _drift.DRIFT_METRICS], 60)
              .select("model_name", F.col("metric").alias("col"),
                      (F.col("bucket") + F.expr("INTERVAL 60 SECONDS")).alias("computed_at")))
    inv = {v: k for k, v in _drift.DRIFT_METRICS.items()}
    m = F.lit(None).cast("string")
    for col, name in inv.items():
        m = F.when(F.col("col") == col, F.lit(name)).otherwise(m)
    stored = stored.withColumn("metric", m)
    return _mnt.stale_keys(keys, stored, ["model_name", "metric"], AS_OF, 6)


# ------------------------------------------------------------- anomaly -----

@query("anomaly_baselines")
def q_anomaly_baselines(spark, sf_dir):
    base = _an.baselines(_an.training_rows(telemetry(spark, sf_dir), AS_OF))
    return base.select("model_name", "model_type", F.col("n").alias("n_training_samples"),
                       *[rnd(f"mean_{s}", 6).alias(f"mean_{s}") for s in _an.SLOTS],
                       *[rnd(f"std_{s}", 6).alias(f"std_{s}") for s in _an.SLOTS])


@query("contributing_dims")
def q_contributing_dims(spark, sf_dir):
    tel = telemetry(spark, sf_dir)
    base = _an.baselines(_an.training_rows(tel, AS_OF)).select(
        "model_name", *[rnd(f"mean_{s}", 6).alias(f"mean_{s}") for s in _an.SLOTS])
    vec = _an.window_vectors(tel).join(base, "model_name")
    d = vec.select("model_name", "bucket", F.posexplode(_an.contributing_dims(vec, base)).alias("pos", "d"))
    return d.select("model_name", "bucket", (F.col("pos") + 1).alias("rank"), F.col("d.feature").alias("feature"),
                    F.col("d.value").alias("value"), F.col("d.baseline").alias("baseline"),
                    F.col("d.deviation_pct").alias("deviation_pct"))


@query("anomaly_train")
def q_anomaly_train(spark, sf_dir):
    mb, nodes = _an.train(telemetry(spark, sf_dir), AS_OF)
    sizes = nodes.groupBy("model_name").agg(F.count(F.lit(1)).alias("n_nodes"),
                                            F.countDistinct("tree").alias("n_trees"))
    return mb.join(sizes, "model_name", "left").select(
        "model_name", "model_type", "trained_at", "n_training_samples", rnd("score_offset", 6).alias("score_offset"),
        "n_nodes", "n_trees", *[f"mean_{s}" for s in _an.SLOTS], *[f"std_{s}" for s in _an.SLOTS])


@query("anomaly_score")
def q_anomaly_score(spark, sf_dir):
    """Every 1-minute window scored by the stored forest."""
    ev = _an.score_windows(telemetry(spark, sf_dir), *stored_forest(spark, sf_dir))
    return ev.select("computed_at", "model_name", "anomaly_score", "is_anomaly", "cold_start_mode",
                     "top_feature", rnd("total_deviation", 2).alias("total_deviation"))


@query("train_quarantine")
def q_train_quarantine(spark, sf_dir):
    """Training where one model's rows cannot be scaled: its status is 'error',
    the others train as usual."""
    tel = telemetry(spark, sf_dir)
    huge = F.when(F.col("seq") % 2 == 0, F.lit(1.5e308)).otherwise(F.lit(-1.5e308))
    bad = tel.withColumn("latency_p95_ms", F.when(F.col("model_name") == "error", huge).otherwise(F.col("latency_p95_ms")))
    mb, _, failed = _an.train_isolated(bad, AS_OF, n_trees=4)
    return mb.select("model_name", F.lit("ok").alias("status"), F.col("n_training_samples").cast("long").alias("n_training_samples")).unionByName(
        failed.select("model_name", F.lit("error").alias("status"), F.lit(None).cast("long").alias("n_training_samples")))


@query("forecast_seasonal")
def q_forecast_seasonal(spark, sf_dir):
    """Seasonal fit where a series has >= 672 buckets, linear elsewhere."""
    snap, pts = _fc.forecast(telemetry(spark, sf_dir), AS_OF, method="auto")
    return snap.join(_fc.rounded_points(pts), ["model_name", "metric"]).select(
        "model_name", "metric", "cold_start_mode", "n_training_points", "saturation_risk",
        "step", "ds", "yhat", "yhat_lower", "yhat_upper")


# ----------------------------------------------------------- ingestion -----

from ..operators import ingest as _ing  # noqa: E402
from ..sources import captures as _cap  # noqa: E402


#: events rendered and parsed by one task (about 0.1 GB of GPU captures)
CAPTURE_ROWS = 50_000


def _events_for_capture(spark, sf_dir, *by):
    from ..session import spread
    return _cap.with_counter_base(spread(read_table(spark, sf_dir, "events"), CAPTURE_ROWS, *by))


@query("exposition_samples")
def q_exposition_samples(spark, sf_dir):
    from ..sources.exposition import parse_samples
    s = parse_samples(_cap.model_scrapes(_events_for_capture(spark, sf_dir)), keep=("scrape_id",))
    return s.select("scrape_id", "ordinal", "name", F.col("labels")["model_name"].alias("model_label"),
                    F.col("labels")["quantile"].alias("quantile_label"),
                    F.col("labels")["engine"].alias("engine_label"), "value")


@query("gpu_node_match")
def q_gpu_node_match(spark, sf_dir):
    g = _ing.gpu_metrics(_cap.gpu_scrapes(_events_for_capture(spark, sf_dir)), _cap.registry(spark))
    return g.select("tick_id", "model_name", *[rnd(c, 6).alias(c) for c in _ing.GPU_COLUMNS.values()])


@query("pod_usage")
def q_pod_usage(spark, sf_dir):
    p = _ing.pod_usage(_cap.pod_documents(_events_for_capture(spark, sf_dir)), _cap.registry(spark))
    return p.select("tick_id", "model_name", rnd("pod_cpu_millicores", 6).alias("pod_cpu_millicores"),
                    rnd("pod_mem_mb", 6).alias("pod_mem_mb"))


SCRAPE_DOUBLES = ["latency_p50_ms", "latency_p95_ms", "latency_p99_ms", "ttft_p50_ms", "ttft_p95_ms",
                  "tpot_mean_ms", "requests_running", "requests_waiting", "kv_cache_usage_pct",
                  "request_success_total", "prompt_tokens_total", "generation_tokens_total", "rtf",
                  "gpu_util_pct", "gpu_mem_used_mb", "gpu_mem_free_mb", "gpu_temp_celsius", "gpu_power_watts",
                  "pod_cpu_millicores", "pod_mem_mb"]


def scrape_rows(spark, sf_dir) -> DataFrame:
    ev = _events_for_capture(spark, sf_dir)
    reg = _cap.registry(spark)
    return _ing.assemble(_ing.model_metrics(_cap.model_scrapes(ev), reg),
                         _ing.gpu_metrics(_cap.gpu_scrapes(ev), reg),
                         _ing.pod_usage(_cap.pod_documents(ev), reg))


@query("scrape_metrics")
def q_scrape_metrics(spark, sf_dir):
    a = scrape_rows(spark, sf_dir)
    return a.select("scrape_id", "scrape_ts", "model_name", "model_type",
                    *[rnd(c, 6).alias(c) for c in SCRAPE_DOUBLES])


#: seconds a GPU or pod capture may lie before or after the model's scrape
TICK_TOLERANCE = 3


@query("tick_assembly")
def q_tick_assembly(spark, sf_dir):
    """Model scrapes joined in time with GPU and pod captures that come off
    beat and now and then not at all."""
    ev = _events_for_capture(spark, sf_dir)
    reg, eid = _cap.registry(spark), F.col("event_id")

    def captured(render, every: int, miss: int, off: int):
        kept = ev.where(eid % every != miss)
        ticks = kept.select(eid.alias("tick_id"), (F.col("ts") + F.make_dt_interval(secs=(eid % (2 * off + 1)) - off)).alias("tick_ts"))
        return render(kept), ticks

    gpu, gpu_ticks = captured(_cap.gpu_scrapes, 3, 0, 4)
    pods, pod_ticks = captured(_cap.pod_documents, 4, 1, 2)
    models = _ing.model_metrics(_cap.model_scrapes(ev), reg).select("scrape_id", "scrape_ts", "model_name", "latency_p95_ms")
    a = _ing.assemble_ticks(models, _ing.timed(_ing.gpu_metrics(gpu, reg), gpu_ticks),
                            _ing.timed(_ing.pod_usage(pods, reg), pod_ticks), TICK_TOLERANCE)
    return a.select("scrape_id", "model_name", *[rnd(c, 6).alias(c) for c in ["latency_p95_ms", *_ing.GPU_COLUMNS.values(), "pod_cpu_millicores", "pod_mem_mb"]])


# ----------------------------------------------------------- streaming -----

from ..streaming import jobs as _st  # noqa: E402


def _fact_stream(spark, sf_dir):
    path = telemetry_path(spark, sf_dir)
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("basePath", path).parquet(path)


@query("stream_rate")
def q_stream_rate(spark, sf_dir):
    """Throughput from the stream; equals counter_rate."""
    r = _st.rate_run(_fact_stream(spark, sf_dir), "stream_rate")
    return r.select("model_name", "time", "seq", "request_success_total",
                    rnd("throughput_rps", 6).alias("throughput_rps"))


# the stored fact table is read in one batch: nothing comes late
STREAM_DELAY = "0 seconds"
STREAM_BUCKET_METRICS = ["requests_waiting", "kv_cache_usage_pct", "gpu_util_pct", "rtf"]


@query("stream_bucket")
def q_stream_bucket(spark, sf_dir):
    """T4: watermarked 15-minute windows, those open at the end included."""
    return _st.bucket_run(_fact_stream(spark, sf_dir), telemetry(spark, sf_dir), STREAM_BUCKET_METRICS, STREAM_DELAY)


_CAPTURE_TABLES: dict[tuple, str] = {}


def _capture_path(spark, sf_dir, kind):
    src = f"{sf_dir.rstrip('/')}/events.parquet"
    key = (id(spark.sparkContext._jsc), src, data_stamp(spark, src), kind)
    if key not in _CAPTURE_TABLES:
        from ..sources.sinks import shared_path, write_table
        ev = _events_for_capture(spark, sf_dir, "ts", "event_id")     # in time order: few days a task, few files a day
        df = {"model": _cap.model_scrapes, "gpu": _cap.gpu_scrapes, "pods": _cap.pod_documents}[kind](ev)
        if kind != "model":                # by day, so that a micro-batch reads its own days
            df = df.withColumn("date", F.to_date("tick_ts"))
        _CAPTURE_TABLES[key] = write_table(df, shared_path(spark, f"capture_{kind}"), ["date"] if kind != "model" else [])
    return _CAPTURE_TABLES[key]


@query("stream_ingest")
def q_stream_ingest(spark, sf_dir):
    """Captured scrapes streamed through the collector pipeline in
    foreachBatch; GPU and pod captures are static sides, partitioned by day, of
    which a batch reads the days it has scrapes of."""
    mpath = _capture_path(spark, sf_dir, "model")
    gpu = spark.read.parquet(_capture_path(spark, sf_dir, "gpu"))
    pods = spark.read.parquet(_capture_path(spark, sf_dir, "pods"))
    reg = _cap.registry(spark)
    stream = spark.readStream.schema(spark.read.parquet(mpath).schema).parquet(mpath)

    def process(batch):
        # a micro-batch runs with the session's number of tasks, whatever its size: numbered by its rows here
        days = batch.groupBy(F.to_date("scrape_ts").alias("day")).count().collect()
        tasks = max(spark.sparkContext.defaultParallelism, -(-sum(d["count"] for d in days) // CAPTURE_ROWS))
        ticks = batch.select(F.col("scrape_id").alias("tick_id")).repartition(tasks, "tick_id").distinct()
        mine = F.col("date").isin([d["day"] for d in days])

        def captured(side):       # the ids are hashed: no sort of the texts; a semi join would be moved before the repartition
            return side.where(mine).repartition(tasks, "tick_id").join(ticks.hint("shuffle_hash"), "tick_id")

        m = _ing.model_metrics(batch.repartition(tasks, "scrape_id", "model_name"), reg)
        return _ing.assemble(m, _ing.gpu_metrics(captured(gpu), reg), _ing.pod_usage(captured(pods), reg), tasks)

    a = _st.ingest_stream(stream, process, "stream_ingest")
    return a.select("scrape_id", "scrape_ts", "model_name", "model_type",
                    *[rnd(c, 6).alias(c) for c in SCRAPE_DOUBLES])


# -------------------------------------------------------------- advice -----

from ..operators import advice as _adv  # noqa: E402


@query("drift_advice")
def q_drift_advice(spark, sf_dir):
    d = stored_drift(spark, sf_dir).where(F.col("status") == "ok")
    return _adv.with_drift_advice(d).select("model_name", "metric", "severity", "interpretation",
                                            "recommendation")


@query("saturation_advice")
def q_saturation_advice(spark, sf_dir):
    snap, _ = _fc.forecast(telemetry(spark, sf_dir), AS_OF, method="linear", requested_hours=2)
    return _adv.with_saturation_advice(snap).select("model_name", "metric", "saturation_risk", "recommendation")


@query("stream_scoring")
def q_stream_scoring(spark, sf_dir):
    """Streamed 1-minute windows scored with the stored forest; the output
    equals the batch ``anomaly_score``."""
    ev = _st.scoring_run(_fact_stream(spark, sf_dir), telemetry(spark, sf_dir), *stored_forest(spark, sf_dir), STREAM_DELAY)
    return ev.select("computed_at", "model_name", "anomaly_score", "is_anomaly", "cold_start_mode",
                     "top_feature", rnd("total_deviation", 2).alias("total_deviation"))
