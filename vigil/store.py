"""Stored results: what the jobs write and the query tools read.

Drift rows, detector events, forecast snapshots and trained forests live in
partitioned tables (``sources.tablestore``).  Jobs append or upsert; health,
alerts and the cached tools read the newest rows at an explicit ``as_of`` and
recompute only keys whose stored row is missing or too old.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DRIFT_FRESH_MINUTES, DRIFT_METRICS, FORECAST_FRESH_MINUTES, RETENTION_DAYS, SATURATION_THRESHOLDS
from .operators.daystate import DayState
from .operators.forecast import SERIES, snapshot_rows
from .operators.maintenance import serve_with_cache
from .sources.tablestore import Table
from .windows import as_of_value, clamp_horizon, minus_seconds, ts_lit

DRIFT_KEYS = ["model_name", "metric", "reference_window", "comparison_window"]


def _keys(models: DataFrame, metrics) -> DataFrame:
    return models.select("model_name").distinct().select("model_name", F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric"))


class ResultStore:
    def __init__(self, spark: SparkSession, root: str):
        root = root.rstrip("/")
        self.spark, self.root = spark, root
        self.state = DayState(spark, f"{root}/state")
        self.drift_history = Table(spark, f"{root}/drift_history", "date")
        self.drift_scores = Table(spark, f"{root}/drift_scores", "model_name")
        self.events = Table(spark, f"{root}/anomaly_events", "date")
        self.forecasts = Table(spark, f"{root}/forecast_snapshots", "date")
        self.artifacts = Table(spark, f"{root}/model_artifacts", "model_name")
        self.forests = Table(spark, f"{root}/forest_nodes", "model_name")

    # ---- drift (S9) ----

    def run_drift(self, telemetry: DataFrame, as_of, reference_window: str = "7d", comparison_window: str = "1h", **how) -> DataFrame:
        """One run of the drift job: closes the days' state, scores every model
        and metric from it, upserts the newest scores and keeps the history."""
        self.state.update(telemetry, as_of)
        rows = self.state.drift(telemetry, as_of, reference_window, comparison_window, **how)
        return self.save_drift(rows)

    def save_drift(self, rows: DataFrame) -> DataFrame:
        from .sources.sinks import materialize
        rows = materialize(rows, "drift_run")              # read by both tables
        ok = rows.where(F.col("status") == "ok")
        self.drift_scores.upsert(ok, DRIFT_KEYS)
        self.drift_history.append(rows.withColumn("date", F.to_date("computed_at")))
        return rows

    def drift(self, as_of=None) -> DataFrame:
        """Stored drift rows, one per key and run, not newer than ``as_of``.
        A run repeated for the same ``as_of`` counts once."""
        h = self.drift_history.read().drop("date")
        h = h if as_of is None else h.where(F.col("computed_at") <= ts_lit(as_of))
        return h.dropDuplicates([*DRIFT_KEYS, "computed_at"])

    def newest_drift(self, as_of, reference_window: str, comparison_window: str) -> DataFrame:
        """The rows of the newest stored run of these windows at ``as_of``."""
        d = self.drift(as_of).where((F.col("reference_window") == reference_window) & (F.col("comparison_window") == comparison_window))
        last = d.agg(F.max("computed_at").alias("_last"))          # one row
        return d.join(F.broadcast(last), F.col("computed_at") == F.col("_last")).drop("_last")

    def serve_drift(self, telemetry: DataFrame, as_of, reference_window: str = "7d", comparison_window: str = "1h", metrics=None, **how) -> DataFrame:
        """Drift scores at ``as_of``: stored ones younger than six minutes, and
        fresh ones for the keys that have none (these are stored)."""
        metrics = list(metrics or DRIFT_METRICS)

        def compute(stale: DataFrame) -> DataFrame:
            self.state.update(telemetry, as_of)
            fresh = self.state.drift(telemetry, as_of, reference_window, comparison_window, metrics, **how)
            return self.save_drift(fresh.join(stale, ["model_name", "metric"], "left_semi"))

        requested = _keys(self.state.model_names(telemetry), metrics)
        if not self.drift_scores.exists():
            return compute(requested)
        mine = self.drift_scores.read().where((F.col("reference_window") == reference_window) & (F.col("comparison_window") == comparison_window)
                                              & (F.col("computed_at") <= ts_lit(as_of)))
        return serve_with_cache(requested, mine, compute, ["model_name", "metric"], as_of, DRIFT_FRESH_MINUTES)

    # ---- detector events and artifacts (S8, S11, S12) ----

    def save_events(self, events: DataFrame) -> None:
        self.events.append(events.withColumn("date", F.to_date("computed_at")))

    def save_artifacts(self, model_baselines: DataFrame, nodes: DataFrame) -> None:
        """Newest forest per model: baselines are upserted, the trained models'
        node partitions replaced.  Other models' files stay as they are."""
        self.forests.replace(nodes)
        self.artifacts.upsert(model_baselines, ["model_name"], "trained_at")

    def load_artifacts(self) -> tuple[DataFrame, DataFrame]:
        """(baselines, nodes) of every model's newest forest."""
        return self.artifacts.read(), self.forests.read()

    # ---- forecasts (S10, S16) ----

    def save_forecast(self, snapshots: DataFrame, points: DataFrame) -> DataFrame:
        from .sources.sinks import materialize
        rows = materialize(snapshot_rows(snapshots.drop("saturation_within_horizon"), points), "forecast_run")
        self.forecasts.append(rows.withColumn("date", F.to_date("computed_at")))
        return rows

    def serve_forecast(self, telemetry: DataFrame, as_of, metrics=None, requested_hours: int = 2, method: str = "auto") -> tuple[DataFrame, DataFrame]:
        """(snapshots, points of the requested hours): stored snapshots younger
        than 35 minutes, and new ones, stored too, for the other keys."""
        metrics = list(metrics or SATURATION_THRESHOLDS)
        self.state.update(telemetry, as_of)

        def compute(stale: DataFrame) -> DataFrame:
            names = sorted(r[0] for r in stale.select("metric").distinct().collect())          # at most the metrics' names
            snap, pts = self.state.forecast(telemetry, as_of, names, method=method)
            return self.save_forecast(snap.join(stale, SERIES, "left_semi"), pts.join(stale, SERIES, "left_semi"))

        # a key is a series that has buckets in the window; the others have no forecast
        keys = self.state.series(telemetry, as_of, metrics).select(*SERIES).distinct()
        if self.forecasts.exists():
            fresh = minus_seconds(as_of, FORECAST_FRESH_MINUTES * 60)
            days = sorted({(as_of_value(as_of) - dt.timedelta(minutes=m)).date().isoformat() for m in (0, FORECAST_FRESH_MINUTES)})
            stored = self.forecasts.read(days).drop("date").where((F.col("computed_at") <= ts_lit(as_of)) & (F.col("computed_at") >= fresh))
            rows = serve_with_cache(keys, stored, compute, SERIES, as_of, FORECAST_FRESH_MINUTES)
        else:
            rows = compute(keys)
        hours = (F.unix_micros(F.col("saturation_time").cast("timestamp")) - F.unix_micros(F.col("computed_at").cast("timestamp"))) / 3.6e9
        h = clamp_horizon(requested_hours)
        snap = rows.drop("points").withColumn("saturation_within_horizon", hours <= h)
        pts = rows.select(*SERIES, F.posexplode(F.slice("points", 1, h * 4)).alias("step", "p"))
        return snap, pts.select(*SERIES, (F.col("step") + 1).alias("step"), F.col("p.timestamp").alias("ds"), "p.yhat", "p.yhat_lower", "p.yhat_upper")

    # ---- retention (S13) ----

    def retain(self, as_of) -> dict[str, list[str]]:
        """Drop the date partitions that are past their table's retention."""
        out = {}
        for table, name in ((self.drift_history, "drift_scores"), (self.events, "anomaly_events"), (self.forecasts, "forecast_snapshots")):
            cut = as_of_value(as_of).date() - dt.timedelta(days=RETENTION_DAYS[name])
            out[name] = table.drop_before(cut.isoformat())
        return out

