"""Per-day state that drift and forecast windows are merged from.

Each closed day of the fact table is reduced once to two tables that merge by
addition:

* ``counts``: (model, metric, value) -> occurrences, for the drift metrics;
* ``buckets``: (model, metric, 15-minute bucket) -> sum and count, for the
  forecast metrics.  A bucket never spans two days.

A window is answered from the state of the days that lie in it whole and from
fact rows of its border days alone (the days that hold the window's start, its
cut and ``as_of``), which the fact table's date partitions prune.  Counts are
integers, so drift from the state equals a full scan exactly, whatever the
window.  A later ``as_of`` reads the newly closed days once and nothing else.

Late rows: ``update(..., redo=[day])`` replaces the state of that day.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DRIFT_METRICS, SATURATION_THRESHOLDS
from ..sources.tablestore import Table
from ..windows import as_of_value, window_seconds
from .drift import GROUP, distinct_counts, drift_from_counts, tag_windows
from .forecast import BUCKET_S, bucket_series, forecast
from .panels import bucket_start, long_metrics

DAY = dt.timedelta(days=1)
COUNTS = "model_name string, metric string, v double, n long, day date"
BUCKETS = "model_name string, metric string, bucket timestamp_ntz, total double, n long, day date"
MODELS = "model_name string, model_type string, n long, day date"


def dated(telemetry: DataFrame) -> DataFrame:
    """The fact table with its ``date`` (the stored one has it as a partition)."""
    return telemetry if "date" in telemetry.columns else telemetry.withColumn("date", F.to_date("time"))


class DayState:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.counts = Table(spark, f"{root.rstrip('/')}/counts", "day")
        self.buckets = Table(spark, f"{root.rstrip('/')}/buckets", "day")
        self.models = Table(spark, f"{root.rstrip('/')}/models", "day")     # written last: its days are done

    def days(self) -> set[dt.date]:
        return {dt.date.fromisoformat(d) for d in self.models.parts()}

    def update(self, telemetry: DataFrame, as_of, redo: Sequence[dt.date] = ()) -> list[dt.date]:
        """Reduce the days closed at ``as_of`` that have no state yet (and
        ``redo``); returns them.  Only these days' partitions are read.  A run
        that dies and is repeated gives the same state: days are replaced."""
        hi, t = as_of_value(as_of), dated(telemetry)
        closed = F.col("date") < F.lit(hi.date())
        have = {r[0] for r in t.where(closed).select("date").distinct().collect()}       # one row a day
        todo = sorted((have - self.days()) | (have & set(redo)))
        if not todo:
            return []
        rows = t.where(F.col("date").isin(todo))
        wide = rows.select("model_name", F.col("date").alias("day"), *[F.col(c).cast("double").alias(m) for m, c in DRIFT_METRICS.items()])
        values = wide.unpivot(["model_name", "day"], list(DRIFT_METRICS), "metric", "v").where("v is not null")
        self.counts.replace(values.groupBy("model_name", "metric", "v", "day").agg(F.count(F.lit(1)).alias("n")).select(
            "model_name", "metric", "v", "n", "day"))
        names = list(SATURATION_THRESHOLDS)
        x = rows.select("model_name", F.col("date").alias("day"), bucket_start("time", BUCKET_S).alias("bucket"), *names)
        sums = long_metrics(x, names, ["model_name", "day", "bucket"]).groupBy("model_name", "metric", "bucket", "day").agg(
            F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))
        self.buckets.replace(sums.select("model_name", "metric", "bucket", "total", "n", "day"))
        self.models.replace(rows.groupBy("model_name", "model_type", F.col("date").alias("day")).agg(F.count(F.lit(1)).alias("n")).select(
            "model_name", "model_type", "n", "day"))
        return todo

    # ---- windows ----

    def _split(self, telemetry: DataFrame, edges: Sequence[dt.datetime]) -> tuple[list[dt.date], list[dt.date]]:
        """(days answered from the state, days answered from fact rows) of the
        window between the first and the last edge."""
        lo, hi = edges[0], edges[-1]
        border = {e.date() for e in edges if e.time() != dt.time()} | {hi.date()}
        span = [lo.date() + i * DAY for i in range((hi.date() - lo.date()).days + 1)]
        done = self.days()
        whole = [d for d in span if d in done and d not in border]
        # a day without state may hold rows only if it is open or was never reduced
        return whole, [d for d in span if d not in set(whole)]

    def window_counts(self, telemetry: DataFrame, as_of, reference_window: str, comparison_window: str,
                      metrics: Sequence[str] | None = None) -> DataFrame:
        """(model, metric, v) -> n_r, n_c of the two windows, as ``distinct_counts``."""
        metrics = list(metrics or DRIFT_METRICS)
        hi = as_of_value(as_of)
        lo, cut = (hi - dt.timedelta(seconds=window_seconds(w)) for w in (reference_window, comparison_window))
        whole, raw = self._split(telemetry, [lo, cut, hi])
        zero = F.lit(0).cast("long")
        is_cmp = F.col("day") >= F.lit(cut.date())
        stored = self.counts.read([d.isoformat() for d in whole], _schema(self.spark, COUNTS)).where(F.col("metric").isin(metrics)).select(
            *GROUP, "v", F.when(is_cmp, zero).otherwise(F.col("n")).alias("n_r"), F.when(is_cmp, F.col("n")).otherwise(zero).alias("n_c"))
        t = dated(telemetry).where(F.col("date").isin(raw))
        fresh = distinct_counts(tag_windows(t, as_of, reference_window, comparison_window, metrics))
        return stored.unionByName(fresh).groupBy(*GROUP, "v").agg(F.sum("n_r").alias("n_r"), F.sum("n_c").alias("n_c"))

    def model_names(self, telemetry: DataFrame) -> DataFrame:
        """Every model of the fact table: from the state, and from days without one."""
        done = sorted(self.days())
        t = dated(telemetry)
        rest = t.where(~F.col("date").isin(done) | F.col("date").isNull()) if done else t
        return self.models.read(schema=_schema(self.spark, MODELS)).select("model_name").unionByName(rest.select("model_name")).distinct()

    def drift(self, telemetry: DataFrame, as_of, reference_window: str = "7d", comparison_window: str = "1h",
              metrics: Sequence[str] | None = None, **how) -> DataFrame:
        """``drift_scan`` answered from the state."""
        metrics = list(metrics or DRIFT_METRICS)
        dv = self.window_counts(telemetry, as_of, reference_window, comparison_window, metrics)
        return drift_from_counts(dv, self.model_names(telemetry), as_of, reference_window, comparison_window, metrics, **how)

    def series(self, telemetry: DataFrame, as_of, metrics: Sequence[str] | None = None, days: int = 14) -> DataFrame:
        """``bucket_series`` answered from the state."""
        metrics = list(metrics or SATURATION_THRESHOLDS)
        hi = as_of_value(as_of)
        whole, raw = self._split(telemetry, [hi - days * DAY, hi])
        stored = self.buckets.read([d.isoformat() for d in whole], _schema(self.spark, BUCKETS)).where(F.col("metric").isin(metrics))
        fresh = bucket_series(dated(telemetry).where(F.col("date").isin(raw)), as_of, metrics, days)
        return stored.select("model_name", "metric", "bucket", (F.col("total") / F.col("n")).alias("y")).unionByName(fresh)

    def forecast(self, telemetry: DataFrame, as_of, metrics: Sequence[str] | None = None, **how) -> tuple[DataFrame, DataFrame]:
        """``forecast`` over the state's series."""
        return forecast(telemetry, as_of, metrics, series=self.series(telemetry, as_of, metrics), **how)


def _schema(spark: SparkSession, ddl: str):
    from pyspark.sql import types as T
    return T.StructType.fromDDL(ddl)
