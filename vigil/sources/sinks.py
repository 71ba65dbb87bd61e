"""Writers for the fact table and result tables.

Every write goes to a fresh path under a shared folder and is read back
with ``spark.read.parquet``: lineage is cut (executor loss only re-reads
files) and Parquet keeps column pruning and predicate pushdown, which a
``checkpoint()``-ed RDD would lose.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}-{uuid.uuid4().hex[:12]}"


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (),
                mode: str = "errorifexists") -> str:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def materialize(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    spark = df.sparkSession
    path = write_table(df, shared_path(spark, name), partition_by)
    return spark.read.parquet(path)


def append_fact_rows(df: DataFrame, path: str) -> None:
    """Append scrape rows to the fact table, partitioned by date."""
    (df.withColumn("date", F.to_date("time")).write.mode("append")
       .partitionBy("date").parquet(path))


def swap_write(df: DataFrame, table_root: str) -> str:
    """Upsert sink: write the merged table to a new version directory; the
    caller points readers at it (never overwrite the path being read)."""
    return write_table(df, f"{table_root.rstrip('/')}/v={uuid.uuid4().hex[:12]}")


def write_drift_results(results: DataFrame, root: str, latest_version: str | None = None) -> str:
    """Append every run to ``{root}/history`` (the PSI trend needs it) and
    rewrite the keyed latest table (model, metric, windows) into a new
    version directory; returns the new latest path."""
    from ..operators.maintenance import upsert_latest
    ok = results.where(F.col("status") == "ok")
    ok.withColumn("date", F.to_date("computed_at")).write.mode("append").partitionBy("date").parquet(
        f"{root.rstrip('/')}/history")
    spark = results.sparkSession
    existing = spark.read.parquet(latest_version) if latest_version else None
    latest = upsert_latest(existing, ok, ["model_name", "metric", "reference_window", "comparison_window"])
    return swap_write(latest, f"{root.rstrip('/')}/latest")
