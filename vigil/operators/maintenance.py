"""Result-table maintenance: keyed upsert, retention, freshness gate
(S9, S11, S13, S15, S16)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..windows import minus_seconds, since
from .panels import latest_by


def upsert_latest(existing: DataFrame | None, new: DataFrame, keys: Sequence[str],
                  ts_col: str = "computed_at") -> DataFrame:
    """Newest row per key over existing + new (ON CONFLICT DO UPDATE).

    On equal ``ts_col`` the new row wins; among equals of one side the larger
    value row does, so a rerun gives the same table.  The row is taken whole.
    Write the result to a new path and swap; never overwrite the input path."""
    u = new.withColumn("_rank", F.lit(1))
    if existing is not None:
        u = existing.withColumn("_rank", F.lit(0)).unionByName(u, allowMissingColumns=True)
    values = [c for c in u.columns if c not in keys and c not in (ts_col, "_rank")]
    return latest_by(u, keys, [ts_col, "_rank"], values).select(*[c for c in u.columns if c != "_rank"])


def retain(df: DataFrame, as_of, days: int, time_col: str = "time") -> DataFrame:
    """Rows younger than ``days`` at ``as_of``.  On partitioned storage the
    same predicate on the date column prunes whole directories."""
    return since(df, as_of, days * 86400, time_col, open_end=True)


def stale_keys(requested: DataFrame, results: DataFrame, keys: Sequence[str], as_of,
               fresh_minutes: int, ts_col: str = "computed_at") -> DataFrame:
    """Requested keys with no result newer than ``fresh_minutes`` (left anti):
    only these need recomputation; the rest are served from the table."""
    fresh = results.where(F.col(ts_col) >= minus_seconds(as_of, fresh_minutes * 60)).select(*keys)
    return requested.join(fresh, list(keys), "left_anti")


def serve_with_cache(requested: DataFrame, results: DataFrame, compute, keys: Sequence[str],
                     as_of, fresh_minutes: int, ts_col: str = "computed_at") -> DataFrame:
    """Fresh stored rows for cached keys + ``compute(stale_keys)`` for the rest;
    nothing is computed when no key is stale."""
    stale = stale_keys(requested, results, keys, as_of, fresh_minutes, ts_col)
    none_stale = stale.isEmpty()        # a job over the keys alone
    fresh = results.where(F.col(ts_col) >= minus_seconds(as_of, fresh_minutes * 60))
    cached = latest_by(fresh.join(requested, list(keys), "left_semi"), keys, [ts_col],
                       [c for c in results.columns if c not in keys and c != ts_col])
    cached = cached.select(*results.columns)
    return cached if none_stale else cached.unionByName(compute(stale), allowMissingColumns=True)
