"""Window strings and `as_of` handling."""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .config import ENUM_WINDOWS_MINUTES, FORECAST_MAX_HORIZON_H

_WINDOW_RE = re.compile(r"^\s*(\d+)\s*([dhm])\s*$")
_UNIT_SECONDS = {"d": 86400, "h": 3600, "m": 60}


def window_seconds(window: str) -> int:
    """Parse ``Nd`` / ``Nh`` / ``Nm``.  Unknown strings are rejected."""
    m = _WINDOW_RE.match(window)
    if not m:
        raise ValueError(f"unsupported window {window!r}; use Nd, Nh or Nm")
    return int(m.group(1)) * _UNIT_SECONDS[m.group(2)]


def enum_window_seconds(window: str, default: str) -> int:
    """Enumerated tool windows; unknown names fall back to ``default``."""
    return ENUM_WINDOWS_MINUTES.get(window, ENUM_WINDOWS_MINUTES[default]) * 60


def clamp_horizon(hours: int) -> int:
    return max(1, min(int(hours), FORECAST_MAX_HORIZON_H))


def as_of_value(as_of) -> _dt.datetime:
    if isinstance(as_of, _dt.datetime):
        return as_of
    return _dt.datetime.fromisoformat(str(as_of))


def ts_lit(as_of) -> Column:
    """`as_of` as a TIMESTAMP_NTZ literal (the fact table's time type)."""
    return F.lit(as_of_value(as_of).strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def minus_seconds(as_of, seconds: int) -> Column:
    return ts_lit(as_of_value(as_of) - _dt.timedelta(seconds=seconds))


def since(df, as_of, seconds: int, time_col: str = "time", open_end: bool = False):
    """Rows with ``as_of - seconds <= time <= as_of``: a past ``as_of`` does not
    see what came after it (``open_end`` keeps later rows).  When the frame
    carries the fact table's ``date`` partition column, the equivalent date
    predicates are added so the scan prunes whole partitions instead of opening
    every file (Spark does not derive them from the time predicate by itself)."""
    hi = as_of_value(as_of)
    lo = hi - _dt.timedelta(seconds=seconds)
    out = df.where(F.col(time_col) >= minus_seconds(as_of, seconds))
    if "date" in df.columns:
        out = out.where(F.col("date") >= F.lit(lo.date()))
    if open_end:
        return out
    out = out.where(F.col(time_col) <= ts_lit(as_of))
    return out.where(F.col("date") <= F.lit(hi.date())) if "date" in df.columns else out
