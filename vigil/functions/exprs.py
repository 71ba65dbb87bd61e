"""Scalar column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rnd(x, digits: int) -> Column:
    """Round half away from zero on the binary value.

    Spark's ``round`` goes through a decimal string; this form is plain IEEE
    arithmetic, so the same expression in SQL gives bit-identical results.
    -0.0 is normalised to 0.0.
    """
    x = _c(x)
    m = F.lit(float(10 ** digits))
    return F.when(x < 0, -F.floor(-x * m + 0.5) / m).otherwise(F.floor(x * m + 0.5) / m) + F.lit(0.0)


def finite(x) -> Column:
    x = _c(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def nan_to_null(x) -> Column:
    x = _c(x)
    return F.when(finite(x), x)
