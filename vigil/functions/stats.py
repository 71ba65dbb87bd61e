"""Distribution tails Spark does not ship, as vectorised pandas UDFs.

They run on small per-group result tables (one row per model/metric or
model pair), never on raw rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def ks_series_pvalue(n_ref: Column, n_cmp: Column, d: Column, terms: int = 100) -> Column:
    """Two-sided asymptotic KS p-value with the small-sample correction
    lambda = (sqrt(ne) + 0.12 + 0.11 / sqrt(ne)) * D, ne = n*m/(n+m).
    JVM-side: the series is an ``aggregate`` over ``sequence(1, terms)``."""
    ne = n_ref.cast("double") * n_cmp / (n_ref + n_cmp)
    lam = (F.sqrt(ne) + 0.12 + 0.11 / F.sqrt(ne)) * d
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, k: acc + F.pow(F.lit(-1.0), k - 1) * F.exp(-2.0 * k * k * lam * lam))
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(2.0 * series, F.lit(0.0)), F.lit(1.0)))


def _ks_exact_one(n: int, m: int, d: float) -> float:
    """P(D >= d) for two samples of sizes n, m.

    Probability that a uniformly random monotone lattice path from (0, 0) to
    (n, m) leaves the band |i/n - j/m| < d.  Works with step probabilities
    instead of path counts (no big integers) and only visits the band.
    """
    if n <= 0 or m <= 0:
        return float("nan")
    g = math.gcd(n, m)
    lcm = (n // g) * m
    h = int(round(d * lcm))
    if h == 0:
        return 1.0
    a, b = lcm // n, lcm // m          # i/n - j/m == (i*a - j*b) / lcm
    prob = np.zeros(m + 1)
    prob[0] = 1.0
    for j in range(1, m + 1):
        if j * b >= h:
            break
        prob[j] = prob[j - 1] * (m - j + 1) / (n + m - j + 1)
    for i in range(1, n + 1):
        lo = max(0, (i * a - h) // b + 1)
        hi = min(m, -((-(i * a + h)) // b) - 1)
        new = np.zeros(m + 1)
        if lo <= hi:
            js = np.arange(lo, hi + 1)
            new[lo:hi + 1] = prob[lo:hi + 1] * (n - i + 1) / (n + m - (i - 1) - js)
            for j in range(max(lo + 1, 1), hi + 1):
                new[j] += new[j - 1] * (m - j + 1) / (n + m - i - j + 1)
        prob = new
    return float(min(max(1.0 - prob[m], 0.0), 1.0))


@pandas_udf(DoubleType())
def ks_exact_pvalue(n: pd.Series, m: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([_ks_exact_one(int(a), int(b), float(c)) if a > 0 and b > 0 else float("nan")
                      for a, b, c in zip(n, m, d)], dtype="float64")


# ---- Student t tail via the regularised incomplete beta function ----------

def _betacf(a: float, b: float, x: float) -> float:
    max_iter, eps, fpmin = 300, 3e-16, 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > fpmin else fpmin)
    h = d
    for mm in range(1, max_iter + 1):
        m2 = 2 * mm
        aa = mm * (b - mm) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > fpmin else fpmin)
        c = 1.0 + aa / c
        c = c if abs(c) > fpmin else fpmin
        h *= d * c
        aa = -(a + mm) * (qab + mm) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > fpmin else fpmin)
        c = 1.0 + aa / c
        c = c if abs(c) > fpmin else fpmin
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < eps:
            break
    return h


def betainc_reg(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    ln_front = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                + a * math.log(x) + b * math.log1p(-x))
    front = math.exp(ln_front)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def t_two_sided_p(t: float, df: float) -> float:
    if t is None or df is None or not math.isfinite(df) or df <= 0 or math.isnan(t):
        return float("nan")
    if math.isinf(t):
        return 0.0
    return betainc_reg(df / 2.0, 0.5, df / (df + t * t))


@pandas_udf(DoubleType())
def student_t_two_sided_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided_p(a, b) if pd.notna(a) and pd.notna(b) else float("nan")
                      for a, b in zip(t, df)], dtype="float64")
