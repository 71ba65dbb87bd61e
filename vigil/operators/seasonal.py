"""Seasonal saturation forecast.

A decomposable model in the style of Taylor & Letham (2018): piecewise
linear trend with changepoints over the first 80 % of the history, daily
and weekly Fourier seasonality, multiplicative form
``y = trend * (1 + seasonal)``.  The fit is the posterior mode under a Laplace
prior on the rate changes (so few of them are large) and normal priors on the
rest; the absolute values are minimised by reweighted least squares.  The 95 %
band is simulated: future rate changes come as often as in the history, with
the fitted changes' mean size, and every path carries the residual noise.  The
stream of random numbers is seeded by the series' name.  The model follows the
published one; it does not reproduce any library's digits.

Each (model, metric) series holds at most 14 days of 15-minute buckets
(1344 points), so one ``applyInPandas`` group is bounded by construction.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT_SCHEMA = T.StructType([
    T.StructField("model_name", T.StringType()), T.StructField("metric", T.StringType()),
    T.StructField("step", T.IntegerType()), T.StructField("ds", T.TimestampNTZType()),
    T.StructField("yhat", T.DoubleType()), T.StructField("yhat_lower", T.DoubleType()),
    T.StructField("yhat_upper", T.DoubleType()),
])

N_CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
CHANGEPOINT_PRIOR = 0.05
SEASONALITY_PRIOR = 10.0
TREND_PRIOR = 5.0
DAILY_ORDER, WEEKLY_ORDER = 4, 3
INTERVAL = 0.95
PATHS = 1000                    # simulated futures
ROUNDS, SMALLEST = 40, 1e-6     # reweighting rounds; a rate change below this counts as 0


def _fourier(t_days: np.ndarray, period: float, order: int) -> np.ndarray:
    cols = []
    for k in range(1, order + 1):
        arg = 2.0 * np.pi * k * t_days / period
        cols += [np.sin(arg), np.cos(arg)]
    return np.column_stack(cols)


def _solve(X: np.ndarray, y: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    return np.linalg.solve(X.T @ X + np.diag(penalty), X.T @ y)


class Fit:
    """Posterior mode of one series; times are scaled to [0, 1], values by their
    largest magnitude."""

    def __init__(self, t_sec: np.ndarray, y: np.ndarray):
        self.span = max(float(t_sec[-1]), 1.0)
        self.scale = max(float(np.max(np.abs(y))), 1e-9)
        n = min(N_CHANGEPOINTS, max(len(y) - 2, 0))
        self.at = np.linspace(0, CHANGEPOINT_RANGE, n + 2)[1:-1] if n > 0 else np.array([])
        t, ys = t_sec / self.span, y / self.scale
        Xt, Xs = self.trend_design(t), self.season_design(t_sec)
        self.season = np.zeros(Xs.shape[1])
        self.trend = np.zeros(Xt.shape[1])
        sigma2, rates = float(np.var(ys)) + 1e-12, np.full(n, CHANGEPOINT_PRIOR)
        for _ in range(ROUNDS):
            # |d| is bounded by d^2 / (2 |d0|) + |d0| / 2 around the last round's d0;
            # trend and season are solved together, the product linearised around the last round
            pen = np.concatenate([np.full(2, sigma2 / TREND_PRIOR**2), sigma2 / (CHANGEPOINT_PRIOR * np.maximum(np.abs(rates), SMALLEST)),
                                  np.full(Xs.shape[1], sigma2 / SEASONALITY_PRIOR**2)])
            base, factor = Xt @ self.trend, 1.0 + Xs @ self.season
            J = np.column_stack([Xt * factor[:, None], Xs * base[:, None]])
            beta = _solve(J, ys - base * factor + J @ np.concatenate([self.trend, self.season]), pen)
            self.trend, self.season = beta[:Xt.shape[1]], beta[Xt.shape[1]:]
            rates = self.trend[2:]
            sigma2 = float(np.mean((ys - (Xt @ self.trend) * (1.0 + Xs @ self.season)) ** 2)) + 1e-12
        self.rates, self.sigma = rates, float(np.sqrt(sigma2))

    def trend_design(self, t: np.ndarray) -> np.ndarray:
        hinge = np.maximum(t[:, None] - self.at[None, :], 0.0) if len(self.at) else np.zeros((len(t), 0))
        return np.column_stack([np.ones_like(t), t, hinge])

    @staticmethod
    def season_design(t_sec: np.ndarray) -> np.ndarray:
        days = t_sec / 86400.0
        return np.column_stack([_fourier(days, 1.0, DAILY_ORDER), _fourier(days, 7.0, WEEKLY_ORDER)])

    def predict(self, t_sec: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(mean, lower, upper) at times after the history."""
        t = t_sec / self.span
        trend, season = self.trend_design(t) @ self.trend, 1.0 + self.season_design(t_sec) @ self.season
        ahead = max(float(t[-1]) - 1.0, 0.0)
        per_unit = len(self.at) / CHANGEPOINT_RANGE                  # changepoints a unit of time, as in the history
        size = float(np.mean(np.abs(self.rates))) + 1e-8 if len(self.rates) else 0.0
        paths = np.repeat(trend[None, :], PATHS, axis=0)
        if size > 0 and ahead > 0:
            count = rng.poisson(per_unit * ahead, PATHS)
            path = np.repeat(np.arange(PATHS), count)
            when, change = 1.0 + ahead * rng.random(len(path)), rng.laplace(0.0, size, len(path))
            np.add.at(paths, path, change[:, None] * np.maximum(t[None, :] - when[:, None], 0.0))
        paths = paths * season + rng.normal(0.0, self.sigma, paths.shape)
        lo, hi = np.quantile(paths, [(1 - INTERVAL) / 2, (1 + INTERVAL) / 2], axis=0)
        return trend * season * self.scale, lo * self.scale, hi * self.scale


def fit_predict(ds: np.ndarray, y: np.ndarray, horizon_steps: int, step_s: float = 900.0, name: str = ""):
    """ds: datetime64[us] sorted, y: float.  Returns (future ds, yhat, lo, hi)."""
    t_sec = (ds - ds[0]).astype("timedelta64[us]").astype(np.int64) / 1e6
    rng = np.random.default_rng(int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "little"))
    ahead = step_s * np.arange(1, horizon_steps + 1)
    fut_ds = ds[-1] + (ahead * 1e6).astype("timedelta64[us]")
    return (fut_ds, *Fit(t_sec, y).predict(t_sec[-1] + ahead, rng))


def _group_fn(horizon_steps: int):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bucket")
        ds = pdf["bucket"].to_numpy(dtype="datetime64[us]")
        y = pdf["y"].to_numpy(dtype=float)
        ok = np.isfinite(y)
        model, metric = pdf["model_name"].iloc[0], pdf["metric"].iloc[0]
        fut, yhat, lo, hi = fit_predict(ds[ok], y[ok], horizon_steps, name=f"{model}\n{metric}")
        return pd.DataFrame({"model_name": model, "metric": metric,
                             "step": np.arange(1, horizon_steps + 1, dtype=np.int32), "ds": fut,
                             "yhat": yhat, "yhat_lower": lo, "yhat_upper": hi})
    return fn


def seasonal_points(series: DataFrame, keys: DataFrame, horizon_hours: int) -> DataFrame:
    """Points for the (model, metric) series listed in ``keys``."""
    s = series.join(keys, ["model_name", "metric"], "left_semi")
    return s.groupBy("model_name", "metric").applyInPandas(_group_fn(int(horizon_hours) * 4), POINT_SCHEMA)
