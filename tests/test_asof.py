"""As-of join and rolling means against plain loops; seasonal fit on simulated series."""
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.operators import seasonal
from vigil.operators.scan import asof_join, rolling_means
from conftest import ts

T0 = ts("2024-01-01 00:00:00")


def minutes(n):
    return None if n is None else T0 + dt.timedelta(minutes=n)


def tables(spark, seed, n_left, n_right, span):
    r = random.Random(seed)
    keys = ["hot", "hot", "hot", "b", "c", None]
    left = [(r.choice(keys), r.choice([None] + [r.randrange(span)] * 9), i) for i in range(n_left)]
    right = [(r.choice(keys), r.choice([None] + [r.randrange(span)] * 9), r.choice([None, i]), i) for i in range(n_right)]
    ldf = spark.createDataFrame([(k, minutes(t), i) for k, t, i in left], "k string, t timestamp_ntz, i int")
    rdf = spark.createDataFrame([(k, minutes(t), v, o) for k, t, v, o in right], "k string, at timestamp_ntz, v int, o int")
    return left, right, ldf.repartition(7), rdf.repartition(5)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("limit", [None, 45])
def test_asof_against_loops(spark, strict, limit):
    left, right, ldf, rdf = tables(spark, 1, 300, 200, 600)
    want = []
    for k, t, i in left:
        hits = [x for x in right if k is not None and t is not None and x[0] == k and x[1] is not None and (x[1] < t if strict else x[1] <= t)]
        best = max(hits, key=lambda x: (x[1], x[3]), default=None)
        if best and limit is not None and t - best[1] > limit:
            best = None
        want.append((i, minutes(best[1]) if best else None, best[2] if best else None))
    out = asof_join(ldf, rdf, ["k"], "t", "at", ["v"], ties=["o"], strict=strict, within_seconds=None if limit is None else limit * 60, prefix="r_")
    assert out.columns == ["k", "t", "i", "r_at", "r_v"]
    assert sorted(map(repr, (tuple(x) for x in out.select("i", "r_at", "r_v").collect()))) == sorted(map(repr, want))


def test_asof_splits_a_hot_key(spark):
    """One key with all rows: windows run per (key, hour), nothing is broadcast by hint or crossed."""
    l = spark.range(20000).selectExpr("'k' AS k", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id * 13) AS t", "id AS i")
    r = spark.range(5000).selectExpr("'k' AS k", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id * 50) AS at", "id AS v")
    out = asof_join(l, r, ["k"], "t", "at", ["v"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_chunk" in plan and "Cross" not in plan
    assert out.where("v <> least(4999, (i * 13) div 50)").count() == 0 and out.count() == 20000


def test_asof_empty_sides(spark):
    _, _, ldf, rdf = tables(spark, 2, 20, 20, 50)
    assert asof_join(ldf, rdf.where("false"), ["k"], "t", "at", ["v"]).where("v is not null or at is not null").count() == 0
    assert asof_join(ldf.where("false"), rdf, ["k"], "t", "at", ["v"]).count() == 0


def test_rolling_means_against_loops(spark):
    r = random.Random(5)
    data = [(r.choice("ab"), r.randrange(20 * 1440), r.choice([None, round(r.uniform(0, 1000), 2)])) for _ in range(1500)]
    df = spark.createDataFrame([(k, minutes(t) + dt.timedelta(seconds=r.randrange(60)), v) for k, t, v in data], "k string, time timestamp_ntz, v double")
    out = {(x.k, x.bucket): x.m for x in rolling_means(df, ["k"], "time", "v", 7 * 86400, out="m").collect()}
    assert out.keys() == {(k, minutes(t)) for k, t, _ in data}
    for k, t, _ in data:
        past = [v for k2, t2, v in data if k2 == k and t - 7 * 1440 <= t2 < t and v is not None]
        got = out[k, minutes(t)]
        assert got is None if not past else got == pytest.approx(sum(past) / len(past), rel=1e-12)


# ----------------------------------------------------------------- seasonal --

STEP = 900.0


def series(rng, n, slope_at=(), noise=0.02, level=10.0):
    t = np.arange(n) * STEP
    x = t / t[-1]
    trend = level + 2.0 * x + sum(d * np.maximum(x - a, 0) for a, d in slope_at)
    season = 1 + 0.1 * np.sin(2 * np.pi * t / 86400)
    return t, trend * season + rng.normal(0, noise * level, n)


def test_recovers_planted_changepoints():
    """In place, and in size up to what the prior shrinks."""
    rng = np.random.default_rng(1)
    cps = np.linspace(0, 0.8, 27)[1:-1]
    planted = {cps[5]: 25.0, cps[15]: -40.0}
    t, y = series(rng, 1344, planted.items(), noise=0.01)
    fit = seasonal.Fit(t, y)
    rates = fit.rates * fit.scale
    near = {a: sum(rates[j] for j in range(len(cps)) if abs(cps[j] - a) <= 0.035) for a in planted}
    assert near[cps[5]] == pytest.approx(25, rel=0.25) and near[cps[15]] == pytest.approx(-40, rel=0.25)
    rest = [abs(rates[j]) for j in range(len(cps)) if all(abs(cps[j] - a) > 0.035 for a in planted)]
    assert max(rest) < 3.0


def test_few_changes_without_changepoints():
    rng = np.random.default_rng(2)
    t, y = series(rng, 1344)
    fit = seasonal.Fit(t, y)
    assert np.sum(np.abs(fit.rates * fit.scale) > 1.0) <= 2


def test_band_covers_95_percent():
    rng = np.random.default_rng(3)
    hit = total = 0
    for k in range(60):
        t, y = series(rng, 1344 + 24, noise=0.03)
        fit = seasonal.Fit(t[:1344], y[:1344])
        _, lo, hi = fit.predict(t[1344:], np.random.default_rng(k))
        hit += int(((y[1344:] >= lo) & (y[1344:] <= hi)).sum())
        total += 24
    assert 0.93 <= hit / total <= 0.97


def test_same_series_same_band():
    ds = np.datetime64("2024-01-01T00:00:00", "us") + (np.arange(700) * 900_000_000).astype("timedelta64[us]")
    y = np.random.default_rng(4).normal(5, 1, 700)
    a, b, c = (seasonal.fit_predict(ds, y, 24, name=n) for n in ("x", "x", "y"))
    assert all((u == v).all() for u, v in zip(a, b)) and (a[2] != c[2]).any() and (a[1] == c[1]).all()
    assert (a[2] < a[1]).all() and (a[1] < a[3]).all()
