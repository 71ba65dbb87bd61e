"""Balanced ordered scans equal their single-window definitions."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from vigil.operators.scan import (CHUNK, exact_quantiles, last_non_null_before, row_numbers,
                                  running_sums, value_chunks, with_chunk)


def _skewed(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", "c"], n))
    t = rng.integers(0, 10_000, n)
    v = np.where(rng.random(n) < 0.2, np.nan, rng.normal(size=n).round(2))
    pdf = pd.DataFrame({"k": key, "t": t.astype("int64"), "id": np.arange(n, dtype="int64"), "v": v})
    df = spark.createDataFrame(pdf).withColumn("v", F.when(F.isnan("v"), None).otherwise(F.col("v")))
    return pdf, df


def test_row_numbers_match_window(spark):
    pdf, df = _skewed(spark)
    got = row_numbers(with_chunk(df, (F.col("t") / 700).cast("int")), ["k"], ["t", "id"]).toPandas()
    exp = pdf.sort_values(["k", "t", "id"]).assign(rn=lambda d: d.groupby("k").cumcount() + 1)
    m = got.merge(exp[["id", "rn"]], on="id", suffixes=("", "_e"))
    assert len(m) == len(pdf) and (m["rn"] == m["rn_e"]).all()


def test_running_sums_with_totals(spark):
    pdf, df = _skewed(spark)
    x = df.withColumn("one", F.lit(1))
    got = running_sums(with_chunk(x, (F.col("t") / 1000).cast("int")), ["k"], ["t", "id"], ["one"],
                       totals_prefix="tot_").toPandas()
    sizes = pdf.groupby("k").size()
    assert (got["tot_one"] == got["k"].map(sizes)).all()
    assert got.groupby("k")["cum_one"].max().equals(sizes.rename("cum_one").astype(got["cum_one"].dtype))


def test_last_non_null_before(spark):
    pdf, df = _skewed(spark)
    got = last_non_null_before(with_chunk(df, (F.col("t") / 500).cast("int")), ["k"], ["t", "id"], ["v"]).toPandas()
    exp = pdf.sort_values(["k", "t", "id"]).copy()
    exp["prev"] = exp.groupby("k")["v"].transform(lambda s: s.ffill().shift(1))
    m = got.merge(exp[["id", "prev"]], on="id")
    assert np.allclose(m["prev_v"].astype(float), m["prev"].astype(float), equal_nan=True)


def test_value_chunks_order_preserving(spark):
    pdf, df = _skewed(spark)
    got = value_chunks(df.where(F.col("v").isNotNull()), ["k"], "v", 8).toPandas()
    assert len(got) == pdf["v"].notna().sum()
    for _, g in got.groupby("k"):
        g = g.sort_values("v")
        assert (np.diff(g[CHUNK].to_numpy()) >= 0).all()


def test_exact_quantiles_equal_numpy(spark):
    pdf, df = _skewed(spark)
    probs = [0.0, 0.05, 0.5, 0.95, 0.99, 1.0]
    got = exact_quantiles(df, ["k"], "v", probs, n_chunks=8).toPandas().set_index("k")
    for k, g in pdf.dropna().groupby("k"):
        assert np.allclose(got.loc[k, "q"], np.percentile(g["v"], [p * 100 for p in probs]), rtol=0, atol=1e-12)
        assert got.loc[k, "n"] == len(g)
