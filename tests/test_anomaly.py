"""Isolation forest invariants (the RNG differs from any other implementation)."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from conftest import fact_rows, ts
from vigil.operators import anomaly as A


def _train(spark, n=600, seed=7):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({
        "model_name": "m", "model_type": "llm", "row_id": np.arange(n, dtype="int64"),
        "f0": rng.normal(100, 5, n), "f1": rng.normal(50, 3, n), "f2": rng.normal(40, 2, n),
        "f3": rng.normal(5, 1, n)})
    return spark.createDataFrame(pdf)


def test_forest_flags_contamination_and_outlier(spark):
    tr = _train(spark)
    base = A.baselines(tr)
    nodes = A.build_forest(tr, base, n_trees=50).cache()
    assert nodes.select("tree").distinct().count() == 50
    leaves = nodes.where(F.col("feature") < 0)
    assert leaves.where(F.col("path") > 8 + A.avg_path_length([256])[0]).count() == 0  # depth <= 8, plus c(n)
    scores = A.score_rows(tr, base, nodes, bucket_rows=97).toPandas()  # many buckets per model
    assert len(scores) == 600 and scores["row_id"].is_unique
    off = np.percentile(scores["score"], 5)
    frac = float((scores["score"] - off < 0).mean())
    assert 0.03 <= frac <= 0.07
    far = spark.createDataFrame([("m", 10_000, 500.0, 0.0, 0.0, 50.0)],
                                "model_name string, row_id long, f0 double, f1 double, f2 double, f3 double")
    s_far = A.score_rows(far, base, nodes).collect()[0].score
    assert s_far < scores["score"].min()


def test_scores_do_not_depend_on_row_order_or_bucketing(spark):
    tr = _train(spark, n=300)
    base = A.baselines(tr)
    nodes = A.build_forest(tr, base, n_trees=20).cache()
    a = A.score_rows(tr, base, nodes, bucket_rows=1000).toPandas().sort_values("row_id")
    b = A.score_rows(tr.orderBy(F.rand(1)), base, nodes, bucket_rows=37).toPandas().sort_values("row_id")
    assert np.allclose(a["score"].to_numpy(), b["score"].to_numpy())


def test_sample_sizes(spark):
    tr = _train(spark, n=2000)
    base = A.baselines(tr)
    s = A.sample_for_trees(tr, base, n_trees=10, sample=256).groupBy("tree").count().collect()
    assert len(s) == 10 and all(r["count"] == 256 for r in s)
    small = _train(spark, n=40)
    s2 = A.sample_for_trees(small, A.baselines(small), n_trees=3).groupBy("tree").count().collect()
    assert all(r["count"] == 40 for r in s2)


def test_large_model_sampling_is_uniform_and_complete(spark):
    # one scheme at every size: each tree draws on its own, without replacement
    tr = _train(spark, n=5000)
    base = A.baselines(tr)
    s = A.sample_for_trees(tr, base, n_trees=5, sample=256).toPandas()
    counts = s.groupby("tree").size()
    assert list(counts.index) == [0, 1, 2, 3, 4] and (counts == 256).all()
    assert all(g["row_id"].is_unique for _, g in s.groupby("tree"))
    assert 1500 < s["row_id"].mean() < 3500            # no bias towards low/high ids


def test_avg_path_length():
    assert list(A.avg_path_length([0, 1, 2])) == [0.0, 0.0, 1.0]
    n = 256
    assert abs(A.avg_path_length([n])[0] - (2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n)) < 1e-9


def test_zscore_cold_start_option(spark):
    tr = _train(spark, n=400)
    stats = A.baselines(tr)
    vec = spark.createDataFrame([
        ("m", "llm", "2024-01-30 00:00:00", 100.0, 50.0, 40.0, 5.0),     # typical
        ("m", "llm", "2024-01-30 00:01:00", 100.0, 50.0, 40.0, 10.0),    # ~5 sigma on queue
    ], "model_name string, model_type string, bucket string, f0 double, f1 double, f2 double, f3 double"
    ).withColumn("bucket", F.to_timestamp_ntz("bucket"))
    ev = {str(r.computed_at): r for r in A.zscore_events(vec, stats).collect()}
    calm, hot = ev["2024-01-30 00:01:00"], ev["2024-01-30 00:02:00"]
    assert calm.is_anomaly is False and calm.anomaly_score > -0.05
    assert hot.is_anomaly is True and hot.anomaly_score < -0.1 and hot.dims[0].feature == "requests_waiting"


def test_score_windows_zscore_for_untrained_models(spark):
    from conftest import fact_rows, ts
    rows = [{"time": ts(f"2024-01-30 0{i // 60}:{i % 60:02d}:00"), "seq": i, "model_name": "big" if i % 4 else "tiny",
             "model_type": "llm", "latency_p95_ms": 100.0 + i % 7, "gpu_util_pct": 50.0 + i % 5,
             "kv_cache_usage_pct": 40.0 + i % 3, "requests_waiting": i % 6} for i in range(300)]
    tel = fact_rows(spark, rows, extra_cols=["throughput_rps"])
    tr = A.training_rows(tel, "2024-01-31 00:00:00")
    stats = A.baselines(tr)
    big_only = tr.where(F.col("model_name") == "big")
    mb, nodes = A.train(big_only.select("model_name").distinct().join(tel, "model_name"), "2024-01-31 00:00:00",
                        n_trees=10)
    ev = A.score_windows(tel, mb, nodes, cold_start="zscore", stats=stats).toPandas()
    assert set(ev["model_name"]) == {"big", "tiny"}
    assert not ev[ev["model_name"] == "big"]["cold_start_mode"].any()
    tiny = ev[ev["model_name"] == "tiny"]
    assert tiny["cold_start_mode"].all() and (tiny["anomaly_score"] != -0.1).any()


def test_training_rows_are_scored_once(spark, monkeypatch):
    seen, score = spark.sparkContext.accumulator(0), A.score_rows

    def counted(*a, **k):
        out = score(*a, **k)

        def fn(batches):
            for pdf in batches:
                seen.add(len(pdf))
                yield pdf
        return out.mapInPandas(fn, out.schema)
    monkeypatch.setattr(A, "score_rows", counted)
    rng = np.random.default_rng(3)
    rows = [dict(time=ts("2024-01-02 00:00:00"), seq=i, model_name="m", model_type="llm", latency_p95_ms=float(x), ttft_p95_ms=1.0,
                 kv_cache_usage_pct=2.0, requests_waiting=3) for i, x in enumerate(rng.normal(100, 5, 200))]
    base, nodes = A.train(fact_rows(spark, rows, ["throughput_rps", "avg_prompt_tokens", "avg_completion_tokens"]), "2024-01-03 00:00:00", n_trees=5)
    assert base.count() == 1 and nodes.count() > 0 and seen.value == 200


def test_walk_of_trees_of_uneven_depth():
    rng = np.random.default_rng(5)
    Z = rng.normal(size=(64, 4))
    Z[0] = Z[0, 0]
    rows = [r for t in range(3) for r in A._grow("m", t, Z[:2 ** t * 4], 1)] + A._grow("m", 3, Z[:1], 1)
    nodes = pd.DataFrame(rows, columns=[f.name for f in A.NODE_SCHEMA.fields])
    Z[5, 2] = np.nan                       # a comparison with NaN leads to the right
    exp = np.zeros(len(Z))
    for _, t in nodes.groupby("tree"):
        t = t.set_index("node")
        for i, z in enumerate(Z):
            n = 0
            while t.feature[n] >= 0:
                n = t.left[n] if z[t.feature[n]] <= t.threshold[n] else t.right[n]
            exp[i] += t.path[n]
    assert np.array_equal(A._walk(nodes.sample(frac=1.0, random_state=2).sort_values("tree", kind="stable"), Z), exp)
