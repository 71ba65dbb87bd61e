"""Result tables, per-day state, caches, ledger and isolation."""
import datetime as dt
import os
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigil.operators import anomaly as A
from vigil.operators import guard
from vigil.operators.daystate import DayState
from vigil.operators.drift import drift_scan
from vigil.operators.forecast import bucket_series, forecast
from vigil.operators.ledger import RunLedger, grid
from vigil.plans import catalog as C
from vigil.sources.tablestore import ConcurrentChange, Table, data_stamp
from vigil.store import ResultStore
from conftest import SF0001, fact_rows, ts


@pytest.fixture
def root():
    return tempfile.mkdtemp(prefix="vigil-table-")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def snap(spark, data):
    return spark.createDataFrame([(k, dt.date.fromisoformat(d), ts(t), v) for k, d, t, v in data], "k string, day date, computed_at timestamp_ntz, v int")


# ---------------------------------------------------------------- tables --

def test_upsert_rewrites_touched_partitions_only(spark, root):
    t = Table(spark, root, "day")
    t.append(snap(spark, [("a", "2024-01-01", "2024-01-01 01:00:00", 1), ("b", "2024-01-02", "2024-01-02 01:00:00", 2), ("a", "2024-01-02", "2024-01-02 01:00:00", 3)]))
    before = t.parts()
    new = snap(spark, [("a", "2024-01-02", "2024-01-02 02:00:00", 30), ("b", "2024-01-02", "2024-01-02 00:00:00", 20), ("c", "2024-01-03", "2024-01-03 00:00:00", 4)])
    assert t.upsert(new, ["k", "day"]) == ["2024-01-02", "2024-01-03"]
    after = t.parts()
    assert after["2024-01-01"] == before["2024-01-01"] and after["2024-01-02"] != before["2024-01-02"]
    want = sorted([("a", 1), ("b", 2), ("a", 30), ("c", 4)])
    assert rows(t.read().select("k", "v")) == want
    t.upsert(new, ["k", "day"])                                     # repeated: the same table
    assert rows(t.read().select("k", "v")) == want
    assert rows(t.read(["2024-01-02"]).select("k", "v")) == [("a", 30), ("b", 2)]


def test_retention_append_compact_vacuum(spark, root):
    t = Table(spark, root, "day")
    for i in range(4):
        t.append(snap(spark, [("a", f"2024-01-0{1 + i % 2}", "2024-01-01 00:00:00", i)]))
    t.append(snap(spark, [("n", "2024-01-01", "2024-01-01 00:00:00", 9)]).withColumn("day", F.lit(None).cast("date")))
    assert {v: len(p) for v, p in t.parts().items()} == {"2024-01-01": 2, "2024-01-02": 2, "__HIVE_DEFAULT_PARTITION__": 1}
    keep = t.parts()["2024-01-02"]
    assert t.drop_before("2024-01-02") == ["2024-01-01"] and t.parts()["2024-01-02"] == keep
    assert t.compact(1) == ["2024-01-02"] and len(t.parts()["2024-01-02"]) == 1
    assert rows(t.read().select("k", "v")) == [("a", 1), ("a", 3), ("n", 9)]
    assert t.vacuum() == 4 and rows(t.read().select("k", "v")) == [("a", 1), ("a", 3), ("n", 9)]
    assert t.drop_before("2024-01-02") == []


def test_half_written_manifest_never_happened(spark, root):
    t = Table(spark, root, "day")
    t.append(snap(spark, [("a", "2024-01-01", "2024-01-01 00:00:00", 1)]))
    with open(f"{root}/_manifest/{2:020d}.json", "w") as f:
        f.write('{"schema": {"ty')
    assert rows(t.read().select("k", "v")) == [("a", 1)]
    t.append(snap(spark, [("b", "2024-01-02", "2024-01-01 00:00:00", 2)]))
    assert rows(t.read().select("k", "v")) == [("a", 1), ("b", 2)]


def test_writers_that_meet(spark, root):
    a, b = Table(spark, root, "day"), Table(spark, root, "day")
    a.append(snap(spark, [("a", "2024-01-01", "2024-01-01 00:00:00", 1)]))
    real = a._write

    def slow(df):
        out = real(df)
        b.append(snap(spark, [("x", other, "2024-01-01 00:00:00", 7)]))
        return out
    a._write = slow
    other = "2024-01-05"                                            # another partition: both changes stay
    a.upsert(snap(spark, [("a", "2024-01-01", "2024-01-02 00:00:00", 2)]), ["k", "day"])
    assert rows(a.read().select("k", "v")) == [("a", 2), ("x", 7)]
    other = "2024-01-01"                                            # the same one: the upsert must be run again
    with pytest.raises(ConcurrentChange):
        a.upsert(snap(spark, [("a", "2024-01-01", "2024-01-03 00:00:00", 3)]), ["k", "day"])
    a._write = real
    a.upsert(snap(spark, [("a", "2024-01-01", "2024-01-03 00:00:00", 3)]), ["k", "day"])
    assert rows(a.read().select("k", "v")) == [("a", 3), ("x", 7), ("x", 7)] or rows(a.read().select("k", "v")) == [("a", 3), ("x", 7)]


def test_other_columns_are_refused(spark, root):
    t = Table(spark, root, "day")
    t.append(snap(spark, [("a", "2024-01-01", "2024-01-01 00:00:00", 1)]))
    with pytest.raises(ValueError, match="other columns"):
        t.append(snap(spark, [("a", "2024-01-01", "2024-01-01 00:00:00", 1)]).drop("v"))
    with pytest.raises(FileNotFoundError):
        Table(spark, root + "/none", "day").read()


def test_stamp_follows_the_data(spark, root):
    spark.range(3).write.mode("append").parquet(root)
    a = data_stamp(spark, root)
    assert a == data_stamp(spark, root)
    spark.range(3).write.mode("append").parquet(root)
    assert a != data_stamp(spark, root)


# ------------------------------------------------------------ day state --

WINDOWS = [("2024-01-31 00:00:00", "30d", "10d"), ("2024-01-30 13:37:00", "20d", "36h"), ("2024-01-30 13:37:00", "5h", "2h"), ("2024-01-29 00:00:01", "7d", "1d")]


@pytest.mark.parametrize("window", WINDOWS)
def test_drift_from_state_equals_scan(spark, root, window):
    tel = C.telemetry(spark, SF0001)
    state = DayState(spark, root)
    state.update(tel, "2024-01-15 12:00:00")
    state.update(tel, window[0])
    got, want = (sorted(map(repr, x.collect())) for x in (state.drift(tel, *window, p_method="series"), drift_scan(tel, *window, p_method="series")))
    assert got == want


def test_second_update_reads_one_day(spark, root):
    tel = C.telemetry(spark, SF0001)
    state = DayState(spark, root)
    days = state.update(tel, "2024-01-20 06:00:00")
    assert max(days) == dt.date(2024, 1, 19)
    kept = state.counts.parts()
    one = tel.where("date = '2024-01-20'")                          # nothing but the new day is there to read
    assert state.update(one, "2024-01-21 06:00:00") == [dt.date(2024, 1, 20)]
    assert {d: p for d, p in state.counts.parts().items() if d in kept} == kept
    assert state.update(tel, "2024-01-21 06:00:00") == []
    want = rows(tel.where("date = '2024-01-20' and rtf is not null").groupBy("model_name", "rtf").count())
    assert rows(state.counts.read(["2024-01-20"]).where("metric = 'rtf'").select("model_name", "v", "n")) == want
    assert state.update(tel, "2024-01-21 06:00:00", redo=[dt.date(2024, 1, 20)]) == [dt.date(2024, 1, 20)]
    assert rows(state.counts.read(["2024-01-20"]).where("metric = 'rtf'").select("model_name", "v", "n")) == want


def test_series_and_forecast_from_state(spark, root):
    tel = C.telemetry(spark, SF0001)
    state = DayState(spark, root)
    for as_of in ("2024-01-30 13:37:00", "2024-01-31 00:00:00"):
        state.update(tel, as_of)
        got, want = ({tuple(r)[:3]: r.y for r in x.select("model_name", "metric", "bucket", "y").collect()}
                     for x in (state.series(tel, as_of), bucket_series(tel, as_of)))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1e-12 * max(1, abs(want[k])) for k in got)
    snap_, _ = state.forecast(tel, "2024-01-31 00:00:00")
    plain, _ = forecast(tel, "2024-01-31 00:00:00")
    cols = ["model_name", "metric", "n_training_points", "saturation_time", "saturation_risk"]
    assert sorted(map(repr, snap_.select(cols).collect())) == sorted(map(repr, plain.select(cols).collect()))


# --------------------------------------------------------- stored results --

def test_drift_scores_and_cache(spark, root):
    tel, st = C.telemetry(spark, SF0001), ResultStore(spark, root)
    for as_of in ("2024-01-30 00:00:00", "2024-01-31 00:00:00", "2024-01-31 00:00:00"):
        st.run_drift(tel, as_of, "30d", "10d", p_method="series")
    assert st.drift().count() == 50 and st.drift("2024-01-30 12:00:00").count() == 25        # a repeated run counts once
    newest = st.newest_drift("2024-01-31 05:00:00", "30d", "10d")
    assert {r[0] for r in newest.select("computed_at").distinct().collect()} == {ts("2024-01-31 00:00:00")}
    scores = st.drift_scores.read()
    assert scores.count() == newest.where("status = 'ok'").count() and scores.select("computed_at").distinct().count() == 1
    files = st.drift_scores.parts()
    got = st.serve_drift(tel, "2024-01-31 00:05:00", "30d", "10d", p_method="series")
    ok = newest.where("status = 'ok'")
    served = got.where(F.col("computed_at") == F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))
    assert rows(served.select("model_name", "metric", "psi")) == rows(ok.select("model_name", "metric", "psi"))
    assert {v: p for v, p in st.drift_scores.parts().items() if v not in ("error",)}.keys() == files.keys() - {"error"}
    late = st.serve_drift(tel, "2024-01-31 00:30:00", "30d", "10d", metrics=["latency"], p_method="series")
    assert {r[0] for r in late.select("computed_at").distinct().collect()} == {ts("2024-01-31 00:30:00")}


def test_forecast_cache(spark, root):
    tel, st = C.telemetry(spark, SF0001), ResultStore(spark, root)
    first, pts = st.serve_forecast(tel, "2024-01-30 23:40:00", ["gpu_util_pct"], method="linear")
    assert first.count() == 5 and pts.groupBy("model_name").count().where("count <> 8").count() == 0
    n = len(st.forecasts.parts()["2024-01-30"])
    again, _ = st.serve_forecast(tel, "2024-01-30 23:59:00", ["gpu_util_pct"], method="linear")
    assert len(st.forecasts.parts()["2024-01-30"]) == n                          # nothing computed, nothing stored
    assert rows(again.select("model_name", "computed_at", "saturation_risk")) == rows(first.select("model_name", "computed_at", "saturation_risk"))
    later, _ = st.serve_forecast(tel, "2024-01-31 00:16:00", ["gpu_util_pct"], method="linear")
    assert {r[0] for r in later.select("computed_at").distinct().collect()} == {ts("2024-01-31 00:16:00")}
    plain, _ = forecast(tel, "2024-01-30 23:40:00", ["gpu_util_pct"], method="linear", requested_hours=2)
    cols = ["model_name", "metric", "saturation_time", "saturation_risk", "n_training_points", "saturation_within_horizon"]
    assert sorted(map(repr, first.select(cols).collect())) == sorted(map(repr, plain.select(cols).collect()))


def test_artifacts_and_retention(spark, root):
    tel, st = C.telemetry(spark, SF0001), ResultStore(spark, root)
    st.save_artifacts(*A.train(tel, "2024-01-31 00:00:00", n_trees=3))
    files = st.forests.parts()
    st.save_artifacts(*A.train(tel.where("model_name = 'view'"), "2024-01-31 12:00:00", n_trees=2))
    mb, nodes = st.load_artifacts()
    assert mb.count() == 5 and {r.model_name for r in mb.where("trained_at > timestamp_ntz'2024-01-31 06:00:00'").collect()} == {"view"}
    assert {m: p for m, p in st.forests.parts().items() if m != "view"} == {m: p for m, p in files.items() if m != "view"}
    assert {r.model_name: r.n for r in nodes.groupBy("model_name").agg(F.countDistinct("tree").alias("n")).collect()}["view"] == 2
    assert A.score_windows(tel, mb, nodes).where("cold_start_mode").count() == 0
    ev = spark.createDataFrame([(ts("2023-10-01 00:00:00"), "a"), (ts("2024-01-30 00:00:00"), "a")], "computed_at timestamp_ntz, model_name string")
    st.save_events(ev)
    assert st.retain("2024-01-31 00:00:00")["anomaly_events"] == ["2023-10-01"] and st.events.read().count() == 1


# ------------------------------------------------------------------ ledger --

def test_ledger_backfills_once(spark, root):
    points = grid("2024-01-01 00:00:00", "2024-01-01 00:20:00", 300)
    assert len(points) == 5
    log, done = RunLedger(spark, root), []

    def work(p):
        if p == points[2] and not fixed:
            raise ValueError("no data")
        done.append(p)
    fixed = False
    assert log.claim("drift", points[1]) == "0001"                      # somebody else is at it
    other = RunLedger(spark, root)
    assert other.run("drift", points, work) == [points[0], points[3], points[4]]
    st = {r.as_of: (r.status, r.attempts, r.error) for r in other.runs("drift").collect()}
    assert st[points[1]] == ("claimed", 1, None) and st[points[2]][0] == "failed" and "no data" in st[points[2]][2]
    fixed = True
    assert other.due("drift", points) == [points[1], points[2]]
    assert other.run("drift", points, work) == [points[2]]
    assert RunLedger(spark, root, lease_seconds=0).run("drift", points, work) == [points[1]]       # the claim expired
    assert other.run("drift", points, work) == [] and sorted(done) == points
    assert {r.status for r in other.runs("drift").collect()} == {"done"}
    assert other.runs("train").count() == 0


def test_killed_run_gives_the_same_tables_once(spark, root):
    tel, st = C.telemetry(spark, SF0001), ResultStore(spark, f"{root}/s")
    log = RunLedger(spark, f"{root}/l", lease_seconds=0)

    def killed(p):
        st.run_drift(tel, p, "30d", "10d", p_method="series")
        raise RuntimeError("killed before it was marked done")
    log.run("drift", ["2024-01-31 00:00:00"], killed)
    assert st.drift().count() == 25
    log.run("drift", ["2024-01-31 00:00:00"], lambda p: st.run_drift(tel, p, "30d", "10d", p_method="series") and None)
    assert st.drift().count() == 25 and st.drift_scores.read().count() == st.drift().where("status = 'ok'").count()


# --------------------------------------------------------------- isolation --

def test_guard_turns_errors_into_rows(spark):
    df = spark.createDataFrame([(m, float(i)) for m in "abc" for i in range(5)], "m string, x double")

    def fn(pdf):
        if pdf["m"].iloc[0] == "b":
            raise ZeroDivisionError("poison")
        return pd.DataFrame({"m": pdf["m"].iloc[:1], "s": [pdf["x"].sum()]})
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("m", T.StringType()), T.StructField("s", T.DoubleType())])
    out = df.groupBy("m").applyInPandas(guard.guarded(fn, schema, ["m"]), guard.with_error(schema)).cache()
    good, bad = guard.split(out, ["m"])
    assert rows(good) == [("a", 10.0), ("c", 10.0)]
    assert [(r.m, "poison" in r.error) for r in bad.collect()] == [("b", True)]


def test_poisoned_model_does_not_stop_the_others(spark):
    tel = C.telemetry(spark, SF0001)
    huge = F.when(F.col("seq") % 2 == 0, 1.5e308).otherwise(-1.5e308)
    bad = tel.withColumn("latency_p95_ms", F.when(F.col("model_name") == "error", huge).otherwise(F.col("latency_p95_ms")))
    mb, nodes, failed = A.train_isolated(bad, C.AS_OF, n_trees=3)
    assert [(r.model_name, "not finite" in r.error) for r in failed.collect()] == [("error", True)]
    plain, plain_nodes, none = A.train_isolated(tel, C.AS_OF, n_trees=3)
    assert none.count() == 0
    others = "model_name <> 'error'"
    assert sorted(map(repr, mb.collect())) == sorted(map(repr, plain.where(others).collect()))
    assert sorted(map(repr, nodes.collect())) == sorted(map(repr, plain_nodes.where(others).collect()))


# ------------------------------------------------------- forest sampling --

def _train_rows(spark, n, parts):
    df = spark.range(n).selectExpr("'m' AS model_name", "'llm' AS model_type", "id AS row_id", *[f"CAST((id * {k}) % 1009 AS DOUBLE) AS f{i}" for i, k in enumerate((7, 11, 13, 17))])
    return df.repartition(parts, "row_id") if parts > 1 else df.coalesce(1)


@pytest.mark.parametrize("n", [5, 255, 256, 257, 76_799, 76_801, 120_000])
def test_one_sampling_scheme_at_every_size(spark, n):
    out = []
    for parts in (1, 100):
        tr = _train_rows(spark, n, parts)
        s = A.sample_for_trees(tr, A.baselines(tr), n_trees=4)
        out.append(rows(s.select("tree", "ordinal", "row_id")))
    assert out[0] == out[1]
    by = {}
    for tree, ordinal, row in out[0]:
        by.setdefault(tree, []).append((ordinal, row))
    assert all(len(v) == len({r for _, r in v}) == min(256, n) for v in by.values()) and len(by) == 4
    if n > 256:
        assert len({tuple(v) for v in by.values()}) == 4
        mean = np.mean([r for v in by.values() for _, r in v]) / n
        assert 0.4 < mean < 0.6


def test_same_forest_however_partitioned(spark):
    a, b = (A.build_forest(t, A.baselines(t), n_trees=3) for t in (_train_rows(spark, 3000, 1), _train_rows(spark, 3000, 100)))
    a, b = ({(r.tree, r.node): (r.feature, r.left, r.right, r.threshold, r.path) for r in x.collect()} for x in (a, b))
    assert {k: v[:3] for k, v in a.items()} == {k: v[:3] for k, v in b.items()}
    assert all(a[k][3:] == pytest.approx(b[k][3:], rel=1e-9, abs=1e-9) for k in a)      # means are sums, whose order is not fixed


# ------------------------------------------------------------ tick folders --

def test_captured_files_give_one_row_per_model_and_tick(spark):
    import json
    from vigil.operators import ingest as I
    from vigil.sources import readers as R
    base = tempfile.mkdtemp(prefix="vigil-captures-")

    def put(path, text):
        os.makedirs(os.path.dirname(f"{base}/{path}"), exist_ok=True)
        with open(f"{base}/{path}", "w") as f:
            f.write(text)
    for k, sec in enumerate((0, 15, 30)):
        for m in ("chat", "tts-one"):
            put(f"model/{m}/20240101T0000{sec:02d}.txt", f'vllm:num_requests_waiting{{model_name="{m}"}} {k}\nvllm:request_success_total 5\n')
        if sec != 15:
            put(f"gpu/20240101T0000{sec + 2:02d}.txt", f'DCGM_FI_DEV_GPU_UTIL{{gpu="0",Hostname="node-1"}} {50 + k}\n')
        put(f"pods/20240101T0000{max(0, sec - 1):02d}.json", json.dumps({"items": [{"metadata": {"name": "ttsone-0"}, "containers": [
            {"name": "c", "usage": {"cpu": f"{100 + k}m", "memory": "1Mi"}}]}]}))
    put("settings.json", json.dumps({"collector": {"scrape_interval_seconds": 15}, "models": [
        {"name": "chat", "model_type": "llm", "gpu_node_selector": "node-1"}, {"name": "tts-one", "model_type": "tts", "tts_tokens_per_second_of_audio": 86}]}))
    settings = R.load_settings(f"{base}/settings.json", {"SCRAPE_INTERVAL": "30", "DCGM_ENDPOINT": "", "OTHER": "x"})
    assert settings["collector"] == {"scrape_interval_seconds": 30}
    reg = R.settings_registry(spark, settings)
    gpu, pods = R.read_gpu_texts(spark, f"{base}/gpu"), R.read_pod_documents(spark, f"{base}/pods")
    out = I.assemble_ticks(I.model_metrics(R.read_scrape_texts(spark, f"{base}/model"), reg), I.timed(I.gpu_metrics(gpu, reg), gpu),
                           I.timed(I.pod_usage(pods, reg), pods), 3)
    got = [(r.scrape_ts.second, r.model_name, r.model_type, r.requests_waiting, r.gpu_util_pct, r.pod_cpu_millicores)
           for r in out.orderBy("scrape_ts", "model_name").collect()]
    assert got == [(0, "chat", "llm", 0.0, 50.0, None), (0, "tts-one", "tts", 0.0, None, 100.0),
                   (15, "chat", "llm", 1.0, None, None), (15, "tts-one", "tts", 1.0, None, 101.0),
                   (30, "chat", "llm", 2.0, 52.0, None), (30, "tts-one", "tts", 2.0, None, 102.0)]


def test_yaml_settings(tmp_path):
    pytest.importorskip("yaml")
    from vigil.sources.readers import load_settings
    p = tmp_path / "c.yaml"
    p.write_text("collector:\n  dcgm_endpoint: a\nmodels:\n  - name: x\n")
    assert load_settings(str(p), {"DCGM_ENDPOINT": "b"}) == {"collector": {"dcgm_endpoint": "b"}, "models": [{"name": "x"}]}


def test_fact_rows_without_a_date_column(spark, root):
    df = fact_rows(spark, [{"time": ts(f"2024-01-0{1 + i % 3} 05:00:00"), "seq": i, "model_name": "m", "model_type": "llm", "latency_p95_ms": float(i)} for i in range(9)], ["throughput_rps"])
    assert DayState(spark, root).update(df, "2024-01-03 12:00:00") == [dt.date(2024, 1, 1), dt.date(2024, 1, 2)]
