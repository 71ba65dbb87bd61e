"""Public tool API and file readers."""
import json

import pytest
import os
import tempfile

from pyspark.sql import functions as F

from vigil import api
from vigil.operators.forecast import snapshot_rows, forecast
from vigil.plans import catalog as C
from vigil.sources.readers import read_external_alerts, read_pod_documents, read_registry
from conftest import SF0001


def test_tools_run(spark):
    tel = C.telemetry(spark, SF0001)
    ev = C.events(tel)
    h = api.get_model_health(tel, ev, C.stored_drift(spark, SF0001), C.AS_OF, model_name="click", time_window="24h")
    assert [r.model_name for r in h.collect()] == ["click"]
    c = api.compare_models(tel, C.AS_OF, "click", "view").collect()[0]
    assert c.model_a == "click" and c.summary
    snap, pts = api.predict_saturation(tel, C.AS_OF, "click", "requests_waiting", horizon_hours=9, method="linear")
    assert pts.agg(F.max("step")).collect()[0][0] == 24           # horizon clamped to 6 h
    assert snap.collect()[0].recommendation
    d = api.detect_drift(tel, C.AS_OF, "view", "latency", "30d", "10d").collect()[0]
    assert d.interpretation and d.status == "ok"
    rows = snapshot_rows(*forecast(tel, C.AS_OF, ["requests_waiting"])).collect()
    assert all(len(r.points) == 24 for r in rows)


def test_readers(spark):
    d = tempfile.mkdtemp(prefix="vigil-readers-")
    with open(os.path.join(d, "registry.json"), "w") as f:
        json.dump([{"name": "a", "model_type": "llm", "gpu_node_selector": "n1"},
                   {"name": "b", "model_type": "tts", "tts_tokens_per_second_of_audio": 86.0}], f)
    reg = read_registry(spark, os.path.join(d, "registry.json")).orderBy("ord").collect()
    assert [r.name for r in reg] == ["a", "b"] and reg[1].tts_tokens_per_second == 86.0
    with open(os.path.join(d, "pods.json"), "w") as f:
        json.dump({"items": [{"metadata": {"name": "a-0"}, "containers": [
            {"name": "c", "usage": {"cpu": "250m", "memory": "1Mi"}}]}]}, f)
    p = read_pod_documents(spark, os.path.join(d, "pods.json")).collect()
    assert p[0].pod == "a-0" and p[0].containers[0].cpu == "250m"
    assert read_external_alerts(spark, os.path.join(d, "missing.json")).count() == 0


def test_fact_append_scrape_files_and_token_rtf(spark):
    from vigil.operators.counters import counter_deltas, rtf_from_tokens
    from vigil.sources.readers import read_scrape_texts
    from vigil.sources.sinks import append_fact_rows
    from vigil.sources.exposition import parse_samples
    from conftest import fact_rows, ts
    d = tempfile.mkdtemp(prefix="vigil-fact-")
    rows = [{"time": ts("2024-01-30 00:00:00"), "seq": 1, "model_name": "t", "model_type": "tts",
             "generation_tokens_total": 100},
            {"time": ts("2024-01-30 00:00:15"), "seq": 2, "model_name": "t", "model_type": "tts",
             "generation_tokens_total": 1390}]
    append_fact_rows(fact_rows(spark, rows[:1]), d)
    append_fact_rows(fact_rows(spark, rows[1:]), d)
    back = spark.read.parquet(d)
    assert back.count() == 2 and "date" in back.columns
    x = counter_deltas(back.drop("date"), ["generation_tokens_total"])
    r = x.select("seq", rtf_from_tokens(x, 86.0).alias("rtf")).orderBy("seq").collect()
    assert r[0].rtf is None and r[1].rtf == pytest.approx(1290 / 86.0 / 15.0)
    sd = tempfile.mkdtemp(prefix="vigil-scrapes-")
    for i in range(3):
        with open(os.path.join(sd, f"scrape{i}.txt"), "w") as f:
            f.write(f"# TYPE up gauge\nup{{job=\"x\"}} {i}\n")
    s = parse_samples(read_scrape_texts(spark, sd))
    assert sorted(r.value for r in s.collect()) == [0.0, 1.0, 2.0]
