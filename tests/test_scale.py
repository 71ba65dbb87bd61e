"""Figures that must not grow faster than the input: parses per line, rows per
task, readings of a parsed feed, files per date."""
import contextlib
import datetime as dt
import glob
import io

from pyspark.sql import functions as F

from vigil.operators import ingest as I
from vigil.operators.counters import with_rates
from vigil.plans import catalog as Q
from vigil.session import spread
from vigil.sources import captures as C
from vigil.sources.telemetry import telemetry_from_events

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _events(spark, n, seconds=600):
    kinds = ["click", "error", "purchase", "signup", "view"]
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, t0 + dt.timedelta(seconds=seconds * i), i % 50, kinds[i % 5], 1.0 + i, f'{{"k": {i % 97}}}')
                                  for i in range(n)], EVENTS)


def _plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_a_line_is_parsed_once(spark):
    ev = C.with_counter_base(_events(spark, 5))
    g = _plan(I.gpu_metrics(C.gpu_scrapes(ev), C.registry(spark)))
    m = _plan(I.model_metrics(C.model_scrapes(ev), C.registry(spark)))
    for plan in (g, m):
        assert plan.count("regexp_extract(_l") == 1 and plan.count("substring_index(") <= 2 and plan.count("regexp_extract(ltrim") == 0


def test_blank_lines_and_comments_are_no_samples(spark):
    from vigil.sources.exposition import parse_samples
    df = spark.createDataFrame([(1, "\n".join(["", "  ", "\t", "# up 1", "  # up 2", "#", "up 3", "  up 4"]))], "scrape_id long, text string")
    assert [(r.ordinal, r.name, r.value) for r in parse_samples(df).collect()] == [(6, "up", 3.0), (7, "up", 4.0)]


def test_rendered_nulls_are_the_word_null(spark):
    ev = C.with_counter_base(spark.createDataFrame([(None, None, None, None, None, None)], EVENTS))
    m, g = C.model_scrapes(ev).first().text, C.gpu_scrapes(ev).first().text
    assert 'vllm:e2e_request_latency_seconds{model_name="null",quantile="0.5"} null' in m
    assert 'vllm:request_success_total{model_name="null"} null' in m
    assert 'DCGM_FI_DEV_GPU_UTIL{gpu="0",Hostname="gpu-node-10"} null' in g


def test_one_row_group_spreads_over_tasks_of_bounded_rows(spark, tmp_path):
    path = str(tmp_path / "events.parquet")
    _events(spark, 1000).coalesce(1).write.parquet(path)
    for by in ((), ("ts", "event_id")):
        sizes = spread(spark.read.parquet(path), 50, *by).groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in sizes) == 1000 and max(r["count"] for r in sizes) <= 100


def test_as_of_assembly_reads_no_capture_twice(spark):
    ev, reg = C.with_counter_base(_events(spark, 20, seconds=1)), C.registry(spark)
    ticks = ev.select(F.col("event_id").alias("tick_id"), F.col("ts").alias("tick_ts"))
    out = I.assemble_ticks(I.model_metrics(C.model_scrapes(ev), reg), I.timed(I.gpu_metrics(C.gpu_scrapes(ev), reg), ticks),
                           I.timed(I.pod_usage(C.pod_documents(ev), reg), ticks), 0)
    assert "posexplode" not in _plan(out)
    rows = {r.scrape_id: r for r in out.collect()}
    assert len(rows) == 20 and rows[0].gpu_util_pct == 0.0 and rows[4].gpu_util_pct is None and rows[4].pod_mem_mb is not None


def test_pod_sums_with_two_registry_matches_and_null_ticks(spark):
    reg = spark.createDataFrame([("a", "llm", None, None, 0), ("ab", "llm", None, None, 1)], C.REGISTRY_DDL)
    pods = spark.createDataFrame([(1, "ab-0", [("x", "1", "1Mi"), ("y", "250m", None)]), (1, "ab-1", [("x", "1", "1Mi")]),
                                  (1, "ab-1", [("x", "1", "1Mi")]), (1, "ab-2", []), (2, "zz", [("x", "1", "1")]),
                                  (None, "ab-0", [("x", "1", "1Mi")]), (3, None, [("x", "1", "1Mi")])],
                                 "tick_id long, pod string, containers array<struct<name:string, cpu:string, memory:string>>")
    assert [tuple(r) for r in I.pod_usage(pods, reg).collect()] == [(1, "a", 3250.0, 3.0)]


def test_streamed_ingestion_runs_in_tasks_of_bounded_rows(spark, tmp_path, monkeypatch):
    _events(spark, 400).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(Q, "CAPTURE_ROWS", 20)
    out = Q.QUERIES["stream_ingest"](spark, str(tmp_path))
    batch = Q.QUERIES["scrape_metrics"](spark, str(tmp_path))
    assert out.count() == 400 and out.exceptAll(batch).count() == 0
    assert len(out.inputFiles()) > 8                  # the session's shuffle partitions


def test_a_date_of_the_fact_table_is_not_cut_over_all_tasks(spark, tmp_path):
    _events(spark, 600, seconds=600).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(conf, "false")                     # as with partitions too large to be merged
    try:
        path = Q.telemetry_path(spark, str(tmp_path))
    finally:
        spark.conf.set(conf, "true")
    per_date = [len(glob.glob(f"{d}/*.parquet")) for d in glob.glob(f"{path.removeprefix('file:')}/date=*")]
    assert len(per_date) == 5 and max(per_date) == 1
    assert spark.read.parquet(path).count() == 600


def test_events_are_ordered_once_and_move_narrow(spark, tmp_path):
    ev = _events(spark, 300, seconds=20)
    odd = ev.where("event_id % 50 = 0").withColumn("ts", F.when(F.col("event_id") % 100 != 0, F.col("ts")))
    odd = odd.withColumn("props", F.lit(None).cast("string")).withColumn("value", F.lit(float("nan"))).unionByName(ev.where("event_id < 20"))
    path = str(tmp_path / "events.parquet")
    ev.unionByName(odd).write.parquet(path)
    ev = spark.read.parquet(path)
    got, exp = Q.build_telemetry(spark, str(tmp_path)), with_rates(telemetry_from_events(ev))
    assert got.columns == exp.columns and got.dtypes == exp.dtypes
    assert got.count() == exp.count() == 326 and got.exceptAll(exp).count() == exp.exceptAll(got).count() == 0
    assert _plan(got).count("Arguments: hashpartitioning(") == 7      # 9 when the rates order the projected rows anew
