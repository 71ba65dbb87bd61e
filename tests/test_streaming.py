"""Stream = batch: counter rates, windows and scores over several micro-batches."""
import os
import tempfile

from pyspark.sql import functions as F

from vigil.operators.counters import with_rates
from vigil.streaming import jobs as J
from conftest import fact_rows, ts


def test_counter_rate_stream_matches_batch(spark):
    rows = []
    for day in range(3):
        for i in range(6):
            for m, base in (("a", 0), ("b", 100)):
                v = None if (day == 1 and i == 2 and m == "a") else base + (day * 6 + i) * 3 - (50 if (day == 2 and i == 3) else 0)
                rows.append({"time": ts(f"2024-01-2{day} 00:0{i}:00"), "seq": day * 100 + i, "model_name": m,
                             "request_success_total": v})
    df = fact_rows(spark, rows)
    src = tempfile.mkdtemp(prefix="vigil-stream-src-")
    for day in range(3):     # one file per day, written in time order -> three micro-batches
        (df.where(F.dayofmonth("time") == 20 + day).coalesce(1)
           .write.mode("append").parquet(src))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = J.rate_run(stream, "t_rate").toPandas()
    exp = with_rates(df).select("model_name", "seq", "throughput_rps").toPandas()
    m = got.merge(exp, on=["model_name", "seq"], suffixes=("", "_b"))
    assert len(m) == len(rows)
    assert ((m["throughput_rps"] - m["throughput_rps_b"]).abs().fillna(0) < 1e-12).all()
    assert (m["throughput_rps"].isna() == m["throughput_rps_b"].isna()).all()


def test_scoring_stream_equals_batch(spark):
    from vigil.operators import anomaly as A
    from vigil.plans import catalog as C
    from conftest import SF0001
    tel = C.telemetry(spark, SF0001)
    mb, nodes = A.train(tel, C.AS_OF)
    batch = A.score_windows(tel, mb, nodes).select("model_name", "computed_at", "anomaly_score").toPandas()
    stream = J.scoring_run(C._fact_stream(spark, SF0001), tel, mb, nodes, "0 seconds").select(
        "model_name", "computed_at", "anomaly_score").toPandas()
    m = stream.merge(batch, on=["model_name", "computed_at"], suffixes=("", "_b"))
    assert len(m) == len(stream) == len(batch)
    assert (abs(m["anomaly_score"] - m["anomaly_score_b"]) < 1e-12).all()


def _source(spark, df, parts):
    """``df`` as a file source of one file per part, in order."""
    src = tempfile.mkdtemp(prefix="vigil-stream-src-")
    for p in parts:
        df.where(p).coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)


def test_late_rows_inside_the_delay_take_their_place(spark):
    """Rows 3 and 7 come one batch late: repaired within the delay, NULL beyond it."""
    rows = [{"time": ts(f"2024-01-20 00:{i:02d}:00"), "seq": i, "model_name": "a", "request_success_total": 10 * i * i} for i in range(12)]
    df = fact_rows(spark, rows)
    parts = ["seq in (0, 1, 2, 4, 5)", "seq in (3, 6, 8, 9)", "seq in (7, 10, 11)"]
    exp = {r.seq: r.throughput_rps for r in with_rates(df).collect()}
    got = {r.seq: r.throughput_rps for r in J.rate_run(_source(spark, df, parts), "t_late", delay_seconds=240).collect()}
    assert got == exp
    late = {r.seq: r.throughput_rps for r in J.rate_run(_source(spark, df, parts), "t_late0").collect()}
    assert late[3] is None and late[7] is None and late[4] == (160 - 40) / 15.0 and len(late) == 12


def test_repeated_batch_gives_rows_once(spark):
    rows = [{"time": ts(f"2024-01-20 00:{i:02d}:00"), "seq": i, "model_name": m, "request_success_total": i} for i in range(10) for m in "ab"]
    df = fact_rows(spark, rows)
    fails = {"left": 1}
    real = J._rates

    def once(*a):
        if fails["left"]:
            fails["left"] -= 1
            raise RuntimeError("lost")
        return real(*a)
    J._rates = once
    try:
        try:
            J.rate_run(_source(spark, df, ["true"]), "t_once")
        except Exception as e:
            assert "lost" in str(e)
        assert J.rate_run(_source(spark, df, ["seq < 5", "seq >= 5"]), "t_once").count() == 20
    finally:
        J._rates = real


def test_one_model_spreads_over_chunks(spark):
    rows = spark.range(5000).selectExpr("'hot' AS model_name", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id * 7) AS time",
                                        "id AS seq", "id % 700 AS request_success_total")
    carry = spark.createDataFrame([("hot", 3)], "model_name string, value long")
    plan = J._rates(rows, carry, 15.0, "minute")._jdf.queryExecution().toString()
    assert "_chunk" in plan and plan.count("Window") >= 1
    got = J._rates(rows, carry, 15.0, "minute").orderBy("seq").collect()
    assert len(got) == 5000 and got[0].throughput_rps is None and got[1].throughput_rps == 1 / 15.0


def test_windows_open_at_the_end_are_closed(spark):
    rows = [{"time": ts(f"2024-01-20 {i // 6:02d}:{i % 6 * 10:02d}:00"), "seq": i, "model_name": m, "requests_waiting": i, "rtf": float(i)}
            for i in range(30) for m in "ab"]
    df = fact_rows(spark, rows)
    got = J.bucket_run(_source(spark, df, ["seq < 13", "seq >= 13"]), df, ["requests_waiting", "rtf"], "30 minutes").toPandas()
    exp = df.groupBy("model_name", F.window("time", "900 seconds")["start"].alias("bucket")).agg(
        F.avg("requests_waiting").alias("requests_waiting"), F.avg("rtf").alias("rtf")).toPandas()
    m = got.merge(exp, on=["model_name", "bucket"], suffixes=("", "_b"))
    assert len(got) == len(exp) == len(m) and (m["rtf"] == m["rtf_b"]).all()
