"""Readers for captured configuration and feeds (S2, S3, S14), all with
declared schemas (no inference pass over the data)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY_SCHEMA = ("name string, model_type string, gpu_node_selector string, "
                   "tts_tokens_per_second_of_audio double, vllm_endpoint string")
POD_LIST_SCHEMA = ("items array<struct<metadata:struct<name:string>, "
                   "containers:array<struct<name:string, usage:struct<cpu:string, memory:string>>>>>")
ALERT_SCHEMA = ("labels map<string,string>, annotations map<string,string>, status struct<state:string>, "
                "startsAt string, endsAt string")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Model registry (JSON lines or a JSON array).  ``ord`` keeps file order,
    which decides first-match pod ownership."""
    df = spark.read.schema(REGISTRY_SCHEMA).option("multiLine", "true").json(path)
    return df.select("name", "model_type", "gpu_node_selector",
                     F.col("tts_tokens_per_second_of_audio").alias("tts_tokens_per_second"),
                     F.monotonically_increasing_id().alias("ord"))


#: Where a capture's file name holds its UTC time, and which folder names its model.
TIME_IN_NAME = r"([0-9]{8}T[0-9]{6})[^/]*$"
MODEL_IN_PATH = r"([^/]+)/[^/]+$"


def _file_time(pattern: str):
    """The capture time in the file's name, else the file's modification time."""
    named = F.try_to_timestamp(F.nullif(F.regexp_extract("_metadata.file_path", pattern, 1), F.lit("")), F.lit("yyyyMMdd'T'HHmmss"))
    return F.coalesce(named, F.col("_metadata.file_modification_time")).cast("timestamp_ntz")


def load_settings(path: str, environ=None, overrides=None) -> dict:
    """Collector settings from a JSON or YAML file on the driver.  Environment
    variables listed in ``overrides`` (name -> key of the ``collector`` section)
    win; the interval is an integer.  YAML needs the yaml package."""
    import json
    import os
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML settings needs the yaml package; JSON needs none") from e
        settings = yaml.safe_load(text) or {}
    else:
        settings = json.loads(text)
    section = settings.setdefault("collector", {})
    environ = os.environ if environ is None else environ
    for name, key in (ENV_OVERRIDES if overrides is None else overrides).items():
        if environ.get(name):
            section[key] = int(environ[name]) if key == "scrape_interval_seconds" else environ[name]
    return settings


# FIXED VALUES: environment variables that override the settings file
ENV_OVERRIDES = {"TIMESCALEDB_URL": "timescaledb_url", "DCGM_ENDPOINT": "dcgm_endpoint", "SCRAPE_INTERVAL": "scrape_interval_seconds"}


def settings_registry(spark: SparkSession, settings: dict) -> DataFrame:
    """The ``models`` list of the settings as the registry; list order is kept."""
    rows = [(m.get("name"), m.get("model_type"), m.get("gpu_node_selector"), m.get("tts_tokens_per_second_of_audio"), i)
            for i, m in enumerate(settings.get("models") or [])]
    rows = [(n, t, g, None if r is None else float(r), i) for n, t, g, r, i in rows]
    return spark.createDataFrame(rows, "name string, model_type string, gpu_node_selector string, tts_tokens_per_second double, ord long")


def read_pod_documents(spark: SparkSession, path: str, tick_col: str = "tick_id", time_pattern: str = TIME_IN_NAME) -> DataFrame:
    """Captured pod-metrics API responses, one JSON document per file ->
    (tick_id, tick_ts, pod, containers); the time is that in the file name."""
    raw = spark.read.schema(POD_LIST_SCHEMA).option("multiLine", "true").json(path)
    raw = raw.select("*", F.xxhash64("_metadata.file_path").alias(tick_col), _file_time(time_pattern).alias("tick_ts"))
    pods = raw.select(tick_col, "tick_ts", F.explode("items").alias("p"))
    return pods.select(tick_col, "tick_ts", F.col("p.metadata.name").alias("pod"), F.transform(
        "p.containers", lambda c: F.struct(c["name"].alias("name"), c["usage"]["cpu"].alias("cpu"),
                                           c["usage"]["memory"].alias("memory"))).alias("containers"))


def read_external_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Captured external alert list; a missing path yields an empty feed
    (the feed is optional)."""
    try:
        return spark.read.schema(ALERT_SCHEMA).option("multiLine", "true").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ALERT_SCHEMA)


def read_scrape_texts(spark: SparkSession, path: str, time_pattern: str = TIME_IN_NAME, model_pattern: str = MODEL_IN_PATH) -> DataFrame:
    """One captured exposition dump per file -> (scrape_id, scrape_ts,
    model_name, text): the time from the file's name, the model from its folder.
    ``wholetext`` keeps a dump in one row; parallelism = number of files."""
    df = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path)
    return df.select(F.xxhash64("_metadata.file_path").alias("scrape_id"), _file_time(time_pattern).alias("scrape_ts"),
                     F.regexp_extract("_metadata.file_path", model_pattern, 1).alias("model_name"), F.col("value").alias("text"))


def read_gpu_texts(spark: SparkSession, path: str, time_pattern: str = TIME_IN_NAME) -> DataFrame:
    """Captured GPU exporter dumps, one a file -> (tick_id, tick_ts, text)."""
    s = read_scrape_texts(spark, path, time_pattern)
    return s.select(F.col("scrape_id").alias("tick_id"), F.col("scrape_ts").alias("tick_ts"), "text")
