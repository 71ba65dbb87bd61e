"""SparkSession construction and cluster-safe checkpointing."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job in this library relies on.  The session time zone is
# pinned to UTC so that `as_of` literals and bucket boundaries mean the same
# thing on every executor.
_DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "vigil",
                shuffle_partitions: int | None = None,
                extra_conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``vigil`` importable in Python workers (needed by pandas UDFs).

    The package is zipped once per driver process and added with
    ``addPyFile``, so executors fetch it from the driver like any
    ``--py-files`` dependency."""
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    import shutil
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="vigil-pkg-")
    archive = shutil.make_archive(os.path.join(out_dir, "vigil"), "zip",
                                  root_dir=os.path.dirname(pkg_dir), base_dir="vigil")
    sc.addPyFile(archive)
    _SHIPPED.add(key)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is
    used as is.  Only when it is unset (local tests) do we create one.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="vigil-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return configured


def spread(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """Narrow rows that grow much wider in the tasks that read them (captures
    rendered from events), dealt evenly over tasks of at most about ``rows``
    rows, and over all cores; with ``by``, in ranges of these columns.  Splits
    of a file are sized by its bytes and fall on its row groups, so they bound
    neither the rows nor the time of a task."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartitionByRange(n, *by) if by else df.repartition(n)
