"""Small helpers shared by the operators: stage tables, batch bounds, keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package
from ..sources.sinks import shared_path

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> None:
    """Ship the package to Python workers and bound the bytes of one Arrow
    batch, so that a batch of very long texts stays small."""
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))


class Stage:
    """Written intermediate tables of one operator call.

    ``put`` writes a table under ``spark.checkpoint.dir`` and reads it back:
    lineage is cut and a lost executor costs a re-read.  ``drop`` deletes a
    table that no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def put(self, df: DataFrame, what: str) -> DataFrame:
        path = shared_path(self.spark, f"{self.name}-{what}")
        df.write.option("compression", "zstd").parquet(path)
        self.paths[what] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for n in names:
            p = jvm.org.apache.hadoop.fs.Path(self.paths.pop(n))
            p.getFileSystem(conf).delete(p, True)


def same(a, b):
    """Null-safe equality; usable as a join key."""
    return a.eqNullSafe(b)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_key(col: str = "text"):
    """Second half of a row key: rows that share id *and* text are one key.
    128 bits of sha256, so different texts never share one; null counts as empty."""
    digest = F.sha2(F.coalesce(F.col(col), F.lit("")), 256)
    return F.unhex(F.substr(digest, F.lit(1), F.lit(32))).alias("tkey")


def packed(df: DataFrame, *without: str):
    """The columns of ``df`` (but ``without``) as one struct ``row``: whatever
    their names, they cannot clash with an operator's own columns."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in without]).alias("row")


def free_of(df: DataFrame, *names: str) -> None:
    """Raise if ``df`` has a column that the result adds."""
    taken = sorted(set(names) & {c.lower() for c in df.columns})
    if taken:
        raise ValueError(f"the result adds {', '.join(taken)}: rename these columns first")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    have = {c.lower() for c in df.columns}
    while name in have:
        name += "_"
    return name
