"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes it as Parquet and rereads it as the next stage's ``docs``.  All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import lines, minhash, mixing, packing, quality
from vigil.llm.common import Stage, prepare, read


def vocabulary() -> str:
    """The public vocabulary file the packing stage uses."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    prepare(spark)
    return quality.kept(quality.ledger(docs), quality.POLICY).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of lines that stand earlier in the corpus; a document
    that loses all its lines goes.  ``n_chars`` follows the new text."""
    out = lines.dedup_lines(docs).where("ld_removed = 0 or ld_removed < ld_lines")
    n = F.when(F.col("ld_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return minhash.dedup(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The standard mixture; a document taken in two epochs stands twice."""
    return mixing.standard_mix(docs).select(*docs.columns)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per packed piece."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near", near_stage),
    ("mix", mix_stage),
    ("pack", pack_stage),
]

#: Sketching and tokenising cannot be put in SQL.  Tests compare the line stage
#: with a brute-force version on a small table; no test compares the other stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs, stage = read(spark, sf_dir, "documents"), Stage(spark, "pipeline")
    for name, fn in STAGES[:-1]:
        docs = stage.put(fn(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
