"""Feature vectors of the anomaly detector from the fact table (A3, M4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FEATURES_LLM, FEATURES_TTS
from .panels import bucket_start


def feature_slots(df: DataFrame) -> DataFrame:
    """The 4-slot feature vector: slot 3 is RTF for TTS, KV % otherwise (M4)."""
    tts = F.col("model_type") == "tts"
    return df.select(
        "*",
        F.col(FEATURES_LLM[0]).alias("f0"), F.col(FEATURES_LLM[1]).alias("f1"),
        F.when(tts, F.col(FEATURES_TTS[2])).otherwise(F.col(FEATURES_LLM[2])).alias("f2"),
        F.col(FEATURES_LLM[3]).cast("double").alias("f3"))


def window_features(df: DataFrame, seconds: int = 60) -> DataFrame:
    """AVG of the four features per (model, bucket); all-NULL buckets dropped."""
    x = feature_slots(df).select("model_name", "model_type",
                                 bucket_start("time", seconds).alias("bucket"),
                                 "f0", "f1", "f2", "f3")
    agg = x.groupBy("model_name", "model_type", "bucket").agg(
        *[F.avg(c).alias(c) for c in ["f0", "f1", "f2", "f3"]])
    return agg.where(F.coalesce("f0", "f1", "f2", "f3").isNotNull())
