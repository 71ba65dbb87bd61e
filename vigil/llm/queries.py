"""The registered queries of this subpackage: thin digests over the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, lines, minhash, mixing, packing, pii, quality, search, substrings, suffixes, toxic, trie, vectors
from .common import prepare, read

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.standard_mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "lang", "source", mixing.domain_of().alias("domain"), F.col("mx_epoch").cast("long").alias("epoch"))


@query
def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(read(spark, sf_dir, "documents")))


@query
def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(own).alias("text"))
    return chat.read_back(chat.windows(turns.unionByName(extra)))


@query
def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("ld_lines").alias("n_lines"), F.col("ld_removed").alias("n_removed"),
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.dedup_substrings(read(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)
    return out.select("doc_id", F.col("ss_words").alias("n_words"), F.col("ss_removed").alias("n_removed"),
                      F.col("ss_text").alias("kept_sha256"))


@query
def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.dedup_bytes(read(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)
    return out.select("doc_id", F.col("sa_bytes").alias("n_bytes"), F.col("sa_removed").alias("n_removed"),
                      F.col("sa_spans").alias("n_spans"), F.col("sa_kept").cast("string").alias("kept_sha256"))


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    led = quality.ledger(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.lit(quality.mask("base-1")).cast("long")
    out = quality.apply_policy(led, quality.POLICY)
    return out.select("doc_id", *[F.col(f"q_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                      (F.col("q_failed").bitwiseAND(base) != 0).alias("base_failed"), F.col("q_kept").alias("kept"),
                      F.col("q_failed").alias("failed_bits"))


@query
def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(read(spark, sf_dir, "embeddings"))


@query
def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.shared_starts(read(spark, sf_dir, "conversations"))


@query
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
