"""Isolation-forest anomaly detection.

Isolation Forest (Liu, Ting & Zhou, 2008) as Spark jobs:

* **sample**: tree t of model m trains on min(256, n) of the model's n rows,
  drawn without replacement as ordinals by a stream seeded with (seed, t, m)
  and joined to balanced row numbers.  One scheme at every size; the same rows
  give the same forest, however they are partitioned.
* **build**: ``groupBy(model, tree).applyInPandas`` grows one tree per group
  (groups are bounded by the sample size) and emits a node table.
* **score**: rows are cut into buckets of bounded size and cogrouped with
  their model's node table (at most 100 x 511 nodes), so neither a hot
  model nor a large forest ever lands whole in one task.

RNG streams differ from any other implementation, so scores are checked by
invariants (outliers rank lowest, ~contamination of training rows flagged).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import (FEATURES_LLM, FEATURES_TTS, FOREST_CONTAMINATION, FOREST_SAMPLE,
                      FOREST_SEED, FOREST_TREES, TRAIN_MIN_ROWS)
from ..functions.exprs import rnd
from ..windows import minus_seconds, ts_lit, since
from .events import feature_slots
from .guard import guarded, split, with_error
from .panels import bucket_start
from .scan import CHUNK, exact_quantiles, row_numbers, with_chunk

SLOTS = ["f0", "f1", "f2", "f3"]
BUCKET = 50_000          # rows numbered in one window
NODE_SCHEMA = T.StructType([
    T.StructField("model_name", T.StringType()), T.StructField("tree", T.IntegerType()),
    T.StructField("node", T.IntegerType()), T.StructField("feature", T.IntegerType()),
    T.StructField("threshold", T.DoubleType()), T.StructField("left", T.IntegerType()),
    T.StructField("right", T.IntegerType()), T.StructField("path", T.DoubleType()),
])
EULER_GAMMA = 0.5772156649015329


def avg_path_length(n) -> np.ndarray:
    """c(n): mean path length of an unsuccessful BST search over n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER_GAMMA) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def feature_names(model_type: str) -> list[str]:
    return FEATURES_TTS if model_type == "tts" else FEATURES_LLM


# ------------------------------------------------------------- training ----

def training_rows(telemetry: DataFrame, as_of, days: int = 7, null_policy: str = "zero") -> DataFrame:
    """Feature vectors of the trailing window.  ``null_policy='zero'``
    counts NULL features as 0 (the reference collector's behaviour, which
    pulls baselines down); ``'skip'`` drops rows with any NULL feature."""
    x = since(telemetry, as_of, days * 86400)
    x = x.where(F.col("time") <= ts_lit(as_of))
    x = feature_slots(x)
    if null_policy == "skip":
        x = x.dropna(subset=SLOTS)
    elif null_policy != "zero":
        raise ValueError(f"unknown null_policy {null_policy!r}")
    return x.select("model_name", "model_type", F.col("seq").alias("row_id"),
                    *[F.coalesce(F.col(s).cast("double"), F.lit(0.0)).alias(s) for s in SLOTS])


def baselines(train: DataFrame) -> DataFrame:
    """n, means and population stds per model and slot."""
    # type resolved inside the same hash aggregate: min over a numeric code
    # (llm < tts, as the string order) instead of a string min, which would
    # plan a sort-based aggregate; unknown types fall back to the LLM set
    code = F.when(F.col("model_type") == "tts", 1).otherwise(0)
    aggs = [F.count(F.lit(1)).alias("n"), F.min(code).alias("_type_code")]
    for s in SLOTS:
        aggs += [F.avg(s).alias(f"mean_{s}"), F.stddev_pop(s).alias(f"std_{s}")]
    out = train.groupBy("model_name").agg(*aggs)
    return out.withColumn("model_type", F.when(F.col("_type_code") == 1, "tts").otherwise("llm")).drop("_type_code")


def _scaled(df: DataFrame, base: DataFrame) -> DataFrame:
    """Standardise with the training mean / population std (std 0 -> 1)."""
    b = base.select("model_name", *[F.col(f"mean_{s}") for s in SLOTS], *[F.col(f"std_{s}") for s in SLOTS])
    x = df.join(b, "model_name")
    z = []
    for s in SLOTS:
        sd = F.col(f"std_{s}")
        scale = F.when(sd.isNull() | (sd < 1e-12), F.lit(1.0)).otherwise(sd)
        z.append(((F.col(s) - F.col(f"mean_{s}")) / scale).alias(f"z_{s}"))
    return x.select(*df.columns, *z)


def sample_for_trees(train: DataFrame, base: DataFrame, n_trees: int = FOREST_TREES,
                     sample: int = FOREST_SAMPLE, seed: int = FOREST_SEED) -> DataFrame:
    """(model, tree, row, ``ordinal``) for each tree's sample of min(sample, n) rows.

    Rows of a model are numbered 1..n in an order that depends on the rows
    alone (hash bucket, then row); the buckets hold about ``BUCKET`` rows, so
    the numbering spreads over tasks.  Each (model, tree) draws its ordinals
    from its own seeded stream and meets the rows in a join on the number:
    n_trees x sample small rows a model, whatever n is.
    """
    names = base.select("model_name", "n")
    x = train.join(names, "model_name")
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET)).cast("long")
    x = with_chunk(x, F.pmod(F.xxhash64(F.lit(seed), "row_id", *SLOTS), buckets))
    x = row_numbers(x, ["model_name"], ["row_id", *SLOTS], out="_rn").drop(CHUNK, "n")

    def draw(batches):
        for pdf in batches:
            rows = []
            for model, n, tree in zip(pdf["model_name"], pdf["n"], pdf["tree"]):
                rng = np.random.default_rng([seed, 1, tree, _name_seed(model)])
                rows.append(np.sort(rng.choice(n, min(sample, n), replace=False)) + 1)
            yield pd.DataFrame({"model_name": pdf["model_name"].repeat([len(r) for r in rows]).to_numpy(),
                                "tree": np.repeat(pdf["tree"].to_numpy(), [len(r) for r in rows]),
                                "ordinal": np.concatenate(rows) if rows else np.empty(0, np.int64)})

    trees = names.where("n > 0").select("model_name", "n", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree"))
    drawn = trees.repartition("model_name", "tree").mapInPandas(draw, "model_name string, tree int, ordinal long")
    hit = drawn.select(F.col("model_name").alias("_m"), "tree", "ordinal")
    return x.join(hit, (x.model_name == hit["_m"]) & (x["_rn"] == hit.ordinal)).drop("_m", "_rn")


def _name_seed(model: str) -> int:
    """The whole name seeds the stream: names that share a prefix must differ."""
    return int.from_bytes(hashlib.sha256(model.encode()).digest()[:16], "little")


def _grow(model: str, tree: int, Z: np.ndarray, seed: int) -> list[tuple]:
    """Grow one isolation tree; nodes as (node, feature, threshold, left, right, path)."""
    n = Z.shape[0]
    rng = np.random.default_rng([seed, tree, _name_seed(model)])
    max_depth = int(math.ceil(math.log2(max(n, 2))))
    nodes: list[list] = []
    stack = [(np.arange(n), 0, 0)]
    nodes.append(None)
    while stack:
        idx, depth, nid = stack.pop()
        sub = Z[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        free = np.nonzero(hi > lo)[0]
        if depth >= max_depth or len(idx) <= 1 or len(free) == 0:
            nodes[nid] = [nid, -1, 0.0, -1, -1, float(depth + avg_path_length([len(idx)])[0])]
            continue
        f = int(free[rng.integers(len(free))])
        t = float(rng.uniform(lo[f], hi[f]))
        if t >= hi[f]:
            t = float(lo[f])
        go_left = sub[:, f] <= t
        left_id, right_id = len(nodes), len(nodes) + 1
        nodes += [None, None]
        nodes[nid] = [nid, f, t, left_id, right_id, 0.0]
        stack.append((idx[~go_left], depth + 1, right_id))
        stack.append((idx[go_left], depth + 1, left_id))
    return [(model, tree, *nd) for nd in nodes]


def _build_group(seed: int):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        model, tree = str(pdf["model_name"].iloc[0]), int(pdf["tree"].iloc[0])
        Z = pdf.sort_values("ordinal")[[f"z_{s}" for s in SLOTS]].to_numpy(dtype=float)
        if not np.isfinite(Z).all():
            raise ValueError(f"a training row of {model} is not finite after scaling")
        rows = _grow(model, tree, Z, seed)
        return pd.DataFrame(rows, columns=[f.name for f in NODE_SCHEMA.fields])
    return build


def build_forest(train: DataFrame, base: DataFrame, n_trees: int = FOREST_TREES,
                 sample: int = FOREST_SAMPLE, seed: int = FOREST_SEED) -> DataFrame:
    """Node table for every model with at least TRAIN_MIN_ROWS rows, plus
    ``guard.ERROR``: a (model, tree) that cannot be grown has an error row."""
    ok = base.where(F.col("n") >= TRAIN_MIN_ROWS)
    s = sample_for_trees(train.join(ok.select("model_name"), "model_name", "left_semi"), ok,
                         n_trees, sample, seed)
    z = _scaled(s, ok).select("model_name", "tree", "ordinal", *[f"z_{c}" for c in SLOTS])
    return z.groupBy("model_name", "tree").applyInPandas(
        guarded(_build_group(seed), NODE_SCHEMA, ["model_name", "tree"]), with_error(NODE_SCHEMA))


# -------------------------------------------------------------- scoring ----

def _walk(nodes: pd.DataFrame, Z: np.ndarray) -> np.ndarray:
    """Sum over trees of the path length of each row of Z."""
    total = np.zeros(Z.shape[0])
    flat, row = np.ascontiguousarray(Z).ravel(), np.arange(Z.shape[0]) * Z.shape[1]
    for _, t in nodes.groupby("tree", sort=False):
        t = t.sort_values("node")
        feat, thr = t["feature"].to_numpy(np.int64), t["threshold"].to_numpy()
        left, right = t["left"].to_numpy(np.int64), t["right"].to_numpy(np.int64)
        inner, own = feat >= 0, np.arange(len(t))
        levels, cur = 0, own[:1][inner[:1]]
        while len(cur):
            levels += 1
            cur = np.concatenate([left[cur], right[cur]])
            cur = cur[inner[cur]]
        # a leaf leads to itself on both sides, so that all rows take all levels
        child = np.concatenate([np.where(inner, right, own), np.where(inner, left, own)])
        feat = np.where(inner, feat, 0)
        pos = np.zeros(Z.shape[0], dtype=np.int64)
        for _ in range(levels):
            go_left = flat.take(row + feat.take(pos)) <= thr.take(pos)
            pos = child.take(pos + go_left * len(t))
        total += t["path"].to_numpy().take(pos)
    return total


def _score_group(carry: list[str]):
    def score_group(key, rows: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        out = rows[["model_name", *carry]]
        if rows.empty or nodes.empty:
            return out.assign(score=np.nan)
        Z = rows[[f"z_{s}" for s in SLOTS]].to_numpy(dtype=float)
        n_trees = nodes["tree"].nunique()
        psi = float(rows["psi"].iloc[0])
        mean_path = _walk(nodes, Z) / n_trees
        return out.assign(score=-np.power(2.0, -mean_path / avg_path_length([psi])[0]))
    return score_group


def score_rows(rows: DataFrame, base: DataFrame, nodes: DataFrame, bucket_rows: int = 50000,
               sample: int = FOREST_SAMPLE, carry: Sequence[str] = ("row_id",)) -> DataFrame:
    """score_samples (= -2^(-E[h]/c(psi))) for (model_name, row_id, f0..f3) rows:
    (model_name, the ``carry`` columns, score).

    Rows of a model are spread over ceil(n / bucket_rows) buckets and each
    bucket is cogrouped with a copy of the model's node table."""
    counts = rows.groupBy("model_name").agg(F.count(F.lit(1)).alias("_cnt"))
    nb = counts.select("model_name", F.greatest(F.lit(1), F.ceil(F.col("_cnt") / bucket_rows)).cast("int").alias("_nb"))
    b = base.select("model_name", F.least(F.col("n"), F.lit(sample)).cast("double").alias("psi"))
    r = _scaled(rows, base).join(b, "model_name").join(nb, "model_name")
    r = r.withColumn("_bucket", F.pmod(F.xxhash64("row_id"), F.col("_nb")).cast("int"))
    r = r.select("model_name", "_bucket", *carry, "psi", *[f"z_{s}" for s in SLOTS])
    schema = T.StructType([*[rows.schema[c] for c in ("model_name", *carry)], T.StructField("score", T.DoubleType())])
    nn = nodes.join(nb, "model_name").select(
        "*", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)).alias("_bucket")).drop("_nb")
    return (r.groupBy("model_name", "_bucket")
             .cogroup(nn.groupBy("model_name", "_bucket"))
             .applyInPandas(_score_group(list(carry)), schema))


def train(telemetry: DataFrame, as_of, days: int = 7, n_trees: int = FOREST_TREES,
          seed: int = FOREST_SEED) -> tuple[DataFrame, DataFrame]:
    """Returns (model_baselines, forest_nodes) of the models that could be
    trained; ``train_isolated`` also tells which could not."""
    return train_isolated(telemetry, as_of, days, n_trees, seed)[:2]


def train_isolated(telemetry: DataFrame, as_of, days: int = 7, n_trees: int = FOREST_TREES,
                   seed: int = FOREST_SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(model_baselines, forest_nodes, failed models with their error).  The
    offset is the contamination quantile of the training scores (decision value
    0 there).  A model whose trees raise does not keep the others from training."""
    tr = training_rows(telemetry, as_of, days)
    base = baselines(tr)
    from ..sources.sinks import materialize
    nodes, failed = split(materialize(build_forest(tr, base, n_trees, seed=seed), "forest_nodes"), ["model_name"])
    base = base.join(failed.select("model_name"), "model_name", "left_anti")
    tr = tr.join(failed.select("model_name"), "model_name", "left_anti")
    scores = materialize(score_rows(tr, base, nodes), "training_scores")        # the quantiles read them more than once
    off = exact_quantiles(scores, ["model_name"], "score", [FOREST_CONTAMINATION])
    trained = base.where(F.col("n") >= TRAIN_MIN_ROWS).join(
        off.select("model_name", F.col("q")[0].alias("score_offset")), "model_name", "left")
    model_baselines = trained.select(
        "model_name", "model_type", ts_lit(as_of).alias("trained_at"),
        F.when(F.col("model_type") == "tts", F.array(*[F.lit(f) for f in FEATURES_TTS]))
         .otherwise(F.array(*[F.lit(f) for f in FEATURES_LLM])).alias("feature_names"),
        *[rnd(f"mean_{s}", 6).alias(f"mean_{s}") for s in SLOTS],
        *[rnd(f"std_{s}", 6).alias(f"std_{s}") for s in SLOTS],
        *[F.col(f"mean_{s}").alias(f"_exact_mean_{s}") for s in SLOTS],
        *[F.col(f"std_{s}").alias(f"_exact_std_{s}") for s in SLOTS],
        F.col("n").cast("int").alias("n_training_samples"), "score_offset")
    return materialize(model_baselines, "model_baselines"), nodes, failed


# ------------------------------------------------------- window scoring ----

def contributing_dims(cur: DataFrame, model_baselines: DataFrame) -> Column:
    """array<struct<feature, value, baseline, deviation_pct>> sorted by
    deviation desc (stable on slot order) (M7, L3)."""
    structs = []
    for i, s in enumerate(SLOTS):
        name = F.when(F.col("model_type") == "tts", F.lit(FEATURES_TTS[i])).otherwise(F.lit(FEATURES_LLM[i]))
        base_v, val = F.col(f"mean_{s}"), F.col(s)
        dev = F.when(base_v != 0, F.abs((val - base_v) / base_v) * 100.0).otherwise(F.abs(val) * 100.0)
        structs.append(F.struct(F.lit(i).alias("slot"), name.alias("feature"), rnd(val, 4).alias("value"),
                                rnd(base_v, 4).alias("baseline"), rnd(dev, 2).alias("deviation_pct")))
    return F.array_sort(F.array(*structs), lambda a, b: F.when(
        a["deviation_pct"] > b["deviation_pct"], -1).when(a["deviation_pct"] < b["deviation_pct"], 1)
        .otherwise(a["slot"] - b["slot"]))


def top_dims(dims: Column, n: int = 3) -> Column:
    """Names of the ``n`` most deviating dimensions, largest first."""
    return F.array_join(F.transform(F.slice(dims, 1, n), lambda d: d["feature"]), ", ")


def window_vectors(telemetry: DataFrame, seconds: int = 60) -> DataFrame:
    """AVG feature vector per (model, bucket), NULL and non-finite -> 0."""
    x = feature_slots(telemetry).select("model_name", "model_type", bucket_start("time", seconds).alias("bucket"),
                                        *SLOTS)
    agg = x.groupBy("model_name", "model_type", "bucket").agg(*[F.avg(s).alias(s) for s in SLOTS])
    agg = agg.where(F.coalesce(*[F.col(s) for s in SLOTS]).isNotNull())
    return agg.select("model_name", "model_type", "bucket",
                      *[F.coalesce(F.col(s), F.lit(0.0)).alias(s) for s in SLOTS])


def score_windows(telemetry: DataFrame, model_baselines: DataFrame, nodes: DataFrame,
                  seconds: int = 60, cold_start: str = "constant", stats: DataFrame | None = None) -> DataFrame:
    """Anomaly events for every (model, bucket): decision value, flag,
    sorted contributing dimensions; models without a trained forest get
    the cold-start event (M6, M7, M8, M9).  ``cold_start='zscore'`` scores
    those models with ``zscore_events`` against ``stats`` (``baselines`` of
    their training rows) instead of the constant."""
    vec = window_vectors(telemetry, seconds)
    if cold_start == "constant":
        return score_vectors(vec, model_baselines, nodes, seconds)
    if cold_start != "zscore" or stats is None:
        raise ValueError("cold_start must be 'constant', or 'zscore' with stats")
    trained = model_baselines.select("model_name")
    forest = score_vectors(vec.join(trained, "model_name", "left_semi"), model_baselines, nodes, seconds)
    z = zscore_events(vec.join(trained, "model_name", "left_anti"), stats, seconds).drop("max_abs_z")
    z = z.select("*", F.col("dims")[0]["feature"].alias("top_feature"), top_dims(F.col("dims")).alias("top_dims"),
                 F.aggregate("dims", F.lit(0.0), lambda acc, d: acc + d["deviation_pct"]).alias("total_deviation"))
    return forest.unionByName(z)


def zscore_events(vectors: DataFrame, stats: DataFrame, seconds: int = 60, z_threshold: float = 3.0) -> DataFrame:
    """Documented cold-start alternative (``cold_start='zscore'``): per window,
    z = (value - mean) / population std of the training window per feature;
    anomalous when max |z| > 3.  Our score mapping keeps the detector's bands:
    score = -0.05 x (max|z| - 2), so |z| = 3 sits on the warning cut (-0.05)
    and |z| = 5 on the critical cut (-0.15).  Features with zero std are ignored."""
    x = vectors.join(stats.select("model_name", *[f"mean_{s}" for s in SLOTS], *[f"std_{s}" for s in SLOTS]),
                     "model_name")
    zs = [F.when(F.col(f"std_{s}") > 1e-12, F.abs((F.col(s) - F.col(f"mean_{s}")) / F.col(f"std_{s}")))
          for s in SLOTS]
    zmax = F.coalesce(F.greatest(*zs), F.lit(0.0))
    base = x.select("*", zmax.alias("_z"), rnd(zmax, 4).alias("max_abs_z"))
    dims = contributing_dims(base, stats)
    return base.select(
        (F.col("bucket") + F.expr(f"INTERVAL {int(seconds)} SECONDS")).alias("computed_at"),
        "model_name", "model_type", rnd(-0.05 * (F.col("_z") - 2.0), 6).alias("anomaly_score"),
        (F.col("_z") > z_threshold).alias("is_anomaly"), F.lit(True).alias("cold_start_mode"),
        dims.alias("dims"), "max_abs_z")


def score_vectors(vectors: DataFrame, model_baselines: DataFrame, nodes: DataFrame,
                  seconds: int = 60) -> DataFrame:
    """Score (model_name, model_type, bucket, f0..f3) window vectors."""
    mb = model_baselines
    have = mb.select("model_name")
    base_for_scaling = mb.select("model_name", "n_training_samples",
                                 *[F.col(f"_exact_mean_{s}").alias(f"mean_{s}") for s in SLOTS],
                                 *[F.col(f"_exact_std_{s}").alias(f"std_{s}") for s in SLOTS]
                                 ).withColumnRenamed("n_training_samples", "n")
    # the rows go through the groups whole, so nothing is joined back
    carry = ["model_type", "bucket", *SLOTS]
    rows = vectors.select("model_name", *carry).withColumn("row_id", F.unix_micros(F.col("bucket").cast("timestamp")))
    sc = score_rows(rows.join(have, "model_name", "left_semi"), base_for_scaling, nodes, carry=carry)
    none = rows.join(have, "model_name", "left_anti").select("model_name", *carry, F.lit(None).cast("double").alias("score"))
    x = sc.unionByName(none).join(mb.select("model_name", "score_offset", *[f"mean_{s}" for s in SLOTS]), "model_name", "left")
    trained = F.col("score_offset").isNotNull()
    decision = F.col("score") - F.col("score_offset")
    dims = F.when(trained, contributing_dims(x, mb)).otherwise(F.array().cast(
        "array<struct<slot:int,feature:string,value:double,baseline:double,deviation_pct:double>>"))
    out = x.select(
        (F.col("bucket") + F.expr(f"INTERVAL {int(seconds)} SECONDS")).alias("computed_at"),
        "model_name", "model_type",
        F.when(trained, rnd(decision, 6)).otherwise(F.lit(-0.1)).alias("anomaly_score"),
        F.when(trained, decision < 0).otherwise(F.lit(False)).alias("is_anomaly"),
        (~trained).alias("cold_start_mode"), dims.alias("dims"))
    return out.select("*", F.col("dims")[0]["feature"].alias("top_feature"), top_dims(F.col("dims")).alias("top_dims"),
                      F.aggregate("dims", F.lit(0.0), lambda acc, d: acc + d["deviation_pct"]).alias("total_deviation"))
