"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage


def components(edges: DataFrame, stage: Stage, tag: str = "cc") -> DataFrame:
    """Node -> smallest node reachable, for every node with an edge.

    ``edges``: longs (a, b), any direction, duplicates allowed.  Each round
    hangs the larger neighbours of every node on its smallest one, then the
    smaller ones; the edges shrink to a star per component in about
    log(diameter) rounds.  Edges point to the smaller end, so they are stars,
    and done, once no node has two edges and none that has one is pointed to.
    Minima are pre-aggregated, so a node with a third of all edges is an
    ordinary key; only one count reaches the driver."""
    e = stage.put(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                  .where("u <> v").distinct(), f"{tag}-0")
    k = 0
    while _unsettled(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage.put(large, f"{tag}-l{k}")
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                                                            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        nxt = stage.put(small.select("x.u", "x.v").where("u <> v").distinct(), f"{tag}-{k + 1}")
        stage.drop(f"{tag}-{k}", f"{tag}-l{k}")
        e, k = nxt, k + 1
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def _unsettled(e: DataFrame) -> int:
    """Nodes that keep the edges (u, v) from being stars."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        e.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    per = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return per.where("out > 1 or (out = 1 and into = 1)").count()
