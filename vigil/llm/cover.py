"""Distributed difference-cover suffix sorting (Karkkainen, Sanders, Burkhardt).

The texts are one string of bytes in which every text ends in a symbol of its
own, so no two suffixes are equal and none matches across texts.

1. *Sample*: the triples at positions 1 and 2 modulo 3 are sorted by range
   partitioning and named by their rank.
2. *Recurse*: while names repeat and stand for less than ``window`` bytes, the
   names of the positions 1 mod 3, then those of the positions 2 mod 3, are a
   string of two thirds the length whose suffix ranks are the sample's.
3. *Merge*: the other suffixes are ordered by (symbol, rank of the next).  A
   suffix's place is the number of smaller suffixes of each kind; these come
   from two sorts, by (symbol, next rank) against the positions 1 mod 3 and by
   (two symbols, rank after them) against the positions 2 mod 3.
4. *Compare adjacent prefixes*: neighbours in that order whose first
   ``window`` bytes are equal (128-bit fingerprints) repeat.

Every step is a sort or a join by position over all bytes; per partition, one
count reaches the driver.  ``suffixes`` says why the registered query does not
run on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as X
from .common import Stage

END = 256            # symbol of the first text's end; later texts have larger ones


def ranked(df: DataFrame, keys: list[str], stage: Stage, tag: str, out: str = "place") -> DataFrame:
    """``df`` with its 1-based position in the order of ``keys``: sorted by range
    partitions, which are then numbered on."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    t = stage.put(sorted_, tag)
    part = F.shiftright("_at", 33)
    sizes = t.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("n")).collect()          # one row a partition
    before, rows = 0, []
    for r in sorted(sizes, key=lambda r: r["_p"]):
        rows.append((r["_p"], before - (r["_p"] << 33) + 1))
        before += r["n"]
    shift = df.sparkSession.createDataFrame(rows, "_p long, _shift long")
    return t.join(F.broadcast(shift), part == shift["_p"]).select(*df.columns, (F.col("_at") + F.col("_shift")).alias(out))


def _ahead(s: DataFrame, n: int) -> DataFrame:
    """(i, c0 .. c{n-1}): each position's symbol and the following ones, 0 past
    the end; every symbol is sent to the positions that look at it."""
    sent = s.select(F.explode(F.array(*[F.struct((F.col("i") - k).alias("i"), F.lit(k).alias("k"), F.col("c").alias("c")) for k in range(n)])).alias("x"))
    sent = sent.select("x.*").where("i >= 0")
    return sent.groupBy("i").agg(*[F.coalesce(F.max(F.when(F.col("k") == k, F.col("c"))), F.lit(0)).alias(f"c{k}") for k in range(n)])


def suffix_ranks(s: DataFrame, length: int, stage: Stage, window: int, covers: int = 1, tag: str = "l0") -> DataFrame:
    """(i, rank) of the suffixes of the string ``s`` (i from 0, c > 0).  Ranks
    order at least the first ``window`` / ``covers`` symbols; they are distinct
    unless the recursion stopped there."""
    triples = stage.put(_ahead(s, 3), f"{tag}-triples")
    sample = triples.where("i % 3 <> 0")
    if length % 3 == 1:            # positions 1 and 2 mod 3 must end in a triple of their own
        sample = sample.unionByName(s.sparkSession.createDataFrame([(length, 0, 0, 0)], "i long, c0 long, c1 long, c2 long"))
    distinct = ranked(sample.select("c0", "c1", "c2").distinct(), ["c0", "c1", "c2"], stage, f"{tag}-names", "name")
    named = stage.put(sample.join(distinct, ["c0", "c1", "c2"]).select("i", "name"), f"{tag}-named")
    total, names = named.count(), distinct.count()
    if names < total and covers * 3 < window:
        n1 = (length + 1) // 3 + (length % 3 == 1)               # positions 1 mod 3, with the added one
        at = F.when(F.col("i") % 3 == 1, F.floor(F.col("i") / 3)).otherwise(F.lit(n1) + F.floor(F.col("i") / 3)).cast("long")
        inner = named.select(at.alias("i"), F.col("name").alias("c"))
        deep = suffix_ranks(inner, total, stage, window, covers * 3, f"{tag}x")
        back = F.when(F.col("i") < n1, F.col("i") * 3 + 1).otherwise((F.col("i") - n1) * 3 + 2)
        named = stage.put(deep.select(back.alias("i"), F.col("rank").alias("name")), f"{tag}-deep")
    # rank of the suffix one and two further on, for every position
    nxt = triples.select("i", "c0", "c1").join(named.select((F.col("i") - 1).alias("i"), F.col("name").alias("r1")), "i", "left").join(
        named.select((F.col("i") - 2).alias("i"), F.col("name").alias("r2")), "i", "left").join(named, "i", "left")
    zero = F.lit(0).cast("long")
    nxt = stage.put(nxt.select("i", "c0", "c1", F.coalesce("r1", zero).alias("r1"), F.coalesce("r2", zero).alias("r2"), "name"), f"{tag}-keys")
    kind = F.col("i") % 3
    # smaller suffixes of the other kind, counted along the merged orders
    m1 = ranked(nxt.where("i % 3 <> 2").select("i", "c0", "r1"), ["c0", "r1", "i"], stage, f"{tag}-m1", "p")
    m2 = ranked(nxt.where("i % 3 <> 1").select("i", "c0", "c1", "r2"), ["c0", "c1", "r2", "i"], stage, f"{tag}-m2", "p")
    own0 = ranked(nxt.where("i % 3 = 0").select("i", "c0", "r1"), ["c0", "r1", "i"], stage, f"{tag}-o0", "o").select("i", "o")
    own1, own2 = (ranked(nxt.where(f"i % 3 = {k}").select("i", "name"), ["name", "i"], stage, f"{tag}-o{k}", "o").select("i", "o") for k in (1, 2))
    samples = ranked(named.where(F.col("i") < length).select("i", "name"), ["name", "i"], stage, f"{tag}-os", "s").select("i", "s")
    w1 = m1.select("i", F.col("p").alias("p1"))
    w2 = m2.select("i", F.col("p").alias("p2"))
    own = own0.unionByName(own1).unionByName(own2)
    x = own.join(w1, "i", "left").join(w2, "i", "left").join(samples, "i", "left")
    place = (F.when(kind == 0, F.col("p1") + F.col("p2") - F.col("o"))            # own kind is counted in both merged orders
             .when(kind == 1, F.col("s") + F.col("p1") - F.col("o"))
             .otherwise(F.col("s") + F.col("p2") - F.col("o")))
    return stage.put(x.select("i", place.alias("rank")), f"{tag}-ranks")


def _bytes(window: int):
    """(i, c, row key, pos, two fingerprints of the window that starts here)."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = X.texts_of(b)
            start, end = (b.column(b.schema.names.index(c)).to_numpy() for c in ("start", "no"))
            for k, t in enumerate(texts):
                v = np.frombuffer(t, np.uint8)
                n = len(v)
                sym = np.concatenate((v.astype(np.int64) + 1, [END + end[k]]))
                f1, f2 = np.zeros(n + 1, X.U), np.zeros(n + 1, X.U)
                if n >= window:
                    a = np.arange(n - window + 1)
                    f1[:n - window + 1] = X.span_hash(X.BYTE[v], a, a + window) | X.U(1)
                    f2[:n - window + 1] = X.span_hash(X.mix(X.BYTE[v].copy()), a, a + window)
                one = pa.array(np.full(n + 1, k))
                yield pa.RecordBatch.from_arrays([X.longs(start[k] + np.arange(n + 1)), X.longs(sym), b.column(0).take(one), b.column(1).take(one),
                                                  X.longs(np.arange(n + 1)), X.longs(f1), X.longs(f2)], names=["i", "c", "doc_id", "tkey", "pos", "f1", "f2"])
    return fn


def repeats(docs: DataFrame, window: int, stage: Stage) -> DataFrame:
    """Covered spans per (doc_id, tkey), as ``seeds.repeats`` gives them, by
    suffix sorting.  ``docs`` has doc_id, tkey, text."""
    d = stage.put(docs.withColumn("at", F.monotonically_increasing_id()).withColumn("len", F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1), "texts")
    part = F.shiftright("at", 33)
    sizes = d.groupBy(part.alias("p")).agg(F.sum("len").alias("n"), F.count(F.lit(1)).alias("k")).collect()       # one row a partition
    rows, total, count = [], 0, 0
    for r in sorted(sizes, key=lambda r: r["p"]):
        rows.append((r["p"], total, count))
        total, count = total + r["n"], count + r["k"]
    if not total:
        return d.select("doc_id", "tkey", F.array(F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"))).alias("spans")).where("false")
    base = d.sparkSession.createDataFrame(rows, "p long, before long, first long")
    run = Window.partitionBy(part).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("own", F.coalesce(F.sum("len").over(run), F.lit(0))).join(F.broadcast(base), part == base["p"])
    d = d.select("doc_id", "tkey", "text", (F.col("before") + F.col("own")).alias("start"), (F.col("first") + F.col("at") - F.shiftleft("p", 33) + 1).alias("no"))
    schema = f"i long, c long, doc_id long, tkey binary, pos long, f1 long, f2 long"
    b = stage.put(d.mapInArrow(_bytes(window), schema), "bytes")
    ranks = suffix_ranks(b.select("i", "c"), total, stage, window)
    order = stage.put(b.where("f1 <> 0").select("i", "doc_id", "tkey", "pos", "f1", "f2").join(ranks, "i"), "order")
    # neighbours: rows of consecutive places among the suffixes that hold a whole window
    seq = ranked(order, ["rank", "i"], stage, "sorted")
    nb = seq.select((F.col("place") - 1).alias("place"), F.col("f1").alias("g1"), F.col("f2").alias("g2"))
    same = seq.join(nb, "place").where("f1 = g1 and f2 = g2").select("place", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    hit = seq.join(same.select((F.col("place") + F.col("k")).alias("place")).distinct(), "place", "left_semi")
    spans = hit.select("doc_id", "tkey", F.struct(F.col("pos").cast("int").alias("s"), (F.col("pos") + window).cast("int").alias("e")).alias("x"))
    return spans.groupBy("doc_id", "tkey").agg(F.sort_array(F.collect_set("x")).alias("spans"))
