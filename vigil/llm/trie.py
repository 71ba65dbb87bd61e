"""Operator 12, conversation prefix trie by time-forward processing.

A node is a distinct sequence of first d turns; a conversation is a member of
the nodes on its path.  A node's key is d with two 64-bit sums (exclusive or)
over hashes of (position, role, text), so the parent's key is the node's own
with its last turn taken out again, and prefix keys are running sums that
split: a long conversation is summed in blocks of ``BLOCK`` turns, with the
blocks' totals carried.

Subtree totals go up the tree by messages.  A *shard* is a connected piece of
the tree: the nodes below one top whose member counts lie in the same power of
``BAND`` and whose depths lie in the same block.  It has fewer than ``BAND``
nodes a level and ``BLOCK`` levels, however common a first turn is.  Within
shards, Spark sorts the nodes by reverse level order (an external sort) and
each task runs down that order with a priority queue of messages that spills
sorted runs; a node takes its children's messages off the queue, adds its own
values and sends the totals to its parent.  What a shard's top sends leaves
the shard: it is summed by receiver and handed to the shards of the next wave.
Waves go by band upwards, then by block upwards to the root, so every node is
processed once, after all that is below it.  There is one wave for each band
(logarithm of the number of conversations) and block of levels.

Defined results: null role or text is empty; ties in ``turn`` are ordered by
role, then text; a null turn comes first; repeated rows are turns of their
own.  A row with a null conv_id names no conversation and is left out.  An
empty table has no node, not even a root.  Extra columns are ignored, whatever
their names.  A node's text is turn ``depth`` of conversation ``conv_id``.
"""

from __future__ import annotations

import hashlib
import heapq
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stage, prepare

BAND_BITS, BLOCK, PIECE = 6, 4096, 8192
QUEUE = 1 << 18          # messages a task holds in memory; more go to sorted runs
KEY = ["d", "k1", "k2"]


# ------------------------------------------------------------ sequences

def sequences(turns: DataFrame, stage: Stage) -> DataFrame:
    """Turns as (conv_id, pos, a, b, len): position from 1, two hashes of
    (role, text), code points.  Rows are ranged by (conversation, turn), so
    one long conversation spreads over tasks."""
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                     F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
                     F.monotonically_increasing_id().alias("salt")).where("conv_id is not null")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "salt"]
    n = int(t.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = t.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # ids grow along the sorted partitions: partition in the upper bits, row in the lower
    t = stage.put(t.select("conv_id", F.monotonically_increasing_id().alias("at"), F.xxhash64(F.lit(1), "role", "text").alias("a"),
                           F.xxhash64(F.lit(2), "role", "text").alias("b"), F.length("text").cast("long").alias("len")), "turns")
    part = F.shiftright("at", 33)
    seg = t.groupBy("conv_id", part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    seg = seg.select(F.col("conv_id"), "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    return t.withColumn("part", part).join(seg, ["conv_id", "part"]).select(
        "conv_id", (F.col("at") + F.col("shift")).alias("pos"), "a", "b", "len")


def rebuilt(seq: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that start like the first of their hundred.

    Conversation c gets the first h turns of c - c % 100 (h = crc32 of c's
    decimal digits, mod 6), then its own turns after its first h.  Returns
    the rows (conv_id, d, a, b, len) and, per conversation, (conv_id, total)."""
    size = seq.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    c = F.col("conv_id")
    p = size.select(c, "n", (c - c % 100).alias("base"), (F.crc32(c.cast("string").cast("binary")) % 6).alias("h"))
    p = p.join(size.select(c.alias("base"), F.col("n").alias("base_n")), "base", "left")
    p = p.withColumn("lead", F.least("h", F.coalesce("base_n", F.lit(0))))
    p = p.withColumn("total", F.col("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    own = seq.join(p.select("conv_id", "h", "lead"), "conv_id").where("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("lead")).alias("d"), "a", "b", "len")
    heads = seq.where("pos <= 5").select(F.col("conv_id").alias("base"), "pos", "a", "b", "len")
    lead = p.where("lead > 0").select("conv_id", "base", "lead").join(heads, "base").where("pos <= lead").select(
        "conv_id", F.col("pos").alias("d"), "a", "b", "len")
    return own.unionByName(lead), p.select("conv_id", "total")


# ------------------------------------------------------------ keys

def paths(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per conversation and node on its path: own key, parent's key
    (p1, p2 at depth d - 1), length of the last text, ``last`` if it ends here."""
    z = rows.select("conv_id", "d", F.xxhash64(F.lit(3), "d", "a", "b").alias("z1"), F.xxhash64(F.lit(4), "d", "a", "b").alias("z2"),
                    "len", F.expr(f"d div {BLOCK}").alias("blk"))
    sums = z.groupBy("conv_id", "blk").agg(F.bit_xor("z1").alias("s1"), F.bit_xor("z2").alias("s2"), F.max("d").alias("upto"))
    before = Window.partitionBy("conv_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select("conv_id", "blk", *[F.coalesce(F.bit_xor(f"s{i}").over(before), F.lit(0).cast("long")).alias(f"c{i}") for i in (1, 2)])
    local = Window.partitionBy("conv_id", "blk").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    z = z.select("*", *[F.bit_xor(f"z{i}").over(local).alias(f"l{i}") for i in (1, 2)]).join(carry, ["conv_id", "blk"])
    key = [F.col(f"l{i}").bitwiseXOR(F.col(f"c{i}")) for i in (1, 2)]
    r = z.select("conv_id", "d", *[k.alias(f"k{i}") for i, k in zip((1, 2), key)],
                 *[k.bitwiseXOR(F.col(f"z{i}")).alias(f"p{i}") for i, k in zip((1, 2), key)], "len")
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", *[zero.alias(x) for x in ("d", "k1", "k2", "p1", "p2", "len")])
    return r.unionByName(root).join(convs, "conv_id").withColumn("last", F.col("d") == F.col("total")).drop("total")


# ------------------------------------------------------------ queue

class SpillingQueue:
    """Min-queue of integer tuples; beyond ``limit`` its items go to sorted
    runs in an unnamed file, which the task's end removes."""

    def __init__(self, width: int, limit: int = QUEUE):
        self.width, self.limit = width, limit
        self.heap: list[tuple] = []
        self.heads: list[tuple] = []       # (item, run number, iterator of the run)
        self.runs = 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            self.heap.sort()
            run = self._run(np.array(self.heap, np.int64))
            self.runs += 1
            heapq.heappush(self.heads, (next(run), self.runs, run))
            self.heap = []

    def _run(self, items: np.ndarray) -> Iterator[tuple]:
        f = tempfile.TemporaryFile()
        f.write(items.tobytes())
        f.seek(0)
        del items

        def read():
            with f:
                while block := f.read(8 * self.width * 4096):
                    yield from map(tuple, np.frombuffer(block, np.int64).reshape(-1, self.width).tolist())
        return read()

    def take(self, key: tuple) -> Iterator[tuple]:
        """Remove and give the items that begin with ``key``."""
        n = len(key)
        while True:
            if self.heap and self.heap[0][:n] == key:
                yield heapq.heappop(self.heap)
            elif self.heads and self.heads[0][0][:n] == key:
                item, i, run = self.heads[0]
                following = next(run, None)
                if following is None:
                    heapq.heappop(self.heads)
                else:
                    heapq.heapreplace(self.heads, (following, i, run))
                yield item
            else:
                return


_IN = [*KEY, "p1", "p2", "inside", "own", "children", "leaves", "saved"]
_OUT = T.StructType([T.StructField(c, T.LongType()) for c in [*KEY, "p1", "p2", "p_band", "p_blk", "inside", "n_children", "n_leaves", "saved"]])


def forward(batches: Iterator[pa.RecordBatch], limit: int = QUEUE) -> Iterator[pa.RecordBatch]:
    """Time-forward processing of one task's shards: rows come by depth
    (deepest first), then key; messages are ordered the same way."""
    q = SpillingQueue(6, limit)
    for b in batches:
        col = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
        ch, lv, sv = [], [], []
        for d, k1, k2, p1, p2, inside, own, c, leaves, s in zip(*[col[x] for x in _IN]):
            for m in q.take((-d, k1, k2)):
                c += 1
                leaves += m[4]
                s += m[5]
            leaves, s = leaves or 1, s + own
            if inside:
                q.push((1 - d, p1, p2, 0, leaves, s))
            ch.append(c)
            lv.append(leaves)
            sv.append(s)
        out = [b.column(b.schema.names.index(x)) for x in (*KEY, "p1", "p2", "p_band", "p_blk", "inside")]
        yield pa.RecordBatch.from_arrays([*out, *[pa.array(x, pa.int64()) for x in (ch, lv, sv)]], names=_OUT.names)


# ------------------------------------------------------------ ends

def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id) rows to comma-joined pieces of at most PIECE ids."""
    key, ids = None, []
    names = [*KEY, "first", "ids"]

    def piece():
        return [pa.array([x], pa.int64()) for x in (*key, ids[0])] + [pa.array([",".join(map(str, ids))])]

    for b in batches:
        rows = []
        for *k, c in zip(*[b.column(i).to_pylist() for i in range(4)]):
            if k != key or len(ids) == PIECE:
                if ids:
                    rows.append((*key, ids[0], ",".join(map(str, ids))))
                key, ids = k, []
            ids.append(c)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=names)
    if ids:
        yield pa.RecordBatch.from_arrays(piece(), names=names)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to one digest a node, in a stream."""
    key, h = None, None
    names = [*KEY, "ends_sha256"]
    for b in batches:
        rows = []
        for *k, _, ids in zip(*[b.column(i).to_pylist() for i in range(5)]):
            if k == key:
                h.update(b",")
            else:
                if h is not None:
                    rows.append((*key, h.hexdigest()))
                key, h = k, hashlib.sha256()
            h.update(ids.encode())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=names)
    if h is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, h.hexdigest())], names=names)


def ends(r: DataFrame) -> DataFrame:
    """Per node where conversations end: digest of their sorted ids.  Only
    the running digest of a node is sequential; ids are sorted and joined in
    pieces by many tasks."""
    keys = "d long, k1 long, k2 long"
    e = r.where("last").select(*KEY, "conv_id")
    n = int(r.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    e = e.repartitionByRange(n, *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    e = e.mapInArrow(_pieces, f"{keys}, first long, ids string")
    return e.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_hashes, f"{keys}, ends_sha256 string")


# ------------------------------------------------------------ trie

def trie(rows: DataFrame, convs: DataFrame, stage: Stage) -> DataFrame:
    """Nodes of the trie of sequences ``rows`` (conv_id, d, a, b, len) of the
    conversations ``convs`` (conv_id, total): conv_id (smallest member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256."""
    r = stage.put(paths(rows, convs), "paths")
    nodes = r.groupBy(*KEY).agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.max("len").alias("len"),
                                F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    nodes = stage.put(nodes.withColumn("band", F.expr(f"cast((length(bin(n)) - 1) div {BAND_BITS} as long)"))
                      .withColumn("blk", F.expr(f"d div {BLOCK}")), "nodes")
    # the top of a node's shard: its highest ancestor in the same band and block, read off the path of a member
    tops = r.select("conv_id", *KEY).join(nodes.select(*KEY, "band", "blk"), KEY).groupBy("conv_id", "band", "blk").agg(
        F.min_by("k1", "d").alias("t1"), F.min_by("k2", "d").alias("t2"))
    up = nodes.select((F.col("d") + 1).alias("d"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("rep").alias("parent"),
                      F.col("band").alias("p_band"), F.col("blk").alias("p_blk"))
    full = nodes.join(tops.withColumnRenamed("conv_id", "rep"), ["rep", "band", "blk"]).join(up, ["d", "p1", "p2"], "left")
    full = full.withColumn("inside", F.coalesce((F.col("p_band") == F.col("band")) & (F.col("p_blk") == F.col("blk")), F.lit(False)).cast("long"))
    full = stage.put(full, "shards")
    done = None
    waves = sorted(((x["band"], x["blk"]) for x in full.select("band", "blk").distinct().collect()), key=lambda x: (x[0], -x[1]))
    for i, (band, blk) in enumerate(waves):
        w = full.where((F.col("band") == band) & (F.col("blk") == blk))
        zero = F.lit(0).cast("long")
        if done is None:
            w = w.select("*", zero.alias("children"), zero.alias("leaves"), zero.alias("saved"))
        else:
            mail = done.where((F.col("inside") == 0) & (F.col("p_band") == band) & (F.col("p_blk") == blk)).groupBy(
                (F.col("d") - 1).alias("d"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
                F.count(F.lit(1)).alias("m_c"), F.sum("n_leaves").alias("m_l"), F.sum("saved").alias("m_s"))
            w = w.join(mail, KEY, "left").withColumns({a: F.coalesce(b, zero) for a, b in (("children", "m_c"), ("leaves", "m_l"), ("saved", "m_s"))})
        w = w.select(*[x for x in _IN if x != "own"], ((F.col("n") - 1) * F.col("len")).alias("own"), "p_band", "p_blk", "t1", "t2")
        w = w.repartition("t1", "t2").sortWithinPartitions(F.col("d").desc(), "k1", "k2")
        out = stage.put(w.drop("t1", "t2").mapInArrow(forward, _OUT), f"wave{i}")
        done = out if done is None else done.unionByName(out)
    if done is None:
        done = r.sparkSession.createDataFrame([], _OUT)
    none = hashlib.sha256(b"").hexdigest()
    out = full.select(*KEY, "rep", "parent", "n").join(done.select(*KEY, "n_children", "n_leaves", "saved"), KEY).join(ends(r), KEY, "left")
    return out.select(F.col("rep").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"),
                      F.col("n").alias("n_convs"), "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
                      F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The trie of the conversations as they are."""
    prepare(turns.sparkSession)
    stage = Stage(turns.sparkSession, "op12")
    seq = sequences(turns, stage)
    rows = seq.withColumnRenamed("pos", "d")
    return trie(rows, seq.groupBy("conv_id").agg(F.count(F.lit(1)).alias("total")), stage)


def shared_starts(turns: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations (see ``rebuilt``)."""
    prepare(turns.sparkSession)
    stage = Stage(turns.sparkSession, "op12")
    return trie(*rebuilt(sequences(turns, stage)), stage)
