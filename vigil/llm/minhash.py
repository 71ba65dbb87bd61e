"""Operator 2, near-dedup by bottom-k sketches.

One hash function; a document's sketch is the k smallest hashes of its
distinct 5-word shingles.  Documents with equal shingle sets form a class and
only one representative goes on, so thousands of copies cost one row each.
Inverted lists of the retained values generate overlaps; the union sketch
(k smallest of both sketches) estimates the similarity and filters; the exact
Jaccard of the full shingle sets verifies every link.

A pair that reaches the threshold shares, with overwhelming probability, at
least ``k * floor_share`` retained values (k = 64, floor 0.47 against an
expected 0.75: more than five standard deviations).  So of its values, taken
rarest first, only the first ``size - t + 1`` need a list entry; most
documents have none, because a value seen once needs no list.

Links are found in rounds.  First every list compares its members with its
smallest member.  Hub rounds follow: in lists that hold different components,
members meet two heads drawn at random, so a group whose members link with
many others, though not with its smallest, soon is one component at a cost of
two pairs an entry and round.  Last, documents of *different* components that
still share a list are compared wherever exact bounds on their full sets allow
a link (see ``_prefix_pairs``).  What one round joined needs no second look:
components, not pairs, are the result; the number of hub rounds changes only
how many pairs the last round meets.

Defined results: a null or empty text has no shingles and links with
nothing.  With fewer than 5 words the whole sequence is the one shingle.
Rows with equal doc_id count as one node; a null doc_id links with nothing
and has a null component.  Extra columns are ignored here and kept by
``dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X
from .common import packed, prepare, Stage
from .graph import components

K, SHINGLE, FLOOR = 64, 5, 0.47
NUM, DEN = 75, 100
HUB_ROUNDS = 2                 # at most; a cost, the result is the same for any number
ODD = 8
ODDS = [f"odd{i}" for i in range(ODD)]
SALT = X.U(0x5851F42D4C957F2D)


def _shingles(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for lo, hi in X.groups(texts):
        w = X.Words(texts[lo:hi], lower=True)
        h = w.hashes()
        g = X.grams(h, size)
        for i in range(hi - lo):
            a, b = w.first[i], w.first[i + 1]
            if b - a >= size:
                yield np.unique(g[a:b - size + 1])
            elif b > a:
                yield X.grams(h[a:b], int(b - a)) ^ X.U(b - a)
            else:
                yield np.empty(0, X.U)


def _sketches(k: int, size: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, s1, s2, sk = [], [], [], []
            with np.errstate(over="ignore"):
                for s in _shingles(X.texts_of(b), size):
                    n.append(len(s))
                    s1.append(int(np.add.reduce(X.mix(s ^ SALT), dtype=X.U).view(np.int64)))
                    s2.append(int(np.bitwise_xor.reduce(X.mix(s + SALT)).view(np.int64)) if len(s) else 0)
                    sk.append(s[:k].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()),
                 pa.array(sk, pa.list_(pa.int64()))], names=["doc_id", "n", "s1", "s2", "sketch"])
    return fn


def _sets(size: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(_shingles(X.texts_of(b), size))
            odd = np.array([_odd(s) for s in sets], np.int64).reshape(-1, ODD)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                                              *[pa.array(odd[:, i]) for i in range(ODD)]], names=["rep", "hashes", *ODDS])
    return fn


def _odd(hashes: np.ndarray) -> np.ndarray:
    """Parity of the set in 64 * ODD cells.  Every element of a symmetric
    difference flips one cell, so two parities differ in at most as many
    cells as the sets differ in elements."""
    cells = np.bincount((X.mix(hashes + SALT) % X.U(64 * ODD)).astype(np.int64), minlength=64 * ODD) & 1
    return np.packbits(cells.astype(np.uint8)).view(np.int64)


def _exact(num: int, den: int):
    """Pairs (a, b, set of a, set of b) whose Jaccard reaches num / den."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                p, q = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(den * both >= num * (len(p) + len(q) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])
    return fn


def _est_ok(k: int, floor: float):
    """Union-sketch estimate: of the k smallest of both, the share in both."""
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, k)
    return F.size(F.array_intersect(F.array_intersect("sa", "sb"), union)) >= F.floor(F.size(union) * F.lit(floor))


def _prefix_pairs(docs: DataFrame, stage: Stage, num: int, den: int) -> DataFrame:
    """Pairs of different components that can still reach the threshold.

    ``docs``: rep, n, component, hashes (the full set) and its parity cells.
    Exact bounds only, no estimate: a document's values are ordered rarest first, and a partner must
    share one of the first ``n - ceil(0.75 n) + 1``.  Values nobody else holds
    can't be shared, so they bound the overlap, hence the partner's size, and
    lists are keyed by value and size class.  In each list only members
    outside its commonest component ask, since two members of one component
    need no comparison, and a pair whose parities already differ in more cells
    than the threshold leaves to the symmetric difference goes no further."""
    x = docs.select("rep", "n", "component", F.explode("hashes").alias("value"))
    df = x.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    df = stage.put(df, "df2")
    own = (x.join(df, "value").groupBy("rep", "n", "component")
           .agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("vals")).withColumn("m", F.size("vals"))
           .where(F.col("m") * den >= F.col("n") * num))
    own = own.withColumn("lo", F.ceil(F.col("n") * num / F.lit(den)).cast("long"))
    most = F.least(F.floor(F.col("m") * (num + den) / F.lit(num)) - F.col("n"), F.floor(F.col("n") * den / F.lit(num)))
    own = own.withColumn("hi", most.cast("long")).where("lo <= hi")
    head = F.expr("posexplode(slice(vals, 1, cast(m - lo + 1 as int)))")
    entry = own.select("rep", "n", "component", "m", "lo", "hi", head.alias("i", "v"))
    entry = entry.select("rep", "n", "component", "m", "lo", "hi", "i", F.col("v.value").alias("value"))
    entry = stage.put(entry.join(docs.select("rep", *ODDS), "rep"), "entries")
    per = entry.groupBy("value", "component").agg(F.count(F.lit(1)).alias("c"))
    top = per.groupBy("value").agg(F.max(F.struct("c", "component")).alias("top"), F.count(F.lit(1)).alias("k")).where("k > 1")
    top = stage.put(top.select("value", F.col("top.component").alias("common")), "top")

    def size_class(n):
        return F.floor(F.log(n) / F.lit(0.14)).cast("int")

    ask = (entry.join(top, "value").where("component <> common").drop("common")
           .withColumn("size", F.explode(F.sequence(size_class(F.col("lo")), size_class(F.col("hi"))))))
    p, q = ask.alias("p"), entry.withColumn("size", size_class(F.col("n"))).alias("q")
    differ = " + ".join(f"bit_count(p.{o} ^ q.{o})" for o in ODDS)
    cond = F.expr(f"""p.value = q.value and p.size = q.size and p.component <> q.component
        and q.n between p.lo and p.hi and p.n between q.lo and q.hi
        and (least(p.i, q.i) + least(p.m - p.i, q.m - q.i)) * {num + den} >= {num} * (p.n + q.n)
        and ({differ}) * {num + den} <= {den - num} * (p.n + q.n)""")
    pairs = p.join(q, cond).select(F.greatest("p.rep", "q.rep").alias("a"), F.least("p.rep", "q.rep").alias("b")).distinct()
    return stage.put(pairs, "pairs")


def _mixed(lists: DataFrame, comp: DataFrame) -> DataFrame:
    """The entries of lists that hold documents of two components or more."""
    lab = lists.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
    lab = lab.withColumn("component", F.coalesce("component", "rep"))
    ends = lab.groupBy("value").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1")
    return lab.join(ends.select("value"), "value", "left_semi")


def _hub_pairs(mixed: DataFrame, stage: Stage, turn: int) -> DataFrame:
    """Each member against two heads of its list, where their components differ.
    The order that chooses heads is drawn anew for each turn and is one for all
    lists, so that the lists of a large group agree on few heads."""
    x = mixed.withColumn("draw", F.xxhash64("rep", F.lit(turn)))
    me = F.struct("draw", "rep", "component")
    head = stage.put(x.groupBy("value").agg(F.array(F.min(me), F.max(me)).alias("heads")), f"heads{turn}")
    head = head.select("value", F.explode("heads").alias("h")).select("value", F.col("h.rep").alias("b"), F.col("h.component").alias("cb"))
    return mixed.join(head, "value").where("component <> cb").select(
        F.greatest("rep", "b").alias("a"), F.least("rep", "b").alias("b")).distinct()


def _merged(comp: DataFrame, links: DataFrame, stage: Stage, tag: str) -> DataFrame:
    """Components after ``links`` more, found on the graph of the components
    that they join."""
    a, b = (comp.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    ends = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    met = components(ends, stage, tag).select(F.col("node").alias("old"), F.col("component").alias("new"))
    old = comp.join(met, comp.component == met.old, "left").select("node", F.coalesce("new", "component").alias("component"))
    alone = met.join(comp, met.old == comp.node, "left_anti").select(F.col("old").alias("node"), F.col("new").alias("component"))
    return old.unionByName(alone)


def near_duplicates(docs: DataFrame, num: int = NUM, den: int = DEN, k: int = K, size: int = SHINGLE,
                    floor: float = FLOOR, hub_rounds: int = HUB_ROUNDS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    prepare(spark)
    stage = Stage(spark, "minhash")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stage.put(base.mapInArrow(_sketches(k, size), "doc_id long, n long, s1 long, s2 long, sketch array<long>"), "rows")

    # classes of equal sets, one representative each
    live = rows.where("n > 0 and doc_id is not null")
    reps = stage.put(live.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep")), "reps")
    cls = live.join(reps.select(F.col("rep").alias("doc_id"), "n", "s1", "s2"), ["doc_id", "n", "s1", "s2"], "left_semi")

    # inverted lists of the values that occur again
    post = cls.select(F.col("doc_id").alias("rep"), "n", F.size("sketch").alias("kept"), F.explode("sketch").alias("value"))
    df = post.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    df = stage.put(df, "df")               # written, so that joins can split a hot value
    t = F.greatest(F.lit(1), F.floor(F.col("kept") * F.lit(floor)))
    own = (post.join(df, "value").groupBy("rep", "n", "kept")
           .agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("vals")))
    own = own.select("rep", "n", F.size("vals").alias("m"), t.cast("int").alias("t"), "vals").where("m >= t")
    lists = stage.put(own.select("rep", "n", "m", "t", F.posexplode(F.expr("slice(vals, 1, m - t + 1)")).alias("i", "x"))
                      .select("rep", "n", "m", "t", "i", F.col("x.value").alias("value")), "lists")
    # full sets and sketches of the documents that have list entries
    ids = lists.select("rep").distinct()
    sets = stage.put(base.join(ids, base.doc_id == ids.rep, "left_semi").mapInArrow(_sets(size), "rep long, hashes array<long>, " + ", ".join(f"{o} long" for o in ODDS)), "sets")
    sk = stage.put(cls.select(F.col("doc_id").alias("rep"), "sketch").join(ids, "rep", "left_semi"), "sketches")

    def exact(pairs: DataFrame, tag: str) -> DataFrame:
        a, b = (sets.select(F.col("rep").alias(x), F.col("hashes").alias(f"h{x}")) for x in "ab")
        full = pairs.join(a, "a").join(b, "b").select("a", "b", "ha", "hb")
        return stage.put(full.mapInArrow(_exact(num, den), "a long, b long"), f"links{tag}")

    def likely(pairs: DataFrame, tag: str) -> DataFrame:
        a, b = (sk.select(F.col("rep").alias(x), F.col("sketch").alias(f"s{x}")) for x in "ab")
        return stage.put(pairs.join(a, "a").join(b, "b").where(_est_ok(k, floor)).select("a", "b"), f"likely{tag}")

    # hub rounds: the members of a list against its heads, smallest id first,
    # then two drawn anew in every round, until a round joins nothing
    lists = lists.select("rep", "n", "value")
    head = stage.put(lists.groupBy("value").agg(F.min("rep").alias("b")), "heads")
    links = exact(likely(lists.join(head, "value").where("rep <> b").select(F.col("rep").alias("a"), "b").distinct(), "0"), "0")
    comp = stage.put(components(links, stage, "cc0"), "comp0")
    for turn in range(1, hub_rounds + 1):
        mixed = stage.put(_mixed(lists, comp), f"mixed{turn}")
        links = exact(likely(_hub_pairs(mixed, stage, turn), str(turn)), str(turn))
        if links.isEmpty():
            break
        comp = stage.put(_merged(comp, links, stage, f"cc{turn}"), f"comp{turn}")
    # last round: documents of different components that still share a list
    open_ = stage.put(_mixed(lists, comp).select("rep", "n", "component").distinct(), "open")
    more = exact(_prefix_pairs(open_.join(sets, "rep"), stage, num, den), "last")
    comp = stage.put(_merged(comp, more, stage, "cc-last"), "comp-last")

    member = reps.join(comp, reps.rep == comp.node, "left").select("n", "s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    linked = rows.join(member, ["n", "s1", "s2"], "left")
    comp_id = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    out = linked.select("doc_id", F.col("n").alias("n_shingles"), comp_id.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def dedup(docs: DataFrame, **how) -> DataFrame:
    """``docs`` without the documents of a group other than its smallest id."""
    found = near_duplicates(docs, **how).where("not kept").select(F.col("doc_id").alias("nd_id")).distinct()
    rows = docs.select(packed(docs), F.col("doc_id").cast("long").alias("id"))
    return rows.join(found, F.col("id") == F.col("nd_id"), "left_anti").select("row.*")
