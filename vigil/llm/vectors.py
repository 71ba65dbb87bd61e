"""Operator 10, embedding near-dedup with spherical-cap filters.

A filter is a random direction with a product structure: the coordinates are
rotated and cut into blocks, each block has a code of random directions, and a
filter concatenates one code word a block.  A vector is decoded to *all*
filters whose inner product exceeds the cap height: only words that can still
reach the height with the best word of the other block are combined.  Vectors
are joined on filters; a 128-bit sign sketch drops most chance meetings and
every remaining pair is verified by its cosine in double precision.

The cap height follows the number of vectors of that length: by the exact
tail of the sphere the expected share of vectors in a cap is ``LOAD / n``, so
lists stay short as the table grows.  Hits of one product code cluster, so the
code is small (a pair exactly at the threshold is expected to share ``SHARED``
of its filters) and is repeated under independent rotations.  How many is
measured, not assumed: ``plan`` decodes random pairs at exactly the threshold
under every rotation and adds rotations until the product of the measured
shares of pairs without a common filter is at most ``MISS``.  As rotations are
uniform, that share is the same for every pair at that cosine, and smaller for
closer ones.  The sketch's limit loses at most ``MISS`` of such pairs, too.

Vectors equal in every component form one class before the join, so copies
meet no one; a class of k copies gives each of them k - 1 links.

Defined results: vectors that are null, zero, or hold null or non-finite
components link with nothing (n_links 0, component their own id).  Only
vectors of the same length are compared.  Rows sharing a vec_id count as
separate vectors for n_links and as one node for components; a null vec_id
links like any other but is nobody's component.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, prepare
from .graph import components

THRESHOLD, SHARED, LOAD, MISS, SEED = 0.9, 1.0, 8.0, 1e-9, 20240131
PAIRS, MOST_TURNS, STEP = 400, 2000, 512
SIGN_BITS = 128
_ANGLES = np.linspace(0, np.pi, 20001)


def _tail(dim: int) -> np.ndarray:
    """Share of the unit sphere within each of ``_ANGLES`` of a direction."""
    c = np.cumsum(np.sin(_ANGLES) ** max(dim - 2, 0))
    return c / c[-1]


def parameters(n: int, dim: int, threshold: float = THRESHOLD) -> tuple[float, int]:
    """(cap height, code words per block) for n vectors of one length.  A cap
    is not made narrower than the threshold's own angle."""
    alpha = min(threshold, 1 - 1e-9)
    tail = _tail(dim)
    t = min(math.cos(np.interp(min(0.2, LOAD / max(n, 10)), tail, _ANGLES)), alpha)
    share = float(np.interp(math.acos(t), _ANGLES, tail))
    # chance that the second vector of a pair at the threshold passes too
    s = np.cos(_ANGLES[np.cos(_ANGLES) >= t])
    dens = np.sqrt(1 - s * s) ** max(dim - 2, 0)
    rest = (t - alpha * s) / np.maximum(math.sqrt(1 - alpha ** 2) * np.sqrt(1 - s * s), 1e-12)
    both = float((dens * np.interp(np.arccos(np.clip(rest, -1, 1)), _ANGLES, _tail(dim - 1))).sum() / dens.sum())
    return t, max(2, math.ceil(math.sqrt(SHARED / both / share)))


def sign_most(threshold: float = THRESHOLD) -> int:
    """Differing sketch bits that a pair at the threshold exceeds with a
    probability of at most ``MISS``."""
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    over = 0.0
    for k in range(SIGN_BITS, 0, -1):
        over += math.comb(SIGN_BITS, k) * p ** k * (1 - p) ** (SIGN_BITS - k)
        if over > MISS:
            return k
    return 0


class Caps:
    """Code words of one dimension, equal on every executor.  Turn k holds,
    for both blocks, the rotated code words as columns."""

    def __init__(self, dim: int, height: float, words: int):
        self.dim, self.height, self.words = dim, height, words
        self.signs = np.random.default_rng([SEED, dim]).standard_normal((SIGN_BITS, dim))
        self.turns: list[tuple[np.ndarray, np.ndarray]] = []

    def turn(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.turns) <= k:
            rng = np.random.default_rng([SEED, self.dim, len(self.turns)])
            q, r = np.linalg.qr(rng.standard_normal((self.dim, self.dim)))
            q *= np.sign(np.diag(r))
            codes = []
            for p in np.array_split(np.arange(self.dim), 2):
                c = rng.standard_normal((self.words, len(p)))
                norm = np.linalg.norm(c, axis=1, keepdims=True)
                # each block carries its share of the filter's unit length
                c = c / np.where(norm > 0, norm, 1) * math.sqrt(len(p) / self.dim)
                codes.append((q[:, p] @ c.T).astype(np.float32))
            self.turns.append(tuple(codes))
        return self.turns[k]

    def decode(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters of turn k exceeded by the rows of x,
        unit vectors."""
        x = x.astype(np.float32)
        s, u = (x @ c for c in self.turn(k))
        r1, w1 = np.nonzero(s >= (self.height - u.max(axis=1))[:, None])
        r2, w2 = np.nonzero(u >= (self.height - s.max(axis=1))[:, None])
        per = np.bincount(r2, minlength=len(x))
        n = per[r1]                            # every word of the one block with all of the other
        a = np.repeat(np.arange(len(r1)), n)
        b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + (np.cumsum(per) - per)[r1[a]]
        hit = s[r1[a], w1[a]] + u[r2[b], w2[b]] >= self.height
        a, b = a[hit], b[hit]
        return r1[a], (np.int64(k) * self.words + w1[a]) * self.words + w2[b]

    def sketch(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(x @ self.signs.T > 0, axis=1).view(np.int64)


_caps: dict[tuple, Caps] = {}


def caps(dim: int, height: float, words: int) -> Caps:
    if (dim, height, words) not in _caps:
        _caps[dim, height, words] = Caps(dim, height, words)
    return _caps[dim, height, words]


def pairs_at(rng: np.random.Generator, n: int, dim: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """n random pairs of unit vectors at the cosine (equal ones in one dimension)."""
    x, g = rng.standard_normal((2, n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if dim == 1:
        return x, x
    g -= (g * x).sum(axis=1, keepdims=True) * x
    g /= np.linalg.norm(g, axis=1, keepdims=True)
    return x, cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * g


def plan(n: int, dim: int, threshold: float = THRESHOLD) -> tuple[float, int, int]:
    """(cap height, code words per block, rotations) for n vectors of one length."""
    height, words = parameters(n, dim, threshold)
    c = caps(dim, height, words)
    rng = np.random.default_rng([SEED, dim, n])
    left = 0.0
    for k in range(MOST_TURNS):
        x, y = pairs_at(rng, PAIRS, dim, threshold)
        (i, f), (j, g) = c.decode(x, k), c.decode(y, k)
        both = np.intersect1d(np.stack([i, f], 1).view("i8,i8"), np.stack([j, g], 1).view("i8,i8"))["f0"]
        left += math.log((PAIRS - len(np.unique(both)) + 1) / (PAIRS + 1))
        if left <= math.log(MISS):
            return height, words, k + 1
    raise ValueError(f"no set of caps finds pairs of length {dim} at cosine {threshold}")


def _decode(plans: dict[int, tuple[float, int, int]]):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.asarray(b.column(1).value_lengths())
            flat, first = np.asarray(b.column(1).flatten(), np.float64), np.cumsum(size) - size
            for dim in np.unique(size).tolist():
                height, words, turns = plans[dim]
                c, mine = caps(dim, height, words), np.flatnonzero(size == dim)
                for rows in np.split(mine, range(STEP, len(mine), STEP)):
                    x = flat[first[rows][:, None] + np.arange(dim)]
                    x /= np.abs(x).max(axis=1, keepdims=True)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    found = [c.decode(x, k) for k in range(turns)]
                    at = np.concatenate([r for r, _ in found])
                    order = np.argsort(at, kind="stable")
                    at, sk = at[order], c.sketch(x)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(rows[at])), pa.array(np.full(len(at), dim, np.int32)),
                         pa.array(np.concatenate([f for _, f in found])[order]), pa.array(sk[at, 0]), pa.array(sk[at, 1])],
                        names=["cls", "dim", "filter", "s1", "s2"])
    return fn


def _verify(threshold: float):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                p, q = np.asarray(x.values, np.float64), np.asarray(y.values, np.float64)
                p, q = p / np.abs(p).max(), q / np.abs(q).max()
                ok.append(float(p @ q) >= threshold * math.sqrt(float(p @ p) * float(q @ q)))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])
    return fn


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, vec: str = "embedding") -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    prepare(spark)
    stage = Stage(spark, "vectors")
    v = F.col("embedding")
    good = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("embedding"))
    # -0.0 + 0.0 = 0.0, so equal vectors hash alike
    plus = F.transform(v, lambda x: x + F.lit(0.0))
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False))).withColumn(
        "h1", F.when(F.col("good"), F.xxhash64(plus))).withColumn("h2", F.when(F.col("good"), F.hash(plus)))
    rows = stage.put(rows, "rows")
    live = rows.where("good")
    # a class: equal vectors; its key is the pair of hashes
    size = stage.put(live.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("rep"))
                     .withColumn("cls", F.xxhash64("h1", "h2")), "classes")
    one = live.join(size.select("rep", "h1", "h2", "cls"), ["h1", "h2"])
    one = one.where(F.col("vec_id").eqNullSafe(F.col("rep"))).dropDuplicates(["cls"]).select("cls", "embedding")
    one = stage.put(one, "vectors")
    # lengths in the table are few; each has its own sphere
    counts = one.groupBy(F.size("embedding").alias("dim")).count().collect()
    plans = {r["dim"]: plan(r["count"], r["dim"], threshold) for r in counts}
    post = stage.put(one.mapInArrow(_decode(plans), "cls long, dim int, filter long, s1 long, s2 long"), "filters")
    p, q = post.alias("p"), post.alias("q")
    cond = F.expr(f"p.filter = q.filter and p.dim = q.dim and p.cls < q.cls and bit_count(p.s1 ^ q.s1) + bit_count(p.s2 ^ q.s2) <= {sign_most(threshold)}")
    pairs = stage.put(p.join(q, cond).select(F.col("p.cls").alias("a"), F.col("q.cls").alias("b")).distinct(), "pairs")
    a, b = (one.select(F.col("cls").alias(k), F.col("embedding").alias(f"v{k}")) for k in "ab")
    links = stage.put(pairs.join(a, "a").join(b, "b").select("a", "b", "va", "vb").mapInArrow(_verify(threshold), "a long, b long"), "links")

    n = size.select("cls", "copies")
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    deg = (ends.join(n.withColumnRenamed("cls", "b"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
           .withColumnRenamed("a", "cls"))
    comp = components(links, stage).select(F.col("node").alias("cls"), "component")
    full = size.join(deg, "cls", "left").join(comp, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    low = full.groupBy("component").agg(F.min("rep").alias("component_id"))
    full = full.join(low, "component").select("h1", "h2", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.join(full, ["h1", "h2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").isNull() | (F.col("vec_id") == F.col("component_id")))
