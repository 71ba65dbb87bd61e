"""Operator 11, ranked lexical search over hashed max-sketches.

Terms are runs of ASCII letters, digits and non-ASCII characters, with only
A-Z lower-cased.  With N documents that have a term, L terms in all, df
documents holding a term: a term weighs w = floor(1000 ln((2N+2)/(2df+1))),
and a document of n terms that holds it tf times has the impact
(10^9 tf) div (1000 tf + 8 m), m = 25 + (75 n N) div L.  A document's score
for an item is the sum of w * impact over the item's terms.

A document's sketch is ``ROWS`` arrays, each indexed by another hash of the
term; a coordinate holds the maximum over the terms that fall on it.  Within a
document the impact grows with tf alone, so the maxima are taken of tf (one
byte, 255 standing for the limit of the impact) and turned into impacts once N
and L are known.  An array has four to eight coordinates a distinct term, so a
term's smallest value over the rows is hardly ever too large, never too small.

Items are looked up in batches of about ``BATCH_TERMS`` terms.  For a batch:

1. a pass over the sketches gives every document's upper bound for every item;
   the ``SEEDS`` highest bounds of each item are scored exactly, which gives a
   threshold: the item's tenth score so far;
2. a second pass keeps the (item, document) pairs whose bound reaches it;
3. those are scored exactly in descending order of bound, in rounds, while a
   bound still reaches the threshold.

Equal texts score alike, so of each item's candidates with equal text only
the ``k`` smallest ids go on.  No document is left out otherwise: what is
never scored has a bound below the final k-th score, or equals it with a
larger id.  The sketches are written once and serve all batches; nothing but
a batch's terms, weights and thresholds reaches the driver.

Defined results: a null or empty text has no terms and is never found; an item
without terms has no rows.  Repeated item rows are ranked each for itself;
rows that share a doc_id are documents of their own; a null doc_id sorts
first.  Extra columns are ignored.  Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as X
from .common import Stage, prepare, same

ROWS, SPREAD = 4, 4
BATCH_TERMS = 1 << 16
SEEDS, GROWTH = 32, 8
BROADCAST_PAIRS = 1 << 18        # candidate lists up to this many pairs are broadcast, longer ones shuffled
CELLS = 1 << 21                  # documents x items bounded at once

TERM = np.zeros(256, bool)
TERM[48:58] = TERM[65:91] = TERM[97:123] = TERM[128:] = True
TURN = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


class Terms(X.Words):
    """Terms of consecutive texts."""

    def __init__(self, texts: list[bytes]):
        self.raw = b"\n".join(texts) + b"\n"
        self.buf = X.LOWER[np.frombuffer(self.raw, np.uint8)]
        d = np.flatnonzero(np.diff(TERM[self.buf].view(np.int8), prepend=np.int8(0)))
        self.starts, self.ends = d[0::2], d[1::2]
        self.at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=self.at[1:])
        self.first = np.searchsorted(self.starts, self.at)


def counted(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, term hash, tf) of each distinct term, by document, and the
    number of terms of each document."""
    t = Terms(texts)
    h, n = t.hashes(), np.diff(t.first)
    doc = np.repeat(np.arange(len(texts)), n)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))) if len(h) else np.empty(0, np.int64)
    return doc[new], h[new], np.diff(np.append(new, len(h))), n


def sketches(doc: np.ndarray, h: np.ndarray, tf: np.ndarray, size: int) -> list[bytes]:
    """The max-sketch of each document; empty without terms."""
    distinct = np.bincount(doc, minlength=size)
    bits = np.maximum(4, np.ceil(np.log2(np.maximum(1, SPREAD * distinct))).astype(np.int64))
    width = np.where(distinct > 0, np.int64(1) << bits, 0)
    at = np.concatenate(([0], np.cumsum(ROWS * width)))
    cells = np.zeros(at[-1], np.uint8)
    top, shift = np.minimum(tf, 255).astype(np.uint8), (64 - bits[doc]).astype(np.uint64)
    for r in range(ROWS):
        np.maximum.at(cells, at[doc] + r * width[doc] + ((h * TURN[r]) >> shift).astype(np.int64), top)
    raw = cells.tobytes()
    return [raw[at[i]:at[i + 1]] for i in range(size)]


def impact(tf, m):
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Batch:
    """The terms of some items and, once known, their weights."""

    def __init__(self, qids: list[int], terms: list[list[int]]):
        self.qids = np.array(qids, np.int64)
        h = [np.unique(np.array(t, np.int64).view(np.uint64), return_counts=True) for t in terms]
        self.vocab = np.unique(np.concatenate([x for x, _ in h]))
        self.term = np.concatenate([np.searchsorted(self.vocab, x) for x, _ in h])
        self.count = np.concatenate([c for _, c in h]).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum([len(x) for x, _ in h])))[:-1]

    def weigh(self, n_docs: int, n_terms: int, df: dict[int, int]) -> None:
        w = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(self.vocab))]
        self.weight = self.count * np.array(w, np.int64)[self.term]
        self.n_docs, self.n_terms = n_docs, n_terms

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices into ``h`` of the batch's terms, and which terms they are."""
        i = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        at = np.flatnonzero(self.vocab[i] == h)
        return at, i[at]

    def m(self, n: int) -> int:
        return 25 + (75 * n * self.n_docs) // self.n_terms

    def totals(self, impacts: np.ndarray) -> np.ndarray:
        """Per item, the sum of weighted impacts (one impact a vocabulary term)."""
        return np.add.reduceat(impacts[self.term] * self.weight, self.first)

    def bound(self, sketch: bytes, n: int, places: dict[int, np.ndarray]) -> np.ndarray:
        cells = np.frombuffer(sketch, np.uint8)
        width = len(cells) // ROWS
        at = places.get(width)
        if at is None:
            shift = np.uint64(65 - width.bit_length())
            at = places[width] = np.stack([((self.vocab * TURN[r]) >> shift).astype(np.int64) + r * width for r in range(ROWS)])
        tf = cells[at].min(axis=0)
        table = impact(np.arange(256, dtype=np.int64), self.m(n))
        table[255] = 1_000_000
        return self.totals(table[tf])

    def bounds(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        """Rows of the sketch table, a few at a time, with a bound an item."""
        step, places = max(1, CELLS // len(self.qids)), {}
        for b in batches:
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                rows = zip(part.column("sketch").to_pylist(), part.column("n").to_pylist())
                yield part, np.stack([self.bound(s, n, places) for s, n in rows])


# ------------------------------------------------------------ passes over the corpus

def _counts(vocab: np.ndarray, keep: bool):
    """Rows (doc_id, n, same_text, sketch) if ``keep``, then (term, df) of the vocabulary."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(vocab), np.int64)
        names = ["doc_id", "n", "same_text", "sketch", "term", "df"]
        for b in batches:
            texts, ids = X.texts_of(b), b.column("doc_id")
            for lo, hi in X.groups(texts):
                doc, h, tf, n = counted(texts[lo:hi])
                i = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
                df += np.bincount(i[vocab[i] == h], minlength=len(vocab))
                if keep:
                    key = [hashlib.blake2b(t, digest_size=16).digest() for t in texts[lo:hi]]
                    none = pa.nulls(hi - lo, pa.int64())
                    yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), X.longs(n), pa.array(key, pa.binary()),
                                                      pa.array(sketches(doc, h, tf, hi - lo), pa.binary()), none, none], names=names)
        at = np.flatnonzero(df)
        none = [pa.nulls(len(at), t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*none, X.longs(at), X.longs(df[at])], names=names)
    return fn


_COUNTS = "doc_id long, n long, same_text binary, sketch binary, term long, df long"


def _seeds(batch: Batch):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = len(batch.qids)
        top, ids, null = np.zeros((SEEDS, q), np.int64), np.zeros((SEEDS, q), np.int64), np.zeros((SEEDS, q), bool)
        for part, b in batch.bounds(batches):
            col = part.column("doc_id")
            own = np.broadcast_to(np.asarray(col.fill_null(0))[:, None], b.shape)
            nul = np.broadcast_to(np.asarray(col.is_null().to_numpy(zero_copy_only=False))[:, None], b.shape)
            top, ids, null = np.vstack((top, b)), np.vstack((ids, own)), np.vstack((null, nul))
            best = np.argpartition(-top, SEEDS - 1, axis=0)[:SEEDS]
            top, ids, null = (np.take_along_axis(x, best, 0) for x in (top, ids, null))
        r, c = np.nonzero(top)
        yield pa.RecordBatch.from_arrays([X.longs(batch.qids[c]), pa.array(ids[r, c], mask=null[r, c]), X.longs(top[r, c])],
                                         names=["qid", "doc_id", "bound"])
    return fn


def _reaching(batch: Batch, floor: np.ndarray):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, b in batch.bounds(batches):
            r, c = np.nonzero(b >= floor)
            yield pa.RecordBatch.from_arrays([X.longs(batch.qids[c]), part.column("doc_id").take(pa.array(r)), X.longs(b[r, c]),
                                              part.column("same_text").take(pa.array(r))], names=["qid", "doc_id", "bound", "same_text"])
    return fn


def _exact(batch: Batch):
    """Rows (doc_id, text, qids) to (qid, doc_id, score), scores above 0."""
    order = np.argsort(batch.qids)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, wanted, at, qid, score = X.texts_of(b), b.column("qids").to_pylist(), [], [], []
            for lo, hi in X.groups(texts):
                doc, h, tf, n = counted(texts[lo:hi])
                i, term = batch.hits(h)
                cut = np.searchsorted(doc[i], np.arange(hi - lo + 1))
                for d in range(hi - lo):
                    mine = slice(cut[d], cut[d + 1])
                    impacts = np.zeros(len(batch.vocab), np.int64)
                    impacts[term[mine]] = impact(tf[i[mine]], batch.m(int(n[d])))
                    ask = np.array(wanted[lo + d], np.int64)
                    got = batch.totals(impacts)[order[np.searchsorted(batch.qids, ask, sorter=order)]]
                    at.append(np.full(len(ask), lo + d))
                    qid.append(ask)
                    score.append(got)
            if at:
                at, qid, score = map(np.concatenate, (at, qid, score))
                up = score > 0
                yield pa.RecordBatch.from_arrays([X.longs(qid[up]), b.column("doc_id").take(pa.array(at[up])), X.longs(score[up])],
                                                 names=["qid", "doc_id", "score"])
    return fn


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = X.texts_of(b)
        terms = []
        for lo, hi in X.groups(texts):
            t = Terms(texts[lo:hi])
            h = t.hashes().view(np.int64)
            terms += [h[a:z] for a, z in zip(t.first[:-1], t.first[1:])]
        yield pa.RecordBatch.from_arrays([b.column("qid"), b.column("item_id"), pa.array(terms, pa.list_(pa.int64()))],
                                         names=["qid", "item_id", "terms"])


# ------------------------------------------------------------ search

def _score(docs: DataFrame, pairs: DataFrame, batch: Batch) -> DataFrame:
    """Exact scores of candidate pairs.  A list of proven size is broadcast
    (no text moves); a longer one meets the documents in a shuffle."""
    by_doc = pairs.groupBy("doc_id").agg(F.collect_list("qid").alias("qids")).withColumnRenamed("doc_id", "c_doc")
    if pairs.count() <= BROADCAST_PAIRS:
        by_doc = F.broadcast(by_doc)
    hit = docs.join(by_doc, same(F.col("doc_id"), F.col("c_doc"))).select("doc_id", "text", "qids")
    return hit.mapInArrow(_exact(batch), "qid long, doc_id long, score long")


def _first(scores: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _floor(batch: Batch, best: DataFrame, k: int) -> dict[int, tuple[int, int | None]]:
    """Per item with k documents so far: the k-th score and its doc_id (at most one row an item)."""
    return {r["qid"]: (r["score"], r["doc_id"]) for r in best.where(F.col("rank") == k).select("qid", "score", "doc_id").collect()}


def _rank_batch(docs: DataFrame, index: DataFrame, batch: Batch, stage: Stage, tag: str, k: int) -> DataFrame:
    spark = docs.sparkSession
    order = Window.partitionBy("qid").orderBy(F.col("bound").desc(), F.col("doc_id").asc_nulls_first())
    seeds = index.select("doc_id", "n", "sketch").mapInArrow(_seeds(batch), "qid long, doc_id long, bound long")
    seeds = seeds.withColumn("place", F.row_number().over(order)).where(F.col("place") <= SEEDS)
    seeds = stage.put(seeds.select("qid", "doc_id").distinct(), f"{tag}-seeds")
    best = stage.put(_first(_score(docs, seeds, batch), k), f"{tag}-best0")

    floor = _floor(batch, best, k)
    least = np.array([floor.get(int(q), (1,))[0] for q in batch.qids], np.int64)
    cand = index.mapInArrow(_reaching(batch, least), "qid long, doc_id long, bound long, same_text binary")
    alike = Window.partitionBy("qid", "same_text").orderBy(F.col("doc_id").asc_nulls_first())
    cand = cand.withColumn("copy", F.row_number().over(alike)).where(F.col("copy") <= k)
    gone = seeds.select(F.col("qid").alias("s_qid"), F.col("doc_id").alias("s_doc"))
    cand = cand.join(gone, (F.col("qid") == F.col("s_qid")) & same(F.col("doc_id"), F.col("s_doc")), "left_anti")
    # rows that share a doc_id are scored together, so a pair stands once, with its highest bound
    cand = stage.put(cand.groupBy("qid", "doc_id").agg(F.max("bound").alias("bound")), f"{tag}-cand")
    cand = stage.put(cand.withColumn("place", F.row_number().over(order)), f"{tag}-order")

    done, upto, r = 0, SEEDS, 1
    while True:
        limits = [(int(q), *floor.get(int(q), (1, None)), int(q) in floor) for q in batch.qids]
        limits = F.broadcast(spark.createDataFrame(limits, "f_qid long, f_score long, f_doc long, full boolean"))
        open_ = cand.where(F.col("place") > done).join(limits, F.col("qid") == F.col("f_qid")).where(
            (F.col("bound") > F.col("f_score")) | ((F.col("bound") == F.col("f_score")) & (
                ~F.col("full") | F.col("doc_id").isNull() | (F.col("doc_id") < F.col("f_doc")))))
        if open_.isEmpty():
            return best
        now = stage.put(open_.where(F.col("place") <= upto).select("qid", "doc_id"), f"{tag}-round{r}")
        scored = _score(docs, now, batch).unionByName(best.select("qid", "doc_id", "score"))
        best = stage.put(_first(scored, k), f"{tag}-best{r}")
        floor = _floor(batch, best, k)
        done, upto, r = upto, upto * GROWTH, r + 1


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item."""
    spark = docs.sparkSession
    prepare(spark)
    stage = Stage(spark, "op11")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = items.select(F.monotonically_increasing_id().alias("qid"), "item_id", "text")
    kind = items.schema["item_id"].dataType.simpleString()
    asked = stage.put(asked.mapInArrow(_item_terms, f"qid long, item_id {kind}, terms array<long>").where("size(terms) > 0"), "items")
    total = asked.agg(F.sum(F.size("terms")).alias("n")).first()["n"] or 0
    parts = max(1, -(-total // BATCH_TERMS))
    index, found = None, []
    for i in range(parts if total else 0):
        rows = asked.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == i).select("qid", "terms").collect()     # about BATCH_TERMS terms
        if not rows:
            continue
        batch = Batch([r["qid"] for r in rows], [r["terms"] for r in rows])
        counts = stage.put(docs.mapInArrow(_counts(batch.vocab, index is None), _COUNTS), f"counts{i}")
        if index is None:
            index = counts.where("n > 0").select("doc_id", "n", "same_text", "sketch")
            size = index.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
        if not size["docs"]:
            break
        df = counts.where("term is not null").groupBy("term").agg(F.sum("df").alias("df")).collect()         # at most a row a term of the batch
        batch.weigh(size["docs"], size["terms"], {r["term"]: r["df"] for r in df})
        found.append(_rank_batch(docs, index, batch, stage, f"b{i}", k))
    if not found:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.join(asked.select("qid", "item_id"), "qid").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
