"""Seed and extend over sequences of hashed symbols (words, lines, bytes).

A *window* is T consecutive symbols of one document.  Each window picks one
anchor: the smallest hash among its k-grams, rightmost on ties.  The choice
depends on the window's content alone, so equal windows pick equal anchors
at equal offsets: joining anchors finds every repeated window.  Consecutive
windows that pick the same anchor form one *run*.

1. Runs are joined on the anchor; an anchor seen once ends here.
2. Runs of an anchor that extend alike on both sides (equal content of the
   whole run) form a class: all their windows repeat, which settles them
   without looking at texts again.
3. Where an anchor has several classes (edges of matches), one head a class
   goes on and its windows are compared one by one: the match is extended
   from the anchor to both sides as far as some other class agrees.  No pairs are formed: occurrences meet in
   grouped counts, so a passage in n documents costs n rows, not n * n.

Rows are keyed by (doc_id, tkey): rows equal in both are one document listed
more than once; null ids form a key of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X
from .common import Stage, same

RUN = "doc_id long, tkey binary, at long, anchor long, body long"      # at: first window * LEN + windows
LEN = 1 << 16
WIN = "doc_id long, tkey binary, pos int, anchor long, body long"


STEP = 1 << 20      # symbols handled at a time inside a long text


class Plan:
    """``symbols(texts) -> (symbols, first)`` cuts texts into symbols: 64-bit
    hashes, or plain bytes.  ``width`` is the number of k-grams a minimum is
    taken over; by default those of a whole window.  A smaller width makes
    more and shorter runs: the minima of all ``width`` neighbours are the
    sampled positions, and a window's anchor is its first sample that no
    context outside the window can change.  Such an anchor is named by all the
    ``window - width + 1`` symbols that its windows have in common."""

    def __init__(self, symbols: Callable, window: int, gram: int, width: int = 0):
        self.symbols, self.window, self.gram = symbols, window, gram
        self.width = width or window - gram + 1
        self.whole = self.width == window - gram + 1
        # a sample must fall in every window's settled zone
        assert self.whole or window - gram + 1 - 2 * (self.width - 1) >= self.width


def _hashed(symbols: np.ndarray) -> np.ndarray:
    return X.BYTE[symbols] if symbols.dtype == np.uint8 else symbols


def _steps(sym: np.ndarray, first: np.ndarray, p: Plan):
    """For each step over the window starts: its first symbol, the symbol
    hashes it needs, the starts of windows inside one text and their texts."""
    for a in range(0, len(sym), STEP):
        h = _hashed(sym[a:a + STEP + p.window + 2 * p.width])
        start = np.arange(a, min(a + STEP, len(sym)))
        owner = np.searchsorted(first, start, "right") - 1
        ok = start + p.window <= first[np.minimum(owner + 1, len(first) - 1)]
        if ok.any():
            yield a, h, start[ok], owner[ok]


def _anchors(h: np.ndarray, at: np.ndarray, p: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Names by position, and the anchor of the window at each of ``at``."""
    g = X.grams(h, p.gram)
    arg = X.window_argmin(g, p.width)
    if p.whole:
        return g, arg[at]
    samples = np.unique(arg)
    # the name of a sample: all that every window with this anchor holds
    lo, hi = samples - (p.width - 1), samples + (p.window - 2 * p.width + 2)
    whole = np.flatnonzero((lo >= 0) & (hi <= len(h)))
    names = np.zeros(len(g), X.U)
    names[samples[whole]] = X.span_hash(h, lo[whole], hi[whole])
    return names, samples[np.searchsorted(samples, at + p.width - 1)]


def _batch(cols: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(cols, names=names)


def _ints(x) -> pa.Array:
    return pa.array(np.asarray(x), pa.int32())


def _runs(p: Plan):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = X.texts_of(b)
            for lo, hi in X.groups(texts):
                sym, first = p.symbols(texts[lo:hi])
                for a, h, start, owner in _steps(sym, first, p):
                    g, arg = _anchors(h, start - a, p)
                    # a run: consecutive windows of one text with one anchor
                    new = np.flatnonzero(np.concatenate(([True], (arg[1:] != arg[:-1]) | (owner[1:] != owner[:-1]))))
                    n = np.diff(np.append(new, len(start)))
                    s, o, c = start[new], owner[new], arg[new]
                    body = X.span_hash(h, s - a, s - a + n + p.window - 1) ^ X.mix((c + a - s).astype(X.U))
                    ids = pa.array(lo + o)
                    yield _batch([b.column(0).take(ids), b.column(1).take(ids), X.longs((s - first[o]) * LEN + n),
                                  X.longs(g[c]), X.longs(body)], ["doc_id", "tkey", "at", "anchor", "body"])
    return fn


def _windows(p: Plan):
    """Windows of the listed runs (``runs``: structs at, anchor)."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, runs = X.unzipped(b), b.column(b.schema.get_field_index("runs"))
            for lo, hi in X.groups(texts):
                sym, first = p.symbols(texts[lo:hi])
                part = runs.slice(lo, hi - lo)
                flat = part.flatten()
                size = np.asarray(part.value_lengths())
                o = np.repeat(np.arange(hi - lo), size)
                rlo, n = np.divmod(np.asarray(flat.field(0)), LEN)
                anchor = np.asarray(flat.field(1))
                pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(rlo, n)
                o, anchor = np.repeat(o, n), np.repeat(anchor, n)
                at = first[o] + pos
                for a in range(0, len(sym), STEP):
                    mine = np.flatnonzero((at >= a) & (at < a + STEP))
                    if not len(mine):
                        continue
                    g = X.grams(_hashed(sym[a:a + STEP + p.window - 1]), p.window)
                    ids = pa.array(lo + o[mine])
                    yield _batch([b.column(0).take(ids), b.column(1).take(ids), _ints(pos[mine]), X.longs(anchor[mine]),
                                  X.longs(g[at[mine] - a])], ["doc_id", "tkey", "pos", "anchor", "body"])
    return fn


def repeated(rows: DataFrame, keys: list[str], at: str, later: bool, stage: Stage, name: str = "repeated") -> DataFrame:
    """Rows whose key occurs again; ``later``: only those after the first."""
    aggs = [F.count(F.lit(1)).alias("c")]
    if later:
        aggs.append(F.min(F.struct("doc_id", at)).alias("at0"))
    again = rows.groupBy(*keys).agg(*aggs).where("c > 1").select(
        *[F.col(k).alias(f"k_{k}") for k in keys], *(["at0"] if later else []))
    again = stage.put(again, name)
    cond = None
    for k in keys:
        c = F.col(k) == F.col(f"k_{k}")
        cond = c if cond is None else cond & c
    if not later:
        return rows.join(again, cond, "left_semi")
    first = same(F.col("doc_id"), F.col("at0.doc_id")) & (F.col(at) == F.col(f"at0.{at}"))
    return rows.join(again, cond & ~first).drop("at0", *[f"k_{k}" for k in keys])


def repeats(docs: DataFrame, p: Plan, later: bool, stage: Stage) -> DataFrame:
    """Covered spans: one row per (doc_id, tkey) with ``spans``, the sorted
    array of structs (s, e) of symbols covered by a repeated window.

    ``docs`` has doc_id, tkey, text.  ``later`` keeps the first occurrence
    (smallest doc_id, then position; a null id comes first)."""
    runs = stage.put(docs.mapInArrow(_runs(p), RUN), "runs")
    # 1. anchors seen more than once
    again = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor")
    again = stage.put(again, "again")      # written, so that the join can split a hot anchor
    shared = stage.put(runs.join(again, "anchor", "left_semi"), "shared")
    stage.drop("runs")
    # 2. occurrences that extend alike over the whole run form a class
    row = F.struct("doc_id", "tkey", "at")
    per = shared.groupBy("anchor", "body").agg(F.count(F.lit(1)).alias("c"), F.min(row).alias("head"))
    kinds = per.groupBy("anchor").agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("c_min"))
    per, kinds = stage.put(per, "classes"), stage.put(kinds, "kinds")
    per = stage.put(per.join(kinds, "anchor"), "per")
    told = stage.put(shared.join(per, ["anchor", "body"]), "told")
    stage.drop("shared")
    at_head = same(F.col("doc_id"), F.col("head.doc_id")) & (F.col("tkey") == F.col("head.tkey")) & (F.col("at") == F.col("head.at"))
    if later:
        whole = told.where((F.col("c") > 1) & ~(same(F.col("doc_id"), F.col("head.doc_id")) & (F.col("at") == F.col("head.at"))))
        other = F.lit(True)
    else:
        whole = told.where("c > 1")
        other = (F.col("c") == 1) | (F.col("c_min") == 1)
    lo, n = F.floor(F.col("at") / LEN).cast("int"), (F.col("at") % LEN).cast("int")
    whole = whole.select("doc_id", "tkey", lo.alias("s"), (lo + n + (p.window - 1)).alias("e"))
    # 3. the others, window by window; a class is stood for by its head
    open_ = (told.where((F.col("k") > 1) & at_head & other).select("doc_id", "tkey", "at", "anchor").distinct()
             .groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("at", "anchor")).alias("runs")))
    o = open_.select(F.col("doc_id").alias("o_id"), F.col("tkey").alias("o_key"), "runs")
    with_text = X.zipped(docs).join(o, same(F.col("doc_id"), F.col("o_id")) & (F.col("tkey") == F.col("o_key"))).select("doc_id", "tkey", "ztext", "runs")
    wins = stage.put(with_text.mapInArrow(_windows(p), WIN), "windows")
    part = repeated(wins, ["anchor", "body"], "pos", later, stage)
    part = part.select("doc_id", "tkey", F.col("pos").alias("s"), (F.col("pos") + p.window).alias("e"))
    spans = whole.unionByName(part).groupBy("doc_id", "tkey").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))
    return spans


def merged(spans) -> list[tuple[int, int]]:
    """Maximal covered runs from sorted (s, e) pairs."""
    out: list[list[int]] = []
    for s, e in spans:
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Every row of ``docs``, its text packed as ``ztext``, with its ``spans``
    (null where there are none)."""
    x = spans.select(F.col("doc_id").alias("s_id"), F.col("tkey").alias("s_key"), "spans")
    return X.zipped(docs).join(x, same(F.col("doc_id"), F.col("s_id")) & (F.col("tkey") == F.col("s_key")), "left").drop("s_id", "s_key")
