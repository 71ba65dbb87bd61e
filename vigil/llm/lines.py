"""Operator 5, line dedup: winnowing over line hashes.

The symbols are a text's non-blank lines (split at ``\\n``, compared byte for
byte).  Window minima of the line hashes are guaranteed fingerprints of any
run of ``run_lines`` lines; fingerprints are joined on, matches extended both
ways (``seeds``), and every run of at least ``run_lines`` lines that already
stands earlier - smaller doc_id, or further up in the same text - is deleted.
A line of at least ``line_words`` words or ``line_bytes`` bytes is a run by
itself: it is deleted wherever it stands again, whatever its neighbours.  Only
shorter lines need a repeated neighbour; with ``line_words=1`` there are none,
and every repeated line goes.

Defined results: a null text has no lines and stays null; empty and blank
texts are unchanged.  Blank lines between two deleted lines go with them.
Rows equal in doc_id and text are one document listed twice: neither is
earlier, both are treated alike.  A null doc_id counts as smallest.  Extra
columns pass through, whatever their names; a column ``ld_lines`` or
``ld_removed`` raises, because the result adds them.  A text whose lines are all deleted becomes empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import seeds, text as X
from .common import Stage, free_of, packed, prepare, text_key

RUN_LINES = 2
LINE_WORDS, LINE_BYTES = 3, 24
LONE = "doc_id long, tkey binary, pos int, anchor long, body long"


def line_bounds(texts: list[bytes]):
    """Byte bounds of every non-blank line, each text's first line and each
    line's words."""
    w = X.Words(texts)
    nl = np.flatnonzero(w.buf == 10)
    starts = np.concatenate(([0], nl[:-1] + 1)) if len(nl) else nl
    seen = np.searchsorted(w.starts, np.append(starts, len(w.buf)))
    full = seen[1:] > seen[:-1]            # a line that starts a word in it
    starts, ends = starts[full], nl[full]
    return w.buf, starts, ends, np.searchsorted(starts, w.at), np.diff(seen)[full]


def _hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    h = np.empty(len(s), X.U)
    at = 0
    while at < len(s):                     # bounded steps over the bytes
        lo = s[at]
        to = max(at + 1, int(np.searchsorted(e, lo + X.CHUNK, "right")))
        h[at:to] = X.span_hash(X.BYTE[buf[lo:e[to - 1]]], s[at:to] - lo, e[at:to] - lo)
        at = to
    return h


def _symbols(texts: list[bytes]):
    buf, s, e, first, _ = line_bounds(texts)
    return _hashes(buf, s, e), first


def _lone(line_words: int, line_bytes: int):
    """Lines that are a run by themselves: position, hash and bytes."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = X.texts_of(b)
            for lo, hi in X.groups(texts):
                buf, s, e, first, words = line_bounds(texts[lo:hi])
                mine = np.flatnonzero((words >= line_words) | (e - s >= line_bytes))
                s, e = s[mine], e[mine]
                o = np.searchsorted(first, mine, "right") - 1
                ids = pa.array(lo + o)
                yield pa.RecordBatch.from_arrays([b.column(0).take(ids), b.column(1).take(ids), pa.array((mine - first[o]).astype(np.int32)),
                                                  X.longs(_hashes(buf, s, e)), X.longs(e - s)], names=["doc_id", "tkey", "pos", "anchor", "body"])
    return fn


def drop_lines(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(text without the lines of ``spans``, non-blank lines, deleted ones)."""
    lines = text.split(b"\n")
    full = [i for i, x in enumerate(lines) if x.translate(None, b" \t\n\x0b\x0c\r")]
    gone, n = set(), 0
    for s, e in spans:
        n += e - s
        gone.update(range(full[s], full[e - 1] + 1))
    return b"\n".join(x for i, x in enumerate(lines) if i not in gone), len(full), n


def dedup_lines(docs: DataFrame, run_lines: int = RUN_LINES, line_words: int = LINE_WORDS, line_bytes: int = LINE_BYTES) -> DataFrame:
    """``docs`` with ``text`` freed of repeated runs, plus ``ld_lines`` and
    ``ld_removed`` (longs)."""
    spark = docs.sparkSession
    prepare(spark)
    free_of(docs, "ld_lines", "ld_removed")
    stage = Stage(spark, "lines")
    rest = docs.select(packed(docs, "text"), F.col("doc_id").cast("long").alias("doc_id"), text_key(), "text")
    base = rest.select("doc_id", "tkey", "text")
    spans = seeds.repeats(base, seeds.Plan(_symbols, run_lines, 1), True, stage)
    lone = seeds.repeated(stage.put(base.mapInArrow(_lone(line_words, line_bytes), LONE), "lone"), ["anchor", "body"], "pos", True, stage, "lone-repeated")
    lone = lone.select("doc_id", "tkey", F.array(F.struct(F.col("pos").alias("s"), (F.col("pos") + 1).alias("e"))).alias("spans"))
    spans = spans.unionByName(lone).groupBy("doc_id", "tkey").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))
    joined = seeds.with_spans(rest, spans).select("row", "ztext", "spans")

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old, out, n, gone = b.column(1), [], [], []
            for t, null, sp in zip(X.unzipped(b), old.is_null().to_pylist(), b.column(2).to_pylist()):
                kept, k, g = drop_lines(t, seeds.merged((x["s"], x["e"]) for x in sp or ()))
                out.append(None if null else kept)
                n.append(k)
                gone.append(g)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()),
                                              pa.array(gone, pa.int64())], names=["row", "text", "ld_lines", "ld_removed"])

    schema = T.StructType([joined.schema["row"], T.StructField("text", T.StringType()),
                           T.StructField("ld_lines", T.LongType()), T.StructField("ld_removed", T.LongType())])
    out = joined.mapInArrow(fn, schema)
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns], "ld_lines", "ld_removed")
