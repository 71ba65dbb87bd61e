"""Operator 6, packing documents into sequences by swap-based local search.

Texts are tokenised, an end id is added, and only documents longer than the
capacity are cut, into capacity-sized pieces.  Pieces are dealt to cells by a
hash of their place in the written piece table, so a cell is an even share of
all rows whatever ids or sources repeat, and the number of cells grows with
the data.  Each cell starts from best-fit decreasing; then bins that are not
full are improved by local search: the emptiest bin gives documents away by
moves, one-for-one exchanges and two-for-one exchanges, each of which raises
the sum of squared fills, until it is empty or no step helps.  A cell is left
when its bins reach the lower bound.  Bins less than half full of all cells
are packed once more together.

Defined results: a null or empty text has the end id alone.  Repeated rows
are packed row by row; a null doc_id stays null.  An empty table gives no
rows.  Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X
from .common import Stage, prepare

CAPACITY, END_ID = 4096, 1
CELL_ROWS, CELL_TOKENS = 40_000, 1 << 25
PASSES = 4                     # over all bins that are not full
CACHE_WORDS = 1_400_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"

# a full stop or comma after something else than an ASCII letter or digit or a
# Latin-1 letter may belong to a longer run of signs
_LOOSE = re.compile(rb"(?<![a-z0-9])(?<!\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])[.,](?=[ \n])")


class Encoder:
    """Token ids of a text, by word.

    The vocabulary's rules never join across white space, so a text's ids are
    its white-space-separated parts' ids in a row; parts are looked up in a
    cache.  ASCII upper case is folded first, as the tokenizer does itself
    (not near ``<|``, where special tokens are matched before folding), and
    a stop or comma after a letter is a part of its own, as its rules say."""

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok, self.known = Tokenizer.from_file(path), {}

    def _learn(self, parts: set[bytes]) -> None:
        plain = [w for w in parts if b"<|" not in w]
        for i in range(0, len(plain), 512):
            some = plain[i:i + 512]
            # the fast batch call keeps no offsets, which are not needed
            enc = self.tok.encode_batch_fast(["<|endoftext|>".join(w.decode() for w in some)], add_special_tokens=False)[0]
            ids = np.array(enc.ids, np.uint32)
            cut = np.flatnonzero(ids == self.tok.token_to_id("<|endoftext|>"))
            raw, at = ids.astype("<u4").tobytes(), 0
            for w, c in zip(some, [*cut.tolist(), len(ids)]):
                self.known[w] = raw[4 * at:4 * c]
                at = c + 1
        for w in parts:
            if b"<|" in w:
                ids = self.tok.encode(w.decode(), add_special_tokens=False).ids
                self.known[w] = np.array(ids, "<u4").tobytes()

    def __call__(self, text: bytes) -> bytes:
        if b"<|" not in text:
            text = text.lower()
            if not _LOOSE.search(text):
                for c in (b".", b","):
                    text = text.replace(c + b" ", b" " + c + b" ").replace(c + b"\n", b" " + c + b"\n")
        parts = text.split()
        try:
            return b"".join(map(self.known.__getitem__, parts))
        except KeyError:
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            self._learn({w for w in parts if w not in self.known})
            return b"".join(map(self.known.__getitem__, parts))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, vocab: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32), one per piece."""
    end = np.array([end_id], "<u4").tobytes()

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(X.texts_of(b)):
                ids = memoryview(enc(t) + end)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(fn, PIECE)


def best_fit(lengths: np.ndarray, cap: int) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of indices into ``lengths``."""
    bins: list[list[int]] = []
    open_: dict[int, list[int]] = {}      # free room -> bins
    rooms = 0                             # bit r: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        m = rooms >> n
        if m:
            r = n + (m & -m).bit_length() - 1
            stack = open_[r]
            k = stack.pop()
            if not stack:
                rooms &= ~(1 << r)
            bins[k].append(i)
            r -= n
        else:
            k, r = len(bins), cap - n
            bins.append([i])
        if r:
            open_.setdefault(r, []).append(k)
            rooms |= 1 << r
    return bins


def local_search(lengths: np.ndarray, bins: list[list[int]], cap: int) -> np.ndarray:
    """Bin of each piece after the search.

    The emptiest bin not yet tried gives away one document or two: into a bin
    with room (the tightest), or for the document of a fuller bin that lets
    them fit and gains most.  Every step moves tokens to a fuller bin, so the
    sum of squared fills rises and the search ends."""
    owner = np.empty(len(lengths), np.int64)
    for k, b in enumerate(bins):
        owner[b] = k
    fill = np.bincount(owner, lengths, len(bins)).astype(np.int64)
    alive, least = len(bins), -(-int(lengths.sum()) // cap)
    tried, changed, passes = fill >= cap, False, 0

    def give(v: int, mine: list[int]) -> bool:
        x = int(lengths[mine].sum())
        free = cap - fill
        fits = (free >= x) & (fill > 0) & (fill + x > fill[v])
        fits[v] = False
        if fits.any():
            k = int(np.where(fits, free, cap + 1).argmin())
        else:
            net = x - lengths
            gain = np.where((net > 0) & (net <= free[owner]) & (owner != v) & (fill[owner] + net > fill[v]), net, 0)
            j = int(gain.argmax())
            if gain[j] <= 0:
                return False
            k = int(owner[j])
            owner[j] = v
            fill[k] -= lengths[j]
            fill[v] += lengths[j]
        owner[mine] = k
        fill[k] += x
        fill[v] -= x
        return True

    while alive > least:
        v = int(np.where(tried | (fill == 0), cap + 1, fill).argmin())
        if tried[v] or fill[v] == 0:
            passes += 1
            if not changed or passes == PASSES:
                break
            tried, changed = fill >= cap, False
            continue
        tried[v] = True
        while fill[v]:
            mine = np.flatnonzero(owner == v)
            _, at = np.unique(-lengths[mine], return_index=True)      # one of each length
            one = mine[at].tolist()
            two = ([a, b] for n, a in enumerate(one) for b in one[n + 1:])
            if not any(give(v, g) for g in [[i] for i in one]) and not any(give(v, g) for g in two):
                break
            changed = True
        alive -= fill[v] == 0
    return owner


def _pack_cell(cap: int, offset: int):
    def fn(t: pa.Table) -> pa.Table:
        lengths = t.column("length").to_numpy()
        order = np.lexsort((t.column("row").to_numpy(),))
        t, lengths = t.take(pa.array(order)), lengths[order]
        bin_ = local_search(lengths, best_fit(lengths, cap), cap)
        by = np.argsort(bin_, kind="stable")
        before = np.cumsum(lengths[by]) - lengths[by]
        head = np.searchsorted(bin_[by], bin_[by])         # first piece of the bin
        at = np.empty(len(lengths), np.int64)
        at[by] = before - before[head]
        total = np.bincount(bin_, lengths).astype(np.int64)[bin_]
        seq = (t.column("cell").to_numpy() << 32) + bin_ + offset
        return pa.table([*[t.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")],
                         pa.array(seq), pa.array(at), pa.array(total)],
                        names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "fill"])
    return fn


PACKED = PIECE + ", sequence_id long, offset long, fill long"


def _pack_rows(rows: DataFrame, cap: int, offset: int) -> DataFrame:
    """Pack the rows of a written table, cell by cell."""
    n, tokens = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    cells = max(1, -(-n // CELL_ROWS), -(-tokens // CELL_TOKENS))
    x = rows.withColumn("row", F.monotonically_increasing_id())
    x = x.withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(cells)).cast("long"))
    return x.groupBy("cell").applyInArrow(_pack_cell(cap, offset), PACKED)


def pack(docs: DataFrame, vocab: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: PIECE columns, sequence_id, offset."""
    spark = docs.sparkSession
    prepare(spark)
    stage = Stage(spark, "packing")
    cut = stage.put(pieces(docs, vocab, capacity, end_id), "pieces")
    first = stage.put(_pack_rows(cut, capacity, 0), "packed")
    # what the cells left half empty, once more together
    loose = first.where(F.col("fill") * 2 < capacity).select("doc_id", "piece", "start", "length", "ids_crc32")
    again = _pack_rows(stage.put(loose, "loose"), capacity, 1 << 62)
    return first.where(F.col("fill") * 2 >= capacity).unionByName(again).drop("fill")
