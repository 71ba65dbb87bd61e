"""Vectorised word and window hashing over Arrow batches of text.

All functions work on whole texts.  Words are ``[^\\x20\\x09-\\x0D]+`` on
UTF-8 bytes, which gives the same words as on code points because the
separators are ASCII.  Hashes are 64-bit polynomial sums over random byte
values followed by a bit mixer; they depend on content alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

CHUNK = 1 << 20
U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240131))
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15 | 5)
BASE_INV = U(pow(int(BASE), -1, 1 << 64))
GRAM = U(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (two multiply-xorshift rounds)."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


_powers: dict[str, np.ndarray] = {}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("p")
    if have is None or len(have) < n:
        m = max(n, CHUNK + 4096)
        for key, base in (("p", BASE), ("q", BASE_INV)):
            p = np.full(m, base, U)
            p[0] = U(1)
            _powers[key] = np.cumprod(p, dtype=U)
    return _powers["p"], _powers["q"]


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``values[s:e]`` for each (s, e); equal content, equal hash."""
    n = len(values)
    p, q = _pow(n + 1)
    c = np.zeros(n + 1, U)
    np.cumsum(values * p[:n], dtype=U, out=c[1:])
    h = (c[ends] - c[starts]) * q[starts]
    return mix(h + (ends - starts).astype(U) * GRAM)


def groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK bytes; a longer text stands alone."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


class Words:
    """Words of consecutive texts: byte ``starts``/``ends`` in ``buf`` and
    ``first`` (index of each text's first word, one more at the end)."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        raw = b"\n".join(texts) + b"\n"
        buf = np.frombuffer(raw, np.uint8)
        if lower:
            buf = LOWER[buf]
        sp = SPACE[buf]
        d = np.flatnonzero(np.diff(sp.view(np.int8), prepend=np.int8(1)))
        self.raw, self.buf = raw, buf
        self.starts, self.ends = d[0::2], d[1::2]
        at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=at[1:])
        self.at = at
        self.first = np.searchsorted(self.starts, at)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word, in bounded steps over the bytes."""
        out = np.empty(len(self.starts), U)
        w = 0
        while w < len(out):
            lo = self.starts[w]
            e = max(w + 1, int(np.searchsorted(self.ends, lo + CHUNK, "right")))
            hi = self.ends[e - 1]
            out[w:e] = span_hash(BYTE[self.buf[lo:hi]], self.starts[w:e] - lo, self.ends[w:e] - lo)
            w = e
        return out


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values (length n - k + 1, at least 0)."""
    n = len(h)
    if n < k:
        return np.empty(0, U)
    done, out = 0, None
    g, size = h, 1
    while True:
        if k & size:
            if out is None:
                out, done = g, size
            else:
                m = min(len(g), len(out) - size)
                out = g[:m] * U(pow(int(GRAM), done, 1 << 64)) + out[size:size + m]
                done += size
        if size * 2 > k:
            break
        g = g[:-size] * U(pow(int(GRAM), size, 1 << 64)) + g[size:]
        size *= 2
    return mix(out[:n - k + 1])


def window_argmin(g: np.ndarray, w: int) -> np.ndarray:
    """Index of the minimum of each w consecutive values, rightmost on ties."""
    n = len(g)
    if n < w:
        return np.empty(0, np.int64)
    idx, size = np.arange(n), 1
    while size * 2 <= w:
        a, b = idx[:-size], idx[size:]
        idx = np.where(g[a] < g[b], a, b)
        size *= 2
    if size < w:
        a, b = idx[:n - w + 1], idx[w - size:w - size + n - w + 1]
        idx = np.where(g[a] < g[b], a, b)
    return idx[:n - w + 1]


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """Texts as bytes; a null text counts as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    return [t or b"" for t in col.cast(pa.large_binary()).to_pylist()]


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == U else x.astype(np.int64))


def zipped(df: DataFrame) -> DataFrame:
    """``df`` with ``text`` replaced by ``ztext``: zstd after an 8-byte length.
    Texts that go through a shuffle only to be read in Python cross it so."""
    rest = [c for c in df.columns if c != "text"]
    schema = T.StructType([*[df.schema[c] for c in rest], T.StructField("ztext", T.BinaryType())])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for b in batches:
            col = b.column(b.schema.get_field_index("text")).cast(pa.large_binary())
            z = [None if t is None else len(t).to_bytes(8, "little") + codec.compress(t, asbytes=True) for t in col.to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in rest], pa.array(z, pa.binary())],
                                             names=[*rest, "ztext"])
    return df.mapInArrow(fn, schema)


def unzipped(batch: pa.RecordBatch, name: str = "ztext") -> list[bytes]:
    """The texts of ``zipped``; a null text counts as empty."""
    codec = pa.Codec("zstd")
    return [b"" if z is None else codec.decompress(z[8:], int.from_bytes(z[:8], "little"), asbytes=True)
            for z in batch.column(batch.schema.get_field_index(name)).to_pylist()]
