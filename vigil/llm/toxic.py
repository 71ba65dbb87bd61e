"""Operator 13, toxicity after noisy-channel deobfuscation.

A writer who hides a word replaces letters by look-alikes, repeats letters or
puts blanks and signs between them.  The channel's inverse is a lattice: each
position lists what may have been meant (the letters a sign can stand for, one
or two letters for a repeated one, nothing or a word break for a separator)
with its channel probability.  A character language model of the whole corpus
scores the readings, and the Viterbi path restores the text.

* The model counts, over every word of every document, how often each symbol
  follows the three before it in the word (``SYMBOLS`` classes of bytes), and
  interpolates the orders.  Its size is fixed, its counts grow with the input.
* Only spans in which the channel can have acted are decoded: words with both
  letters and look-alikes, with a letter three times in a row, with single
  letters parted by signs, and runs of at least three one-letter words.  All
  other words have one reading.
* The classifier is a logistic regression on the presence of restored words
  (runs of letters, lower case).  It is fitted on at most about ``FIT_ROWS``
  labelled rows of each class, drawn by a hash of the id and weighted back to
  the classes' true sizes; its ``FEATURES`` words are those with the largest
  chi-square (above chance) among these rows.  That is the only sample; model counts and
  scores cover all documents and whole texts.

Labels are learned from rows whose crc32(doc_id) mod 5 is not 0.  Scores see
the text alone.

Defined results: a null or empty text has no words; its score is the
intercept's.  Label rows with a null id or a label other than 0 and 1 are
ignored; an id with both labels counts as toxic; of documents that share a
labelled id one text (the smallest) is fitted, all are scored.  A null doc_id
counts as empty text for ``held_out`` (so it is held out).  Unless both labels
occur, every score is the smoothed share of toxic rows.  Extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import array
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as X
from .common import Stage, prepare

FIT_ROWS, FEATURES, CHANCE, SMOOTH = 20_000, 2048, 10.83, 1e-4     # CHANCE: chi-square at 0.1 %
SYMBOLS, BITS = 32, 5
KEEP, MEMO = (1 << 3 * BITS) - 1, 1 << 16

#: What a sign may stand for (fixed values of common substitution writing).
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
         "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "*": "abcdefghijklmnopqrstuvwxyz", "#": "abcdefghijklmnopqrstuvwxyz"}
#: Channel probabilities: a sign is meant as such; copies of a letter written twice, or more often; a separator is noise.
LITERAL, TWICE, OFTEN, NOISE = 0.3, {1: 0.4, 2: 0.6}, {1: 0.5, 2: 0.3, 0: 0.2}, 0.5

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_ASCII = np.zeros(256, bool)
_ASCII[97:123] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in LOOKS]] = True
_PART = np.zeros(256, bool)
_PART[[ord(c) for c in "._-~'*/\\,"]] = True
_OPEN, _SHUT = np.zeros(256, bool), np.zeros(256, bool)
_OPEN[[ord(c) for c in "\"'([{<*_~-.,;:!?"]] = True
_SHUT[[ord(c) for c in "\"')]}>*_~-.,;:!?"]] = True
_CODE = np.full(256, 31, np.int32)                    # signs
_CODE[:33] = _CODE[127] = 0                           # word breaks
_CODE[48:58] = 30                                     # digits
_CODE[97:123] = np.arange(1, 27)                      # letters
_CODE[128:] = 27 + np.arange(128) % 3                 # bytes of other characters
_RUN = re.compile(r"(.)\1*", re.S)


# ------------------------------------------------------------ language model

def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**4, np.int64)
    for b in batches:
        texts = X.texts_of(b)
        for lo, hi in X.groups(texts):
            s = _CODE[X.LOWER[np.frombuffer(b"\n\n\n" + b"\n".join(texts[lo:hi]) + b"\n", np.uint8)]]
            c1 = s[2:-1]
            c2 = np.where(c1 == 0, 0, s[1:-2])
            c3 = np.where(c2 == 0, 0, s[:-3])
            g = ((c3 * SYMBOLS + c2) * SYMBOLS + c1) * SYMBOLS + s[3:]
            total += np.bincount(g[g > 0], minlength=SYMBOLS**4)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([X.longs(at), X.longs(total[at])], names=["gram", "n"])


class CharModel:
    """Interpolated (Witten-Bell) four-symbol model within words."""

    def __init__(self, grams: np.ndarray, n: np.ndarray):
        c = np.zeros(SYMBOLS**4)
        c[grams] = n
        p = np.full(SYMBOLS, 1 / SYMBOLS)
        for order in (1, 2, 3, 4):
            k = c.reshape((-1,) + (SYMBOLS,) * order).sum(axis=0)
            seen, kinds = k.sum(axis=-1, keepdims=True), (k > 0).sum(axis=-1, keepdims=True)
            back = np.broadcast_to(p, k.shape)
            p = np.where(seen > 0, (k + kinds * back) / np.maximum(seen + kinds, 1), back)
        self.log = array.array("f", np.log(p).astype(np.float32).tobytes())
        self.memo: dict[tuple[str, bool], str] = {}

    def __getstate__(self):
        return self.log.tobytes()

    def __setstate__(self, state):
        self.log, self.memo = array.array("f", state), {}

    def decode(self, span: str, spaced: bool) -> str:
        """The likeliest reading of a span (lower case)."""
        out = self.memo.get((span, spaced))
        if out is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            out = self.memo[span, spaced] = self._viterbi(lattice(span, spaced))
        return out

    def _viterbi(self, steps: list[list[tuple[float, tuple[int, ...], str]]]) -> str:
        log, states = self.log, {0: (0.0, None)}      # last three symbols of the word: score, path
        for step in steps:
            ahead: dict[int, tuple] = {}
            for ctx, (score, path) in states.items():
                for p, symbols, piece in step:
                    c, s = ctx, score + p
                    for y in symbols:
                        g = c << BITS | y
                        s += log[g]
                        c = g & KEEP if y else 0
                    old = ahead.get(c)
                    if old is None or s > old[0]:
                        ahead[c] = s, (path, piece)
            states = ahead
        path = max(((score + (log[ctx << BITS] if ctx else 0.0), path) for ctx, (score, path) in states.items()), key=lambda x: x[0])[1]
        pieces = []
        while path:
            path, piece = path
            pieces.append(piece)
        return "".join(reversed(pieces))


def char_model(docs: DataFrame) -> CharModel:
    """The corpus' model: at most SYMBOLS^4 summed counts reach the driver."""
    t = docs.select("text").mapInArrow(_gram_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    return CharModel(t.column("gram").to_numpy(), t.column("n").to_numpy())


# ------------------------------------------------------------ channel

def _codes(s: str) -> tuple[int, ...]:
    return tuple(int(x) for x in _CODE[np.frombuffer(s.encode(), np.uint8)])


def lattice(span: str, spaced: bool) -> list[list[tuple[float, tuple[int, ...], str]]]:
    """Per run of equal characters, the readings (log probability of the
    channel, symbols, text).  In a spaced span, separators may be noise."""
    steps = []
    for m in _RUN.finditer(span):
        c, k = m[1], m.end() - m.start()
        if spaced and (c.isspace() or ord(c) < 128 and _PART[ord(c)]):
            steps.append([(math.log(NOISE), (), ""), (math.log(1 - NOISE), (0,), " ")])
            continue
        copies = {1: 1.0} if k == 1 else TWICE if k == 2 else OFTEN
        looks = LOOKS.get(c)
        if looks:
            step = [(math.log(LITERAL), _codes(m[0]), m[0])]
            step += [(math.log((1 - LITERAL) / len(looks) * p), (ord(x) - 96,) * (n or k), x * (n or k)) for x in looks for n, p in copies.items()]
        elif c.isalpha():
            code = _codes(c)
            step = [(math.log(p), code * (n or k), c * (n or k)) for n, p in copies.items()]
        else:
            step = [(0.0, _codes(m[0]), m[0])]
        steps.append(step)
    return steps


def _spans(t: X.Words) -> list[tuple[int, int, bool]]:
    """Byte ranges of the words the channel can have acted on, in order."""
    buf, s, e = t.buf, t.starts.copy(), t.ends.copy()
    for _ in range(len(buf)):                        # signs around a word; one round a sign
        more = (e > s) & _SHUT[buf[e - 1]]
        if not more.any():
            break
        e -= more
    for _ in range(len(buf)):
        more = (s < e) & _OPEN[buf[np.minimum(s, len(buf) - 1)]]
        if not more.any():
            break
        s += more

    def inside(mask: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(mask)))
        return c[np.maximum(hi, lo)] - c[lo]

    letter, sign, part = _LETTER[buf], _SIGN[buf], _PART[buf]
    one = letter | sign
    thrice = np.zeros(len(buf), bool)
    thrice[:-2] = (buf[2:] == buf[1:-1]) & (buf[1:-1] == buf[:-2]) & _ASCII[buf[:-2]]
    parted = np.zeros(len(buf), bool)                 # a separator between characters, the one before it stands alone
    parted[2:-1] = part[2:-1] & one[1:-2] & one[3:] & ~one[:-3]
    apart = inside(parted, s, e) >= 2
    letters = inside(letter, s, e) > 0
    odd = letters & ((inside(sign, s, e) > 0) | (inside(thrice, s, e - 2) > 0) | apart)
    # runs of one-character words within one text
    single = (e - s == 1) & one[np.minimum(s, len(buf) - 1)]
    text = np.searchsorted(t.first, np.arange(len(s)), "right")
    edge = np.flatnonzero(np.concatenate(([True], (single[1:] != single[:-1]) | (text[1:] != text[:-1]), [True]))) if len(s) else np.empty(0, np.int64)
    out = []
    for a, z in zip(edge[:-1], edge[1:]):
        if single[a] and z - a >= 3:
            odd[a:z] = False
            out.append((int(s[a]), int(e[z - 1]), True))
    out += [(int(s[i]), int(e[i]), bool(apart[i])) for i in np.flatnonzero(odd)]
    return sorted(out)


def restored(texts: list[bytes], model: CharModel) -> list[bytes]:
    """The texts, suspicious spans replaced by their likeliest reading."""
    t = X.Words(texts, lower=True)
    pieces: dict[int, list[bytes]] = {}
    done: dict[int, int] = {}
    for a, z, spaced in _spans(t):
        i = int(np.searchsorted(t.at, a, "right")) - 1
        was = t.buf[a:z].tobytes().decode()
        now = model.decode(was, spaced)
        if now != was:
            pieces.setdefault(i, []).extend((t.raw[done.get(i, int(t.at[i])):a], now.encode()))
            done[i] = z
    out = list(texts)
    for i, p in pieces.items():
        out[i] = b"".join([*p, t.raw[done[i]:t.at[i + 1] - 1]])
    return out


class _Letters(X.Words):
    """Runs of letters, lower case."""

    def __init__(self, texts: list[bytes]):
        self.buf = X.LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        d = np.flatnonzero(np.diff(_LETTER[self.buf].view(np.int8), prepend=np.int8(0)))
        self.starts, self.ends = d[0::2], d[1::2]
        at = np.concatenate(([0], np.cumsum([len(x) + 1 for x in texts])))
        self.first = np.searchsorted(self.starts, at)


def _words(batch: pa.RecordBatch, model: CharModel) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Groups of texts of a batch: first text, end, and (text, word hash) of each distinct restored word."""
    texts = X.texts_of(batch)
    for lo, hi in X.groups(texts):
        w = _Letters(restored(texts[lo:hi], model))
        h = w.hashes()
        doc = np.repeat(np.arange(hi - lo), np.diff(w.first))
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        if len(h):
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))
            h, doc = h[new], doc[new]
        yield lo, hi, doc, h


def deobfuscate(docs: DataFrame, model: CharModel | None = None) -> DataFrame:
    """``docs`` with the column ``restored``: the text as the channel's likeliest
    source (a null text stays null).  Other columns pass through; a column
    named ``restored`` is an error."""
    if "restored" in docs.columns:
        raise ValueError("a column named 'restored' is in the way")
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or char_model(docs))
    schema = docs.select("*", F.col("text").alias("restored")).schema

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = X.texts_of(b), []
            for lo, hi in X.groups(texts):
                out += [x.decode() for x in restored(texts[lo:hi], shared.value)]
            null = np.asarray(b.column(b.schema.names.index("text")).is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string(), mask=null)], names=[*b.schema.names, "restored"])
    return docs.mapInArrow(fn, schema)


# ------------------------------------------------------------ classifier

def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


class Classifier:
    """Weights of restored words; picklable and of bounded size."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, intercept: float):
        order = np.argsort(words)
        self.words, self.weights, self.intercept = words[order], weights[order], intercept

    def scores(self, doc: np.ndarray, h: np.ndarray, size: int) -> np.ndarray:
        out = np.full(size, self.intercept)
        if len(self.words) and len(h):
            i = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            hit = self.words[i] == h
            out += np.bincount(doc[hit], self.weights[i[hit]], size)
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, shared, stage: Stage) -> Classifier:
    """Logistic regression on a bounded sample of the labelled rows."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = stage.put(known, "known")
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    none = np.empty(0, np.uint64)
    if len(n) < 2:
        toxic, rows = n.get(1, 0), sum(n.values())
        share = (toxic + 0.5) / (rows + 2)
        return Classifier(none, np.empty(0), math.log(share / (1 - share)))
    unit = 1 << 30
    part = F.when(F.col("toxic") == 1, F.lit(min(1.0, FIT_ROWS / n[1]))).otherwise(F.lit(min(1.0, FIT_ROWS / n[0])))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(unit)) < part * unit).withColumn("weight", 1 / part)
    # about 2 * FIT_ROWS ids at most, whatever the size of the tables
    train = docs.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"),
                                                                         F.max("weight").alias("weight"))
    train = stage.put(train.select("text", "toxic", "weight"), "train")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic = b.column("toxic").to_numpy()
            for lo, hi, doc, h in _words(b, shared.value):
                words, at = np.unique(h, return_inverse=True)
                t = np.bincount(at, toxic[lo:hi][doc], len(words))
                yield pa.RecordBatch.from_arrays([X.longs(words), X.longs(t), X.longs(np.bincount(at, minlength=len(words)))], names=["word", "t", "n"])

    size = train.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    if not size["n"] or not 0 < size["t"] < size["n"]:
        share = ((size["t"] or 0) + 0.5) / (size["n"] + 2)
        return Classifier(none, np.empty(0), math.log(share / (1 - share)))
    words = train.mapInArrow(count, "word long, t long, n long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).where("n >= 3")
    all_t, all_n = float(size["t"]), float(size["n"])
    t, k = F.col("t").cast("double"), F.col("n").cast("double")
    chi = all_n * F.pow(t * (all_n - all_t) - (k - t) * all_t, F.lit(2)) / (k * (all_n - k + 0.5) * all_t * (all_n - all_t))
    best = words.select("word", chi.alias("chi")).where(F.col("chi") > CHANCE).orderBy(F.col("chi").desc(), "word").limit(FEATURES).collect()
    chosen = np.sort(np.array([r["word"] for r in best], np.int64).view(np.uint64))
    if not len(chosen):
        return Classifier(none, np.empty(0), math.log(all_t / (all_n - all_t)))

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for lo, hi, doc, h in _words(b, shared.value):
                i = np.minimum(np.searchsorted(chosen, h), len(chosen) - 1)
                hit = chosen[i] == h
                cut = np.searchsorted(doc[hit], np.arange(hi - lo + 1))
                rows += [i[hit][a:z].astype(np.int32) for a, z in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([b.column("toxic").cast(pa.float64()), b.column("weight"), pa.array(rows, pa.list_(pa.int32()))],
                                             names=["label", "weight", "present"])

    size = len(chosen)
    vector = F.udf(lambda at: Vectors.sparse(size, at, [1.0] * len(at)), VectorUDT())
    seen = stage.put(train.mapInArrow(present, "label double, weight double, present array<int>"), "present")
    model = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=SMOOTH, maxIter=60,
                               standardization=False).fit(seen.select("label", "weight", vector("present").alias("features")))
    return Classifier(chosen, model.coefficients.toArray(), float(model.intercept))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    spark = docs.sparkSession
    prepare(spark)
    stage = Stage(spark, "op13")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = spark.sparkContext.broadcast(char_model(docs))
    classifier = fit(docs, labels, shared, stage)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [classifier.scores(doc, h, hi - lo) for lo, hi, doc, h in _words(b, shared.value)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(out) if out else np.empty(0))], names=["doc_id", "score"])

    out = docs.mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
