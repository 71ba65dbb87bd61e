"""Operator 7, substring dedup: seed and extend over words.

Winnowed word k-grams are the anchors; documents are joined on them, matches
extended both ways and kept where they are at least ``window`` words long
(``seeds``).  Every word covered by such a match is removed, in all places
where it stands.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``, unchanged; a null or empty
text has none.  Texts shorter than the window keep all words.  A row listed
twice repeats itself.  Extra columns pass through, whatever their names; one
that the result adds (``ss_words``, ``ss_removed``, ``ss_text``) raises.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import seeds, text as X
from .common import Stage, free_of, packed, prepare, text_key

WINDOW, GRAM = 35, 10


def _symbols(texts: list[bytes]):
    w = X.Words(texts)
    return w.hashes(), w.first


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(kept words joined by one space, words, removed words)."""
    words = text.split()           # bytes.split: exactly the six separators
    n = len(words)
    for s, e in reversed(spans):
        del words[s:e]
    return b" ".join(words), n, n - len(words)


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """``docs`` plus ``ss_words``, ``ss_removed`` (longs) and ``ss_text``: the
    kept words, or with ``digest`` their sha256 in lowercase hex."""
    spark = docs.sparkSession
    prepare(spark)
    free_of(docs, "ss_words", "ss_removed", "ss_text")
    stage = Stage(spark, "substrings")
    rest = docs.select(packed(docs, *["text"] * digest), F.col("doc_id").cast("long").alias("doc_id"), text_key(), "text")
    base = rest.select("doc_id", "tkey", "text")
    spans = seeds.repeats(base, seeds.Plan(_symbols, window, gram), False, stage)
    joined = seeds.with_spans(rest, spans).select("row", "ztext", "spans")

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, n, gone = [], [], []
            for t, sp in zip(X.unzipped(b), b.column(2).to_pylist()):
                kept, k, g = cut_words(t, seeds.merged((x["s"], x["e"]) for x in sp or ()))
                out.append(hashlib.sha256(kept).hexdigest() if digest else kept.decode())
                n.append(k)
                gone.append(g)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                                              pa.array(out, pa.string())], names=["row", "ss_words", "ss_removed", "ss_text"])

    schema = T.StructType([joined.schema["row"], T.StructField("ss_words", T.LongType()),
                           T.StructField("ss_removed", T.LongType()), T.StructField("ss_text", T.StringType())])
    return joined.mapInArrow(fn, schema).select("row.*", "ss_words", "ss_removed", "ss_text")
