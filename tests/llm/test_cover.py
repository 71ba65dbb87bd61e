"""Difference-cover suffix sorting against sorted suffixes and brute-force windows."""
import collections
import random

import pytest

from vigil.llm import cover, seeds
from vigil.llm.common import Stage, prepare, text_key


@pytest.mark.parametrize("string", ["a", "ab", "mississippi", "aaaaaaaaaaaaa", "abababababababc", "yabbadabbado" * 3])
def test_suffix_ranks(spark, string):
    prepare(spark)
    s = spark.createDataFrame([(i, ord(c)) for i, c in enumerate(string)], "i long, c long")
    ranks = {r["i"]: r["rank"] for r in cover.suffix_ranks(s, len(string), Stage(spark, "cover"), 10**9).collect()}
    want = sorted(range(len(string)), key=lambda i: string[i:])
    assert ranks == {i: k + 1 for k, i in enumerate(want)}


@pytest.mark.parametrize("window", [3, 20])
def test_repeats(spark, window):
    r = random.Random(window)
    passage = "".join(r.choice("abcdefgh") for _ in range(30))
    texts = [passage + "x" * 25, "yy" + passage, passage[:19] + "qqq", None, "", "é" * 12, "".join(r.choice("ab") for _ in range(60)), passage, passage]
    rows = [(i if i else None, t) for i, t in enumerate(texts[:-1])] + [(7, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    prepare(spark)
    out = cover.repeats(df.select("doc_id", text_key(), "text"), window, Stage(spark, "cover")).collect()
    got = {x["doc_id"]: seeds.merged((s["s"], s["e"]) for s in x["spans"]) for x in out}
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[k:k + window] for _, b in raw for k in range(len(b) - window + 1))
    want = {i: seeds.merged((k, k + window) for k in range(len(b) - window + 1) if seen[b[k:k + window]] > 1) for i, b in raw}
    assert {i: [tuple(x) for x in v] for i, v in got.items()} == {i: [tuple(x) for x in v] for i, v in want.items() if v}
    assert cover.repeats(df.where("false").select("doc_id", text_key(), "text"), window, Stage(spark, "cover")).count() == 0
