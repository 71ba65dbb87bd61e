"""Operator 13: decoding of planted disguises, held-out accuracy, odd rows."""
import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vigil.llm import toxic
from vigil.llm.queries import QUERIES

BAD = ["grobnik", "stupid", "worthless", "vermin"]
SIGNS = {"o": "0", "i": "1", "e": "3", "a": "@", "s": "$", "t": "7"}


def disguise(word, kind, r):
    if kind == "signs":
        return "".join(SIGNS.get(c, c) for c in word)
    if kind == "blanks":
        return " ".join(word)
    if kind == "dots":
        return "-".join(word)
    if kind == "repeats":
        i = r.randrange(1, len(word) - 1)
        return word[:i] + word[i] * r.randrange(3, 6) + word[i + 1:]
    return word.upper() if kind == "upper" else word


def corpus(seed, n, kinds=("plain",)):
    r = random.Random(seed)
    syl = ["ka", "lo", "mir", "ten", "sha", "u", "pel", "or", "dan", "vi", "est", "rum"]
    vocab = ["".join(r.choices(syl, k=r.randrange(1, 4))) for _ in range(600)]
    docs, labels = [], []
    for i in range(n):
        w = r.choices(vocab, k=r.choice([20, 80, 300]))
        bad = i % 4 == 0
        for _ in range(r.randrange(1, 4) if bad else 0):
            w.insert(r.randrange(len(w)), disguise(r.choice(BAD), r.choice(kinds), r))
        docs.append((i, " ".join(w) + "."))
        labels.append((i, int(bad)))
    return docs, labels


def frames(spark, docs, labels):
    d = spark.createDataFrame([(i, t, 1.5, "x") for i, t in docs], "doc_id long, text string, score double, word string")
    return d.repartition(3), spark.createDataFrame([(i, 1, x) for i, x in labels], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def trained(spark):
    docs, labels = corpus(1, 400)
    return toxic.char_model(frames(spark, docs, labels)[0])


@pytest.mark.parametrize("written", ["gr0bn1k", "G R O B N I K", "g-r-o-b-n-i-k", "grooobnik", "(gr0bnik!)", "g.r.0.b.n.1.k", "grob*ik", "g r 0 b n i k"])
def test_restores(trained, written):
    out = toxic.restored([b"kalo " + written.encode() + b" mirten"], trained)[0].decode()
    assert "grobnik" in out and out.startswith("kalo ") and out.endswith(" mirten")


def test_leaves_ordinary_text_alone(trained):
    texts = ["Kalo MIRTEN, est. Sha 2024 (15%) 3.5 tenn --- a.b u\nor é\n", "", "mir" * 2000, "!!! ... ***", "ka lo\nu"]
    assert [x.decode() for x in toxic.restored([t.encode() for t in texts], trained)] == texts


def test_counts_cover_every_word(spark):
    docs = spark.createDataFrame([("ab ab",), (None,), ("",), ("Ab",)], "text string")
    got = {r["gram"]: r["n"] for r in docs.mapInArrow(toxic._gram_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    a, ab, end = 1, (1 << 5) | 2, (1 << 10) | (2 << 5)
    assert got == {a: 3, ab: 3, end: 3}


def test_model_is_a_distribution(trained):
    import numpy as np
    p = np.exp(np.frombuffer(trained.log, np.float32).reshape(-1, 32)).sum(axis=1)
    assert np.allclose(p, 1, atol=1e-3)


def test_held_out_accuracy_on_disguised_words(spark):
    """Trained on plainly written words, tested on every disguise."""
    docs, labels = corpus(2, 500)
    hard, truth = corpus(2, 300, ("signs", "blanks", "dots", "repeats", "upper"))
    docs += [(10_000 + i, t) for i, t in hard]
    out = {r["doc_id"]: r for r in toxic.toxicity(*frames(spark, docs, labels)).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) for i, r in out.items())
    held = [(out[i]["predicted"], x) for i, x in labels if out[i]["held_out"]]
    assert sum(p == x for p, x in held) / len(held) > 0.97
    caught = [out[10_000 + i]["predicted"] for i, x in truth if x]
    clean = [out[10_000 + i]["predicted"] for i, x in truth if not x]
    assert sum(caught) / len(caught) > 0.9 and sum(clean) / len(clean) < 0.03


def test_labels_of_held_out_rows_are_not_used(spark):
    docs, labels = corpus(3, 200)
    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    flipped = [(i, 1 - x if i in held else x) for i, x in labels]
    a, b = ({r["doc_id"]: r["score"] for r in toxic.toxicity(*frames(spark, docs, x)).collect()} for x in (labels, flipped))
    assert a == pytest.approx(b, abs=1e-9)


def test_odd_rows(spark):
    docs, labels = corpus(4, 120)
    docs += [(None, "x"), (5, None), (6, ""), (3, "stupid"), (3, "stupid"), (900, "a" * 50000 + " s t u p i d"), (901, "1" * 3000 + "a0" * 3000)]
    labels += [(None, 1), (7, None), (8, 5), (9, 0), (9, 1)]
    d, lab = frames(spark, docs, labels)
    out = toxic.toxicity(d, lab)
    assert out.count() == len(docs) and out.where("score is null or score < 0 or score > 1 or held_out is null").count() == 0
    assert out.where("doc_id is null and held_out").count() == 1
    assert toxic.toxicity(d.where("false"), lab).count() == 0
    for none in (lab.where("false"), lab.where("toxic = 0")):
        assert toxic.toxicity(d, none).where("predicted = 0").count() == len(docs)
    text = toxic.deobfuscate(d)
    assert text.columns == [*d.columns, "restored"] and text.where("text is null").select("restored").first()[0] is None


def test_group_in_pieces():
    batch = pa.RecordBatch.from_pydict({"text": ["ka lo"] * 3})
    assert sum(b.num_rows for b in toxic._gram_counts(iter([batch]))) == 6


def test_query_held_out(spark):
    d = "/root/testdata/sf0.001"
    out = QUERIES["op13_toxicity"](spark, d)
    n = spark.read.parquet(f"{d}/documents.parquet").count()
    assert out.count() == n
    hit = out.where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    right = hit.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0]
    assert right is None or right >= 0.8
