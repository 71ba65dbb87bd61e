"""Operator 11 against a plain ranking of all documents."""
import collections
import math
import random
import re

import pytest

from vigil.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(docs, items, k=10):
    tfs = [(i, collections.Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    tfs = [(i, c) for i, c in tfs if c]
    n_docs, n_terms = len(tfs), sum(sum(c.values()) for _, c in tfs)
    df = collections.Counter(t for _, c in tfs for t in c)
    out = []
    for item, text in items:
        ask = collections.Counter(TERM.findall((text or "").translate(LOWER)))
        scored = []
        for i, c in tfs:
            m = 25 + (75 * sum(c.values()) * n_docs) // n_terms
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t, q in ask.items() if t in c)
            if s > 0:
                scored.append((-s, i is not None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def corpus(seed, n):
    r = random.Random(seed)
    vocab = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(400)]
    pick = lambda m: " ".join(r.choice(vocab[:r.choice([20, 400])]) for _ in range(m))
    copy = pick(40)
    docs = [(i, pick(r.choice([1, 5, 60, 200]))) for i in range(n)]
    docs += [(1000 + i, copy) for i in range(n // 2)] + [(5, copy), (5, "w1 w2"), (5, "w1 w2"), (None, copy), (None, "w3, W3! w4_w5"), (7000, None),
             (7001, ""), (7002, " .,;\n"), (7003, "w6 " * 700), (7004, pick(30000)), (7005, "W1-W2\tw3\x7fw4 İ ÀB")]
    r.shuffle(docs)
    items = [(i, pick(r.choice([1, 3, 30]))) for i in range(12)] + [(50, copy), (50, copy), (51, None), (52, ""), (None, "w1 w1 w2"),
             (53, "nowhere at all"), (54, "w6"), (55, "W4 x"), (56, docs[0][1]), (57, "i̇ àb Àb")]
    return docs, items


def tables(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, "s", 2.0) for i, t in docs], "doc_id long, text string, qid int, sketch string, bound double")
    return d.repartition(5), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, qid int")


def test_against_brute_force(spark):
    docs, items = corpus(1, 120)
    assert got(search.search(*tables(spark, docs, items))) == brute(docs, items)


@pytest.mark.parametrize("values", [{"SEEDS": 1, "GROWTH": 2, "ROWS": 1, "SPREAD": 1, "BROADCAST_PAIRS": 0}, {"BATCH_TERMS": 60}])
def test_many_rounds_and_batches(spark, monkeypatch, values):
    """Loose sketches and single seeds force rounds; small batches force several passes."""
    docs, items = corpus(2, 60)
    for k, v in values.items():
        monkeypatch.setattr(search, k, v)
    if "BATCH_TERMS" in values:
        items = items[8:16]
    assert got(search.search(*tables(spark, docs, items), k=3)) == brute(docs, items, 3)


def test_empty_tables(spark):
    docs, items = tables(spark, *corpus(3, 5))
    assert search.search(docs.where("false"), items).count() == 0
    assert search.search(docs, items.where("false")).count() == 0


def test_bound_is_never_below_the_score():
    docs, items = corpus(4, 80)
    texts = [(t or "").encode() for _, t in docs]
    doc, h, tf, n = search.counted(texts)
    terms = [search.Terms([(t or "").encode()]).hashes().view("int64").tolist() for _, t in items]
    batch = search.Batch([i for i, t in enumerate(terms) if t], [t for t in terms if t])
    batch.weigh(len(docs), int(n.sum()), {})
    loose = 0
    for i, s in enumerate(search.sketches(doc, h, tf, len(texts))):
        if s:
            mine = doc == i
            at, term = batch.hits(h[mine])
            exact = search.np.zeros(len(batch.vocab), search.np.int64)
            exact[term] = search.impact(tf[mine][at], batch.m(int(n[i])))
            bound, score = batch.bound(s, int(n[i]), {}), batch.totals(exact)
            assert (bound >= score).all()
            loose += (bound > score * 1.05).mean()
    assert loose < 0.1 * len(texts)
