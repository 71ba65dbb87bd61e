"""Operator 12 against a plain walk over all prefixes."""
import collections
import hashlib
import random
import zlib

import pyarrow as pa
import pytest

from vigil.llm import trie
from vigil.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, d long, k1 string, own int"


def rebuild(turns):
    convs = collections.defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            convs[c].append((t is not None, t or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return convs, out


def brute(convs):
    members, ended = collections.defaultdict(list), collections.defaultdict(list)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ended[tuple(seq)].append(c)
    kids = collections.defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ended[p]))).encode()).hexdigest()) for p, m in members.items())


def got(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda r: (r[0], r[1]))


def table(spark, turns):
    return spark.createDataFrame([(*t, 9, "x", 1) for t in turns], SCHEMA)


def random_turns(n, seed):
    r = random.Random(seed)
    texts = ["", "é hello", "ok", "yes, " * 9, "no", None]
    out = [(c, t, r.choice(["user", "assistant", None]), r.choice(texts) if r.random() < .9 else f"t{r.random()}")
           for c in r.sample(range(-3, 4 * n), n) for t in range(r.choice([0, 1, 2, 4, 7]))]
    out += [(c, t, "user", "same") for c in range(1000, 1000 + n) for t in range(3)]      # one group holds a third
    out += [(2000, None, "user", "a"), (2000, None, "user", "a"), (2000, 0, "b", "z"), (2000, 0, "a", "z"), (2000, 5, None, None),
            (None, 1, "user", "lost"), (2001, 0, "user", "only"), (2101, 0, "user", "x")]
    r.shuffle(out)
    return out


def test_trie_against_brute_force(spark, monkeypatch):
    turns = random_turns(60, 1)
    plain, again = rebuild(turns)
    df = table(spark, turns)
    assert got(trie.shared_starts(df)) == brute(again)
    assert got(trie.prefix_trie(df)) == brute(plain)
    # small bands, blocks and pieces: many shards and waves, ends in several pieces
    monkeypatch.setattr(trie, "BAND_BITS", 1)
    monkeypatch.setattr(trie, "BLOCK", 3)
    monkeypatch.setattr(trie, "PIECE", 7)
    assert got(trie.shared_starts(df)) == brute(again)


def test_long_conversation_splits(spark):
    turns = [(7, t, "user", f"turn {t % 50}") for t in range(9000)] + [(8, t, "user", f"turn {t % 50}") for t in range(4500)]
    df = table(spark, turns)
    out = got(trie.prefix_trie(df))
    assert len(out) == 9001 and out[0][:5] == (7, 0, None, 2, 1) and out[-1][1:6] == (9000, 7, 1, 0, 1)
    assert out[0][6] == sum(len(f"turn {t % 50}") for t in range(4500))


def test_empty(spark):
    assert trie.shared_starts(table(spark, [(1, 1, "a", "b")]).where("false")).count() == 0


def test_queue_spills():
    r = random.Random(3)
    q, want = trie.SpillingQueue(6, 5), collections.Counter()
    items = [(r.randrange(4), r.randrange(3), 0, 0, r.randrange(9), 1) for _ in range(200)]
    for x in items:
        q.push(x)
        want[x[:3]] += x[4]
    assert q.runs > 10
    assert {k: sum(m[4] for m in q.take(k)) for k in sorted(want)} == dict(want)


def test_forward_same_with_tiny_queue():
    # a comb: each spine node has one more leaf
    rows = [(1, 0, 0)] + [(d, 1, 0) for d in range(2, 60)] + [(d, 2, 1) for d in range(2, 60)]
    rows.sort(key=lambda x: (-x[0], x[1], x[2]))
    cols = {"d": [x[0] for x in rows], "k1": [x[1] for x in rows], "k2": [x[2] for x in rows],
            "p1": [1 if x[0] > 2 else 0 for x in rows], "p2": [0] * len(rows), "inside": [int(x[0] > 1) for x in rows],
            "own": [1] * len(rows), **{c: [0] * len(rows) for c in ("children", "leaves", "saved", "p_band", "p_blk")}}
    batch = pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in cols.items()})
    a, b = (list(trie.forward(iter([batch]), n))[0].to_pydict() for n in (1 << 18, 2))
    assert a == b and a["n_leaves"][-1] == 59 and a["saved"][-1] == len(rows) and a["n_children"][-1] == 2


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_whole_table(spark, sf):
    d = f"/root/testdata/{sf}"
    turns = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op12_trie"](spark, d)) == brute(rebuild(turns)[1])
