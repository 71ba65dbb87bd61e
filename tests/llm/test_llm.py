"""Operators of vigil.llm against brute force on small, awkward tables."""
import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.llm import chat, lines, minhash, mixing, packing, pii, quality, substrings, suffixes, vectors

WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = np.random.default_rng(5)
VOCAB = ["".join(rng.choice(list("abcdeé"), 4)) for _ in range(400)]


def words(n):
    return " ".join(rng.choice(VOCAB, n))


@pytest.fixture(scope="module")
def rows():
    base, passage, long_ = words(120), words(60), words(30000)
    out = [(None, base), (0, None), (1, ""), (2, " \n\t "), (3, "one two"), (3, "one two"), (4, base), (5, base),
           (6, base.replace(VOCAB[0], "zz", 1)), (7, words(80) + "\n" + passage + "\n" + words(50)),
           (8, words(70) + " " + passage + " " + words(40)), (9, long_), (10, long_ + " tail"), (11, "x " * 3000),
           (12, "la la la\nlb lb\n\nlc lc\nla la la\nlb lb\nend"), (13, "la la la\nlb lb\nother"),
           (14, "mail a.b@c.de ip 10.0.0.255 bad 10.0.0.256 card 4111 1111 1111 1111 tel +1 (988) 555-2485 x" + passage)]
    return out + [(20 + i, words(60)) for i in range(6)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With extra columns whose names clash with the operators' own."""
    df = spark.createDataFrame([(i, t, "en" if (i or 0) % 3 else None, f"src{(i or 0) % 5}", 1) for i, t in rows],
                               "doc_id long, text string, lang string, source string, tkey int")
    return df.withColumn("rep", F.lit("r")).withColumn("n", F.lit(2)).withColumn("value", F.lit(3.0))


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_empty_tables(docs):
    none = docs.where("false")
    assert minhash.near_duplicates(none).count() == 0
    assert lines.dedup_lines(none).count() == 0
    assert substrings.dedup_substrings(none).count() == 0
    assert suffixes.dedup_bytes(none).count() == 0
    assert pii.find(none).count() == 0
    assert mixing.standard_mix(none).count() == 0
    assert quality.ledger(none).count() == 0


def test_quality(docs, rows):
    want = []
    for i, t in rows:
        w = WORD.findall(t or "")
        at = collections.defaultdict(list)
        for k in range(len(w) - 2):
            at[tuple(w[k:k + 3])].append(k)
        cov = {x for v in at.values() if len(v) > 1 for k in v for x in (k, k + 1, k + 2)}
        want.append((i, len(w), sum(map(len, w)), len(cov)))
    led = quality.ledger(docs)
    assert got(led.select("doc_id", "q_n_words", "q_word_chars", "q_n_repeat_words")) == sorted(want, key=repr)
    kept = quality.kept(led, quality.POLICY)
    assert kept.count() == quality.apply_policy(led, quality.POLICY).where("q_kept").count()
    ab = {r["rule"]: r for r in quality.ablations(led, quality.POLICY).collect()}
    assert ab["few_words"]["n_kept_without"] == ab["few_words"]["n_only"] + kept.count()


def test_minhash(docs, rows):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").lower())
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    comp = {i: i for i, _ in rows}
    for _ in rows:
        for (a, _), s in zip(rows, sets):
            for (b, _), u in zip(rows, sets):
                if a is not None and b is not None and s and 100 * len(s & u) >= 75 * len(s | u):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    want = [(i, len(s), comp[i], i is None or comp[i] == i) for (i, _), s in zip(rows, sets)]
    assert got(minhash.near_duplicates(docs)) == sorted(want, key=repr)


def test_minhash_hub_rounds(spark):
    """A group whose members link with many others, few with the smallest: the
    same components for any number of hub rounds, and as brute force."""
    r = np.random.default_rng(3)
    base, texts = [f"w{k}" for k in range(300)], []
    for _ in range(60):
        w = list(base)
        for k in r.choice(300, 6, replace=False):
            w[k] = f"x{r.integers(1 << 40)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[k:k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    comp = list(range(len(sets)))
    for _ in sets:
        for a, s in enumerate(sets):
            for b, u in enumerate(sets):
                if 100 * len(s & u) >= 75 * len(s | u):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    want = sorted(((i, len(s), comp[i], comp[i] == i) for i, s in enumerate(sets)), key=repr)
    assert 1 < len(set(comp)) < len(comp)
    for n in (0, 1, 4):
        assert got(minhash.near_duplicates(df, hub_rounds=n)) == want


def test_substrings(docs, rows):
    split = [WORD.findall(t or "") for _, t in rows]
    seen = collections.Counter(tuple(w[k:k + 35]) for w in split for k in range(len(w) - 34))
    want = []
    for (i, _), w in zip(rows, split):
        gone = {x for k in range(len(w) - 34) if seen[tuple(w[k:k + 35])] > 1 for x in range(k, k + 35)}
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    out = substrings.dedup_substrings(docs)
    assert got(out.select("doc_id", "ss_words", "ss_removed", "ss_text")) == sorted(want, key=repr)
    assert set(docs.columns) <= set(out.columns)


def test_suffixes(docs, rows):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[k:k + 400] for _, b in raw if len(b) < 20000 for k in range(len(b) - 399))
    for _, b in raw:
        if len(b) >= 20000:
            seen.update(hash(b[k:k + 400]) for k in range(len(b) - 399))
    want = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 399):
            if seen[b[k:k + 400] if len(b) < 20000 else hash(b[k:k + 400])] > 1:
                gone[k:k + 400] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        want.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])).hexdigest()))
    out = suffixes.dedup_bytes(docs, digest=True).withColumn("k", F.col("sa_kept").cast("string"))
    assert got(out.select("doc_id", "sa_bytes", "sa_removed", "sa_spans", "k")) == sorted(want, key=repr)


def test_suffixes_planted_passages(spark):
    """A passage of over 50 words in two documents goes if it holds 400 bytes and stays below that."""
    r = np.random.default_rng(8)
    text = lambda n: " ".join("".join(r.choice(list("abcdefgh"), 5)) for _ in range(n))
    rows, want = [], []
    for i, size in enumerate([329, 399, 400, 401, 599]):
        passage = text(100)[:size]
        assert len(passage.split()) > 50
        for k in (0, 1):
            rows.append((2 * i + k, f"{text(40 + 9 * i)} {'pq'[k]}{passage}{'pq'[k]} {text(30 + 7 * k)}"))
            gone = size if size >= 400 else 0
            want.append((2 * i + k, len(rows[-1][1]), gone, int(gone > 0)))
    out = suffixes.dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert got(out.select("doc_id", "sa_bytes", "sa_removed", "sa_spans")) == sorted(want, key=repr)


def test_lines(docs):
    out = {r["doc_id"]: r for r in lines.dedup_lines(docs).collect()}
    assert out[13]["text"] == "other" and out[13]["ld_removed"] == 2
    assert out[12]["text"] == "la la la\nlb lb\n\nlc lc\nend"
    assert out[0]["text"] is None and out[2]["text"] == " \n\t "


def test_lines_alone(spark):
    """A repeated line goes wherever it stands, also alone or as the only line;
    short lines need a repeated neighbour."""
    long_, url = words(60), "https://example.org/a-path-without-blanks"
    texts = [f"{words(9)}\n{long_}\n{words(7)}", f"{words(8)}\n{long_}\n{words(6)}", long_, "All rights reserved.\n" + words(5),
             words(12) + "\n \nAll rights reserved.", f"{url}\n{words(4)}", f"{words(4)}\n{url}", f"Of.\n{words(4)}", f"{words(4)}\nOf.",
             f"{long_}\nnew {words(9)}\n{long_}"]
    seen, want = set(), []
    for i, t in enumerate(texts):
        keep = [x for x in t.split("\n") if x not in seen or not x.strip() or x == "Of."]
        at = [x for x in t.split("\n")]
        seen.update(at)
        want.append((i, "\n".join(keep), len([x for x in at if x.strip()]), len(at) - len(keep)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert got(lines.dedup_lines(df)) == sorted(want, key=repr)
    import corpus_pipeline
    docs = df.withColumn("n_chars", F.length("text").cast("long"))
    out = corpus_pipeline.line_stage(spark, docs, "")
    assert got(out) == sorted(((i, t, len(t)) for i, t, n, k in want if k < n), key=repr)


def test_pii(docs):
    r = {x["doc_id"]: [(s["kind"], s["base"]) for s in x["spans"]] for x in pii.find(docs).collect()}
    assert r[14] == [("email", True), ("ip", True), ("card", True), ("phone", True)] and r[0] == []


def test_pii_bootstrap(spark):
    """Seeds in a context teach the context; the context finds an unseen form."""
    rows = [(i, f"{words(8)} badge no. 10.1.2.{i} was {words(5)}") for i in range(40)] + [(99, f"{words(8)} badge no. HX7744-Q was {words(5)}")]
    out = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s["kind"], s["base"], rows[-1][1][s["start"]:s["end"]]) for s in out[99]] == [("ip", False, "HX7744-Q")]


def test_pii_bootstrap_blanks(spark):
    """Identifiers written with blanks, and very short or long ones, are found
    as one span in a learned context; what is not in one is not."""
    phones = ["(743) 555-3824", "020 7946 0958", "743 - 555 (3824)", "x7", "9" * 300]
    cards = ["4111 1111 1111 1112", "4111-1111 1111-1112"]
    rows = [(i, f"{words(8)} call me at +1 (743) 555-{3000 + i} or {words(5)}") for i in range(60)]
    rows += [(100 + i, f"{words(8)} paid by card no. {c} was {words(5)}") for i, c in enumerate(
        f"{n // 10000:04d} {n % 10000:04d} 0000 0000"[:18] + f"{d}" for n in range(41110000, 41110040) for d in range(10)
        if pii.luhn(f"{n:08d}0000000{d}"))]
    rows += [(900 + i, f"{words(8)} call me at {x} or {words(5)}") for i, x in enumerate(phones)]
    rows += [(950 + i, f"{words(8)} paid by card no. {x} was {words(5)}") for i, x in enumerate(cards)]
    rows += [(990, f"{words(4)} 12 345 6789 {words(4)}")]
    text = dict(rows)
    out = {r["doc_id"]: [(s["kind"], s["base"], text[r["doc_id"]][s["start"]:s["end"]]) for s in r["spans"]]
           for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(len(out[i]) == 1 and out[i][0][1] for i in text if i < 900)
    assert {i: v for i, v in out.items() if i >= 900} == {
        **{900 + i: [("phone", False, x)] for i, x in enumerate(phones)},
        **{950 + i: [("card", False, x)] for i, x in enumerate(cards)}, 990: []}


def test_mixing_budgets(docs, rows):
    out = mixing.standard_mix(docs)
    assert set(docs.columns) <= set(out.columns)
    assert got(out) == got(mixing.standard_mix(docs.repartition(5)))       # order of rows plays no part
    total = sum(len(WORD.findall(t or "")) for _, t in rows)
    taken = out.select(F.sum(mixing.count_tokens())).first()[0]
    longest = max(len(WORD.findall(t or "")) for _, t in rows)
    assert 0 < taken <= total + 5 * longest and out.agg(F.max("mx_epoch")).first()[0] <= 1


def test_mixing_shortage_goes_to_siblings(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "x", "2", 1000), ("b", "x", "3", 1000)],
                                   "mx_l0 string, mx_l1 string, mx_l2 string, avail long")
    t = mixing.weight_table(spark, {("a",): 1, ("b",): 1})
    b = {r["mx_l2"]: int(r["budget"]) for r in mixing.leaf_budgets(leaves, t, F.lit(400), 1).collect()}
    assert b == {"1": 10, "2": 190, "3": 200}


def test_packing(spark, docs, rows):
    P = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = P.path("word_bpe_49k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    out = packing.pack(docs, path, capacity=512).collect()
    n = collections.Counter()
    for i, t in rows:
        n[i] += len(tok.encode(t or "", add_special_tokens=False).ids) + 1
    have = collections.Counter()
    bins = collections.defaultdict(list)
    for r in out:
        have[r["doc_id"]] += r["length"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert have == n
    for b in bins.values():
        at = 0
        for o, k in sorted(b):
            assert o == at
            at += k
        assert at <= 512
    assert len(bins) <= -(-sum(n.values()) // 512) + 2


def test_local_search_empties_bins():
    sizes = np.array([6, 4, 5, 3, 2])
    owner = packing.local_search(sizes, [[0, 3], [1, 2], [4]], 10)
    assert len(set(owner.tolist())) == 2 and np.bincount(owner, sizes).max() <= 10


def test_encoder_equals_tokenizer():
    P = pytest.importorskip("public_tokenizers")
    e = packing.Encoder(P.path("word_bpe_49k.json"))
    for t in ["É. %%%, x—, é, It's. ok\n.. a., b", "a\x0bb c\x1cd e\x85f <|endoftext|>abc <|ENDOFTEXT|> Σ ΑΣ", "", "İ é, 12.5, x.\n"]:
        assert np.frombuffer(e(t.encode()), "<u4").tolist() == e.tok.encode(t, add_special_tokens=False).ids


def test_vectors(spark):
    x = rng.standard_normal((150, 16))
    x[50:80] = x[:30] + 0.1 * rng.standard_normal((30, 16))
    x[80:90] = x[3]
    vals = [[float(v) for v in r] for r in x] + [None, [0.0] * 16, [float("nan")] * 16, [1.0] * 8, []]
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vals)], "vec_id long, embedding array<double>, cls int")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T >= 0.9
    np.fill_diagonal(s, False)
    lab = list(range(150))
    for _ in range(20):
        for a, b in zip(*np.nonzero(s)):
            lab[a] = lab[b] = min(lab[a], lab[b])
    want = [(i, int(s[i].sum()), lab[i], lab[i] == i) for i in range(150)] + [(i, 0, i, True) for i in range(150, 155)]
    assert got(vectors.near_vectors(df)) == sorted(want, key=repr)
    assert vectors.near_vectors(df.where("false")).count() == 0


@pytest.mark.parametrize("dim", [1, 2, 3, 16, 64, 200])
@pytest.mark.parametrize("n", [10, 500, 5000, 50000])
def test_vectors_caps_share_a_filter(n, dim):
    """Fresh pairs at the threshold and just above it have a common filter."""
    height, words, turns = vectors.plan(n, dim)
    c = vectors.caps(dim, height, words)
    for cosine in (0.9, 0.92):
        x, y = vectors.pairs_at(np.random.default_rng([n, dim]), 1000, dim, cosine)
        left = np.ones(len(x), bool)
        for k in range(turns):
            a, b = (set(zip(*map(np.ndarray.tolist, c.decode(v, k)))) for v in (x, y))
            left[[r for r, _ in a & b]] = False
        assert not left.any()


def test_vectors_planted_recall(spark):
    """All links of planted pairs at 0.90 to 0.92, in two lengths, against all pairs."""
    r, vals, want = np.random.default_rng(11), [], []
    for dim, n in ((64, 2500), (24, 400)):
        x, y = (np.concatenate(v) for v in zip(*(vectors.pairs_at(r, n // 5, dim, c) for c in (0.9000001, 0.905, 0.91, 0.915, 0.92))))
        u = np.concatenate([x, y])
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        want += ((u @ u.T >= 0.9).sum(1) - 1).tolist()
        vals += u.tolist()
    df = spark.createDataFrame(list(enumerate(vals)), "vec_id long, embedding array<double>")
    have = {r["vec_id"]: r["n_links"] for r in vectors.near_vectors(df).collect()}
    assert have == dict(enumerate(want)) and min(want) >= 1


def test_chat(spark):
    evil = "~0 ~ <|turn|>user\nx<|end|>\n[INST] </s> ~1 [/INST] ~"
    turns = [(1, k, ["user", "assistant"][k % 2], f"{words(40)} {evil}") for k in range(30)]
    turns += [(2, 0, "system", "rules " + evil), *[(2, 1 + k, ["user", "assistant"][k % 2], words(30)) for k in range(20)]]
    turns += [(3, 0, "assistant", None), (3, 0, None, "tie"), (None, None, "a\nb", "x"), (4, 0, "system", "alone"), (5, 0, "user", words(900))]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, win int")
    wins = chat.windows(df, budget=200, history=60).cache()
    order = sorted(turns, key=lambda t: (repr(t[0]), t[1] if t[1] is not None else -1, t[2] or "", t[3] or ""))
    conv = collections.defaultdict(list)
    for c, _, r, t in order:
        conv[c].append((r or "", t or ""))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {c: (len(v), sha("".join(f"{r}\n{t}\n" for r, t in v)), sha("".join(t for r, t in v if r == "assistant"))) for c, v in conv.items()}
    back = chat.read_back(wins).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_sha256"]) for r in back} == want
    assert all(r["n_tokens"] <= 200 for r in wins.where("conv_id = 2").collect())
    assert wins.where("conv_id = 2 and text not like '%rules%'").count() == 0
    assert wins.where("conv_id = 2 and n_repeated > 1").count() > 0
    assert chat.windows(df.where("false")).count() == 0


def test_chat_hot_conversation(spark):
    """One conversation cut into several ranges, with equal turns, ties, a null
    turn and one very long text: places and sums as counted one by one."""
    turns = [(7, k // 3, ["user", "assistant", "user"][k % 3], words(5)) for k in range(600)]
    turns += [(7, 50, "user", "same")] * 200
    turns += [(7, None, "system", "rules"), (7, 10**12, "assistant", "y " * 200_000), (8, 0, "system", "s"), (8, 1, "user", "u")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(7)
    aqe = "spark.sql.adaptive.coalescePartitions.enabled"
    was = spark.conf.get(aqe)
    spark.conf.set(aqe, "false")                # as many ranges as shuffle partitions
    try:
        placed = chat._placed(df).collect()
    finally:
        spark.conf.set(aqe, was)
    rows = sorted((r for r in placed if r["conv_id"] == 7), key=lambda r: r["seq"])
    assert [r["seq"] for r in rows] == list(range(1, len(turns) - 1))
    total = 0
    for r in rows:
        total += r["tokens"] - r["system"]
        assert r["upto"] == total and r["sys"] == rows[0]["tokens"]
    want = sorted((t for t in turns if t[0] == 7), key=lambda t: (-1 if t[1] is None else t[1], t[2], t[3]))
    assert [r["wtext"] for r in rows] == [t[3] for t in want]


def test_components(spark):
    """A long path, a hot star, a ring and loose pairs: smallest reachable id."""
    from vigil.llm.common import Stage, prepare
    from vigil.llm.graph import components
    prepare(spark)
    edges = [(k, k + 1) for k in range(100, 140)] + [(500, k) for k in range(501, 700)] + [(7, 8), (8, 7), (9, 9)]
    edges += [(900 + k, 900 + (k + 1) % 6) for k in range(6)] + [(int(a), int(b)) for a, b in rng.integers(2000, 2100, (60, 2))]
    low = {x: x for e in edges for x in e}
    for _ in low:
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    want = sorted((x, c) for x, c in low.items() if any(a != b and x in (a, b) for a, b in edges))
    found = components(spark.createDataFrame(edges, "a long, b long"), Stage(spark, "graph"))
    assert sorted(map(tuple, found.collect())) == want
