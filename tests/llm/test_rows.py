"""Row identity, clashing column names, and the pipeline's stages one by one."""
import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vigil.llm import lines, minhash, mixing, packing, pii, quality, substrings, suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Two numbers whose texts share a 32-bit ``hash()`` (found by search; checked below).
SAME_HASH = (11969, 106634)
SAME_HASH_PII = (113868, 50749)


def text_b(i):
    return " ".join(f"{i}w{k}" for k in range(60))


def text_a(i):
    return f"{i}x said {i}y badge no. HX7744-Q was {i}z"


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_different_texts_never_share_a_key(spark):
    a, b = map(text_b, SAME_HASH)
    df = spark.createDataFrame([(None, a), (None, b), (1, a)], "doc_id long, text string")
    assert df.select(F.hash("text")).distinct().count() == 1 and a != b
    want = sorted([(None, 60), (None, 0), (1, 60)], key=repr)
    assert got(substrings.dedup_substrings(df).select("doc_id", "ss_removed")) == want
    out = suffixes.dedup_bytes(df, digest=True).select("doc_id", (F.col("sa_removed") > 0).cast("int"))
    assert got(out) == sorted([(None, 1), (None, 0), (1, 1)], key=repr)
    assert got(lines.dedup_lines(df).select("doc_id", "text")) == sorted([(None, a), (None, b), (1, "")], key=repr)


def test_different_texts_never_share_spans(spark):
    a, b = text_a(SAME_HASH_PII[0]), text_b(SAME_HASH_PII[1])
    rows = [(i, f"some words here badge no. 10.1.2.{i} was seen") for i in range(40)] + [(None, a), (None, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert df.where("doc_id is null").select(F.hash("text")).distinct().count() == 1
    spans = [[s["kind"] for s in r["spans"]] for r in pii.find(df).where("doc_id is null").collect()]
    assert sorted(spans) == [[], ["ip"]]


CLASH = ["epochs", "cut", "rest", "nd_id", "id", "row", "tkey", "ld__key", "ss__key", "sa__key", "mx_l0", "mx_l1", "mx_id", "mx_last", "p_mx_l0",
         "q__w", "q__l", "q__row", "w_exact", "rank", "bucket", "n", "spans", "ztext", "rep", "s_id", "avail", "budget"]


@pytest.fixture(scope="module")
def odd(spark):
    """Rows of the columns of documents and every internal column name."""
    long_ = " ".join(f"k{i % 97}v{i % 31}" for i in range(5000))
    rows = [(None, "alpha beta " * 30, None, None), (1, None, "en", "src1"), (2, "", "de", None), (3, long_, "en", "src2"), (4, long_ + " tail", None, "src2"),
            (5, "one line here now\nshared line of words\n", "fr", "src3"), (6, "shared line of words\nother one", "fr", "src3"),
            (6, "shared line of words\nother one", "fr", "src3"), *[(10 + i, " ".join(f"d{i}w{k % 60}" for k in range(80)), "en", f"src{i % 4}") for i in range(8)]]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in CLASH})


def untouched(out, odd):
    assert set(odd.columns) <= set(out.columns)
    for r in out.collect():
        assert all(r[c] == f"{c}:{'-' if r['doc_id'] is None else r['doc_id']}" for c in CLASH)


def test_clashing_names_pass_through(odd):
    untouched(lines.dedup_lines(odd), odd)
    untouched(substrings.dedup_substrings(odd), odd)
    untouched(suffixes.dedup_bytes(odd), odd)
    untouched(mixing.standard_mix(odd), odd)
    untouched(minhash.dedup(odd), odd)
    untouched(quality.kept(quality.ledger(odd), quality.POLICY), odd)
    assert minhash.near_duplicates(odd).count() == pii.find(odd).count() == odd.count()


def test_names_of_the_result_raise(odd):
    for name, run in {"ld_lines": lines.dedup_lines, "ss_text": substrings.dedup_substrings, "sa_kept": suffixes.dedup_bytes,
                      "mx_epoch": mixing.standard_mix, "q_failed": quality.ledger, "Q_n_words": quality.ledger}.items():
        with pytest.raises(ValueError, match=name.lower()):
            run(odd.withColumn(name, F.lit(1)))


def test_stages_keep_every_column(spark, odd):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, "")
        assert out.columns == odd.columns, name
        untouched(out, odd)
        assert stage(spark, odd.where("false"), "").count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, odd.where("false"), "").count() == 0


def test_quality_stage(spark, odd):
    rows = got(odd.select("doc_id", "text"))
    want = []
    for i, t in rows:
        t = t or ""
        w = WORD.findall(t)
        at = collections.Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
        rep = {x for k in range(len(w) - 2) if at[tuple(w[k:k + 3])] > 1 for x in (k, k + 1, k + 2)}
        chars = sum(map(len, w))
        fails = (len(w) < 50 or 100 * len(rep) > 50 * len(w) or 10 * sum(c in "#*$%&|<>" for c in t) > 3 * len(w)
                 or 10 * t.count("!") > 3 * len(w) or (w and 10 * sum(c.isupper() for c in t) > 6 * chars))
        if not fails:
            want.append((i, t))
    assert want and got(corpus_pipeline.quality_stage(spark, odd, "").select("doc_id", "text")) == want


def test_near_stage(spark, odd):
    rows = odd.select("doc_id", "text").collect()
    sets = []
    for r in rows:
        w = WORD.findall((r["text"] or "").lower())
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    low = {r["doc_id"]: r["doc_id"] for r in rows}
    for _ in rows:
        for r, s in zip(rows, sets):
            for q, u in zip(rows, sets):
                a, b = r["doc_id"], q["doc_id"]
                if a is not None and b is not None and s and 100 * len(s & u) >= 75 * len(s | u):
                    low[a] = low[b] = min(low[a], low[b])
    want = sorted(((r["doc_id"], r["text"]) for r in rows if r["doc_id"] is None or low[r["doc_id"]] == r["doc_id"]), key=repr)
    assert len(want) < len(rows) and got(corpus_pipeline.near_stage(spark, odd, "").select("doc_id", "text")) == want


def tokens(t):
    return len(WORD.findall(t or ""))


def brute_mix(rows, weights, langs, epochs=2, seed=7):
    """(doc_id, text, epoch) by plain water-filling and ordered prefixes."""
    def path(r):
        m = re.search(r"([0-9]+)$", r["source"] or "")
        return f"d{int(m[1]) % 4}" if m else "none", r["lang"], r["source"]

    leaves = collections.defaultdict(list)
    for r in rows:
        leaves[path(r)].append(r)
    avail = {p: sum(tokens(r["text"]) for r in v) for p, v in leaves.items()}

    def cap(prefix):
        return sum(a * epochs for p, a in avail.items() if p[:len(prefix)] == prefix)

    def weight(node):
        return weights.get(node[0], 1) if len(node) == 1 else langs.get(node[-1], 1) if len(node) == 2 else 1

    def fill(prefix, budget):
        if len(prefix) == 3:
            return {prefix: budget}
        kids = sorted({p[:len(prefix) + 1] for p in avail if p[:len(prefix)] == prefix}, key=repr)
        got, left = {}, list(kids)
        while True:
            b, w = budget - sum(got.values()), sum(map(weight, left))
            full = [k for k in left if cap(k) * w <= weight(k) * b]
            if not full:
                break
            got.update({k: cap(k) for k in full})
            left = [k for k in left if k not in full]
        got.update({k: weight(k) * b // w for k in left})
        out = {}
        for k in kids:
            out.update(fill(k, got[k]))
        return out

    taken = []
    for p, b in fill((), sum(avail.values())).items():
        if not avail[p]:
            continue
        whole, rest = divmod(b, avail[p])

        def rank(r, e):
            return hashlib.md5(f"{seed}:{e}:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()
        cut, sofar = None, 0
        by = collections.defaultdict(int)
        for r in leaves[p]:
            by[rank(r, whole)] += tokens(r["text"])
        for k in sorted(by):
            if sofar < rest:
                cut = k
            sofar += by[k]
        for r in leaves[p]:
            n = whole + (cut is not None and rank(r, whole) <= cut)
            taken += [(r["doc_id"], r["text"], e) for e in range(n)]
    return sorted(taken, key=repr)


def test_mix_stage_draws_the_prefix(spark, odd):
    rows = odd.select("doc_id", "text", "lang", "source").collect()
    want = brute_mix(rows, {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, mixing.LANG_WEIGHTS)
    assert got(mixing.standard_mix(odd).select("doc_id", "text", "mx_epoch")) == want
    out = corpus_pipeline.mix_stage(spark, odd, "")
    assert got(out.select("doc_id", "text")) == sorted([w[:2] for w in want], key=repr)


def test_shares_are_rounded_down(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 10**9), ("b", "x", "2", 10**9)], "mx_l0 string, mx_l1 string, mx_l2 string, avail long")
    t = mixing.weight_table(spark, {("a",): 2_999_999, ("b",): 1})
    assert {r["mx_l0"]: int(r["budget"]) for r in mixing.leaf_budgets(leaves, t, F.lit(1), 1).collect()} == {"a": 0, "b": 0}


def test_pack_stage(spark, odd):
    tokenizers = pytest.importorskip("tokenizers")
    import numpy as np
    import zlib
    tok = tokenizers.Tokenizer.from_file(corpus_pipeline.vocabulary())
    want = []
    for r in odd.select("doc_id", "text").collect():
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want += [(r["doc_id"], k, a, len(ids[a:a + 4096]), zlib.crc32(np.array(ids[a:a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    out = corpus_pipeline.pack_stage(spark, odd, "")
    assert got(out.select("doc_id", "piece", "start", "length", "ids_crc32")) == sorted(want, key=repr)


def test_every_repeated_line_goes_at_the_lowest_minimum(spark):
    texts = ["Of.\nThe end", "x\nOf.\ny", "Of.", "z\n \nThe end\nz"]
    seen, want = set(), []
    for i, t in enumerate(texts):
        kept = []
        for x in t.split("\n"):
            if not x.strip() or x not in seen:
                kept.append(x)
            seen.add(x)
        want.append((i, "\n".join(kept)))
    out = lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), line_words=1)
    assert got(out.select("doc_id", "text")) == want


def test_line_runs_against_brute_force(spark):
    """Runs of two short lines that stand earlier, in random texts."""
    import random
    r = random.Random(9)
    texts = ["\n".join(r.choice(["a", "b", "c d", "e", "", "f"]) for _ in range(r.randrange(0, 12))) for _ in range(30)]
    full = [[x for x in t.split("\n") if x.strip()] for t in texts]
    first = {}
    for i, f in enumerate(full):
        for k in range(len(f) - 1):
            first.setdefault((f[k], f[k + 1]), (i, k))
    want = []
    for i, (t, f) in enumerate(zip(texts, full)):
        gone = {x for k in range(len(f) - 1) if first[f[k], f[k + 1]] < (i, k) for x in (k, k + 1)}
        want.append((i, len(f), len(gone)))
    out = lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert got(out.select("doc_id", "ld_lines", "ld_removed")) == sorted(want, key=repr)


def test_context_words_are_whole():
    long_ = "y" * 500
    assert pii._before(f"a b {long_} c 1", len(f"a b {long_} c ")) == [long_, "c"]
    assert pii._before(f"{long_} {long_} 1", 1002) == [long_, long_]
    assert pii._after(f"1{' ' * 300}{long_} z", 1) == [long_]
    assert pii._before("1", 0) == [] and pii._after("1", 1) == []


def test_base_spans_against_plain_patterns(spark):
    """Every base kind by its contract's pattern, spans and digest included."""
    texts = ["a.b@c.de x@y z@w.q.r. 1.2.3.4 256.1.1.1 1.2.3.4.5 4111 1111 1111 1111 4111111111111112 +1 (988) 555-2485 +12 3",
             "é 10.0.0.1, mail: q_w%e+r-t@a-b.co.uk;4111-1111-1111-1111", "", None, "+4111111111111111 +49 30 1234567."]

    def luhn(d):
        return sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0
    want = []
    for i, t in enumerate(texts):
        t, spans = t or "", []
        spans += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        spans += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub(r"\D", "", m[0])
            spans += [("card", *m.span())] if 16 <= len(d) <= 19 and luhn(d) else []
        spans += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        n = collections.Counter(k for k, _, _ in spans)
        want.append((i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(joined.encode()).hexdigest(), joined))
    out = pii.digest(pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert got(out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")) == want


def test_packing_is_whole(odd):
    assert packing.pack(odd, corpus_pipeline.vocabulary()).select(F.sum("length")).first()[0] > 0
