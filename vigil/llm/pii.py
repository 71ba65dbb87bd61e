"""Operator 3, personal data: bootstrapped contextual extraction.

Seeds are the validated base entities (e-mail, IP, payment card, phone).  The
words around a seed are lexical patterns.  Other identifier-like tokens (a
digit or ``@`` in them, outside every base span) are candidates with patterns
of their own, whatever their length; so are maximal runs of neighbouring tokens
with digits, joined on one line by blanks, hyphens or brackets, such as a phone
or card written in groups.  A run is one instance: its tokens do not count in a
pattern's confidence, and where the run becomes a span, they do not.  Patterns and instances form a bipartite graph that Spark scores
in rounds: a pattern's confidence for a kind is the share of its instances
known to be of that kind, an instance's score is the noisy-or of its
patterns.  Occurrences of well-scored instances in confident patterns become
spans of that kind.  Base spans always stay.

All counts are over all documents and pre-aggregated, so a common context is
an ordinary key.  Texts are scanned once.

Defined results: a null or empty text has no spans.  Kinds are scanned
independently; base spans of different kinds may overlap.  Rows equal in
doc_id and text get the same spans.  Extra columns are ignored.  Positions
are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X
from .common import Stage, prepare, same, text_key

KINDS = ("email", "ip", "card", "phone")
MIN_SEEDS, MIN_PATTERN, MIN_INSTANCE, ROUNDS = 3, 0.7, 0.8, 3

# Each alternative takes a whole maximal run, matched or not, so a text is
# scanned in linear time and the leftmost match is the one found.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(?:@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+))?")
_IP = re.compile(r"[0-9]++(?:(?:\.[0-9]+){3})?")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(rb"[0-9@]")
_TOKEN = re.compile(r"[0-9@][^\x20\x09-\x0D]*")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BLANK = " \t\n\x0b\x0c\r"
_BEFORE, _AFTER = "([{\"'<", ".,;:!?)]}\"'>"
_JOIN = re.compile(r"[\x20\t()\[\]-]+")
_STOP = re.compile(r"[.,;:!?]")
_DIGIT = re.compile(r"[0-9]+")
EDGE = 48      # code points looked at first on each side of a span; more, until its whole words are seen


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The base entities of a text, by kind."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = [m.span() for m in _EMAIL.finditer(text) if m[1]]
    for m in _IP.finditer(text):
        if "." in m[0] and all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m[0].split(".")):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(d) <= 19 and luhn(d):
                out["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out["phone"].append(m.span())
    return out


def _before(text: str, at: int) -> list[str]:
    """The last two whole words before a position."""
    edge = EDGE
    while True:
        words = _WORD.findall(text[max(0, at - edge):at])
        if at <= edge or len(words) > 2:          # the first word may be cut
            return words[-2:]
        edge *= 4


def _after(text: str, at: int) -> list[str]:
    """The first whole word after a position."""
    edge = EDGE
    while True:
        words = _WORD.findall(text[at:at + edge])
        if at + edge >= len(text) or len(words) > 1:
            return words[:1]
        edge *= 4


def patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around text[start:end], digits written as 0."""
    left = [_DIGIT.sub("0", w.lower()) for w in _before(text, start)]
    right = [_DIGIT.sub("0", w.lower()) for w in _after(text, end)]
    l1, r1 = left[-1] if left else "^", right[0] if right else "$"
    out = ["L " + " ".join(left), f"B {l1} _ {r1}"] if left else [f"B {l1} _ {r1}"]
    if l1[-1] in ":=#":
        out.append(f"K {l1}")
    return out


def _whole(text: str, s: int, e: int) -> tuple[int, int]:
    """Bounds of a run without the punctuation around it; a bracket stays if
    the run holds its partner."""
    lo, hi = s, e
    while hi > lo and text[hi - 1] in _AFTER:
        hi -= 1
    while lo < hi and text[lo] in _BEFORE:
        lo += 1
    for left, right in ("()", "[]", "{}", "<>"):
        more = text.count(right, lo, hi) - text.count(left, lo, hi)
        if more > 0 and lo > s and text[lo - 1] == left:
            lo -= 1
        elif more < 0 and hi < e and text[hi] == right:
            hi += 1
    return lo, hi


def candidates(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, tuple[int, int] | None]]:
    """Identifier-like tokens that no base span touches and maximal runs of
    them: start, end and, for a token of a run, the run."""
    taken = sorted(taken)
    k, run = 0, []                         # run: (raw start, raw end, start, end) of its tokens

    def flush():
        whole = _whole(text, run[0][0], run[-1][1]) if len(run) > 1 else None
        if whole:
            yield *whole, None
        for _, _, s, e in run:
            yield s, e, whole

    for m in _TOKEN.finditer(text):
        s, e = m.span()
        while s and text[s - 1] not in _BLANK:
            s -= 1
        raw = s, e
        while e > s and text[e - 1] in _AFTER:
            e -= 1
        while s < e and text[s] in _BEFORE:
            s += 1
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if s == e or any(a < e and s < b for a, b in taken[k:k + 8]):
            continue
        # a base span or any word between them ends a run, as does punctuation
        if run and not ("@" not in text[s:e] and _JOIN.fullmatch(text, run[-1][1], raw[0]) and not _STOP.search(text, run[-1][3], run[-1][1])):
            yield from flush()
            run = []
        run.append((*raw, s, e))
        if "@" in text[s:e]:
            yield from flush()
            run = []
    if run:
        yield from flush()


def instance(found: str) -> str:
    """The graph's key of an instance; a long one goes by its hash."""
    key = found.lower()
    return key if len(key) <= 64 else "#" + hashlib.sha256(key.encode()).hexdigest()


_SPAN = pa.struct([("kind", pa.string()), ("s", pa.int32()), ("e", pa.int32()), ("inst", pa.string()), ("pats", pa.list_(pa.string())),
                   ("rs", pa.int32()), ("re", pa.int32())])
SCAN = "doc_id long, tkey binary, found array<struct<kind:string, s:int, e:int, inst:string, pats:array<string>, rs:int, re:int>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans (with their kind) and candidates (kind null) of each text."""
    for b in batches:
        out = []
        for raw in X.texts_of(b):
            found = []
            if _MARK.search(raw):
                t = raw.decode()
                base = base_spans(t)
                rows = [(k, s, e, None) for k in KINDS for s, e in base[k]]
                rows += [(None, *c) for c in candidates(t, [x for k in KINDS for x in base[k]])]
                found = [{"kind": k, "s": s, "e": e, "inst": instance(t[s:e]), "pats": patterns(t, s, e),
                          "rs": run and run[0], "re": run and run[1]} for k, s, e, run in rows]
            out.append(found)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(_SPAN))], names=["doc_id", "tkey", "found"])


def score(edges: DataFrame, seeds: DataFrame, stage: Stage, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Iterative scores: (pattern, kind, conf) and (inst, kind, score).

    ``edges``: distinct (pattern, inst) with ``part``, true where the instance
    is only ever a token of a run there; ``seeds``: distinct (inst, kind)."""
    whole = edges.where("not part")
    n = whole.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    known = seeds.select("inst", "kind", F.lit(1.0).alias("score"))
    free = edges.join(seeds, "inst", "left_anti")
    for k in range(rounds):
        hits = whole.join(known, "inst").groupBy("pattern", "kind").agg(
            F.sum("score").alias("hit"), F.count(F.lit(1)).alias("known")).where(F.col("known") >= MIN_SEEDS)
        conf = hits.join(n, "pattern").select("pattern", "kind", (F.col("hit") / (F.col("n") + 1)).alias("conf"))
        conf = stage.put(conf.where(F.col("conf") >= MIN_PATTERN), f"conf{k}")
        found = free.join(conf, "pattern").groupBy("inst", "kind").agg(
            (1 - F.exp(F.sum(F.log(1 - F.col("conf"))))).alias("score"))
        found = stage.put(found, f"found{k}")
        known = seeds.select("inst", "kind", F.lit(1.0).alias("score")).unionByName(found)
    return conf, found


def find(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Per row of ``docs``: doc_id and ``spans``, an array of structs
    (kind, start, end, base) in order of kind, then start."""
    spark = docs.sparkSession
    prepare(spark)
    stage = Stage(spark, "pii")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(), "text")
    rows = stage.put(base.mapInArrow(_scan, SCAN), "scan")
    flat = rows.select("doc_id", "tkey", F.explode("found").alias("x")).select("doc_id", "tkey", "x.*")
    edges = flat.select("inst", F.explode("pats").alias("pattern"), F.col("rs").isNotNull().alias("part"))
    edges = stage.put(edges.groupBy("inst", "pattern").agg(F.min("part").alias("part")), "edges")
    seeds = stage.put(flat.where("kind is not null").select("inst", "kind").distinct(), "seeds")
    conf, found = score(edges, seeds, stage, rounds)
    good = found.where(F.col("score") >= MIN_INSTANCE).select("inst", F.col("kind").alias("new"))
    occ = flat.where("kind is null").select("doc_id", "tkey", "s", "e", "rs", "re", "inst", F.explode("pats").alias("pattern"))
    new = (occ.join(good, "inst").join(conf.select("pattern", F.col("kind").alias("new")), ["pattern", "new"])
           .select("doc_id", "tkey", "new", "s", "e", "rs", "re").distinct())
    new = stage.put(new, "new")
    runs = new.where("rs is null").select(*[F.col(c).alias(f"r_{c}") for c in ("doc_id", "tkey", "new", "s", "e")])
    inside = same(F.col("doc_id"), F.col("r_doc_id")) & (F.col("tkey") == F.col("r_tkey")) & (F.col("new") == F.col("r_new"))
    new = new.join(runs, inside & (F.col("rs") == F.col("r_s")) & (F.col("re") == F.col("r_e")), "left_anti")
    new = new.select("doc_id", "tkey", "new", "s", "e").distinct()
    more = new.groupBy("doc_id", "tkey").agg(F.collect_list(F.struct(F.col("new").alias("kind"), "s", "e")).alias("more"))
    more = more.select(F.col("doc_id").alias("m_id"), F.col("tkey").alias("m_key"), "more")
    out = rows.join(more, same(F.col("doc_id"), F.col("m_id")) & (F.col("tkey") == F.col("m_key")), "left")
    rank = F.array(*[F.lit(k) for k in KINDS])

    def spans(col, is_base: bool):
        return F.transform(F.coalesce(col, F.array().cast("array<struct<kind:string,s:int,e:int>>")), lambda x: F.struct(
            F.array_position(rank, x["kind"]).alias("rank"), x["s"].alias("start"), x["e"].alias("end"),
            x["kind"].alias("kind"), F.lit(is_base).alias("base")))

    own = F.transform(F.filter("found", lambda x: x["kind"].isNotNull()), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    every = F.array_sort(F.concat(spans(own, True), spans(F.col("more"), False)))
    return out.select("doc_id", F.transform(every, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"),
                                                                      x["end"].alias("end"), x["base"].alias("base"))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The registered query's columns."""
    base = F.filter("spans", lambda x: x["base"])

    def joined(a):
        return F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k) for k in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_added"))
