"""Operator 9, quality rules: a rule bitmask ledger (native expressions only).

Every rule is evaluated once per document.  The ledger keeps the raw
measurements and one long whose bit *b* is set when rule *b* fails.  A policy
is a versioned mask of enforced bits, so a new policy needs no new pass over
the texts, and an ablation ("what would the policy keep without rule r?") is
bit arithmetic over the counts of distinct failure masks.

Defined results: a null or blank text has no words (measurements 0, fails
``few_words``).  Repeated rows are judged alike, row by row.  Extra columns
pass through untouched, whatever their names; a column that the ledger adds
(``q_`` and a measurement, ``q_failed``, ``q_kept``) raises.  An empty table gives an empty ledger.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_of, fresh

BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: str          # SQL predicate over the measurement columns


#: Registered once; a bit is never reused for another rule.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "bangs", "10 * n_bangs > 3 * n_words"),
    Rule(4, "upper_case", "n_words > 0 and 10 * n_upper > 6 * word_chars"),
    Rule(5, "word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule(6, "repeated_lines", "10 * n_dup_lines > 5 * n_lines"),
)

#: version -> names of the rules it enforces.
POLICIES = {
    "base-1": ("few_words", "repeated_words"),
    "default-1": ("few_words", "repeated_words", "symbols", "bangs", "upper_case"),
    "strict-1": tuple(r.name for r in RULES),
}
#: The registered query and the pipeline use this version.
POLICY = "default-1"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs", "n_upper")


def _chars_of(text: Column, chars: str) -> Column:
    """How many of ``chars`` the text holds."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often it is used
    and wherever the optimizer copies the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(words: Column) -> Column:
    """One long per 3-word window."""
    return F.when(F.size(words) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2))))


def _covered(pairs: Column) -> Column:
    """Words covered by repeated windows, from (hash, start) pairs sorted."""
    n = F.size(pairs)
    hits = F.filter(pairs, lambda x, j: ((j > 0) & (F.get(pairs, j - 1)["h"] == x["h"]))
                    | ((j < n - 1) & (F.get(pairs, j + 1)["h"] == x["h"])))
    at = F.array_sort(F.transform(hits, lambda x: x["i"]))
    return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
                       lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
                       lambda a: a["n"])


def _repeat_words(words: Column) -> Column:
    """Words inside a 3-word window that occurs twice or more.

    Windows are hashed to longs and sorted with their position; equal
    neighbours are the repeated ones.  In position order each repeated start
    covers 3 words, less what the next repeated start covers too."""
    def count(g: Column) -> Column:
        pairs = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(_bind(pairs, _covered))

    return _bind(words, lambda w: _bind(_windows(w), count))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurement columns (longs), each prefixed ``q_``."""
    free_of(docs, *[f"q_{k}" for k in MEASURES], "q_failed", "q_kept")
    w_, l_ = fresh(docs, "q__w"), fresh(docs, "q__l")
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, BLANK), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumn(w_, words).withColumn(l_, lines)
    w = F.col(w_)
    out = {
        "n_words": F.size(w),
        "word_chars": F.length(t) - _chars_of(t, " \t\n\x0b\x0c\r"),
        "n_symbols": _chars_of(t, "#*$%&|<>"),
        "n_lines": F.size(l_),
        "n_dup_lines": F.size(l_) - F.size(F.array_distinct(l_)),
        "n_repeat_words": _repeat_words(w),
        "n_bangs": _chars_of(t, "!"),
        "n_upper": F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")),
    }
    return df.withColumns({f"q_{k}": v.cast("long") for k, v in out.items()}).drop(w_, l_)


def ledger(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """``docs`` plus measurements (``q_*``) and ``q_failed`` (long, one bit a rule)."""
    m = measure(docs, text)
    bits = F.lit(0).cast("long")
    for r in rules:
        sql = re.sub(rf"\b({'|'.join(MEASURES)})\b", r"q_\1", r.fails)
        bits = bits.bitwiseOR(F.when(F.expr(sql), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return m.withColumn("q_failed", bits)


def mask(policy: str, rules=RULES, policies=None) -> int:
    names = (policies or POLICIES)[policy]
    return sum(1 << r.bit for r in rules if r.name in names)


def apply_policy(led: DataFrame, policy: str, rules=RULES, policies=None) -> DataFrame:
    """The ledger plus ``q_kept``: no rule that the policy enforces fails."""
    m = F.lit(mask(policy, rules, policies)).cast("long")
    return led.withColumn("q_kept", F.col("q_failed").bitwiseAND(m) == 0)


def kept(led: DataFrame, policy: str, rules=RULES, policies=None) -> DataFrame:
    """The rows the policy keeps.  The row number only stands in the filter's
    way: without it the optimizer copies every measurement into the filter."""
    row = fresh(led, "q__row")
    out = apply_policy(led.withColumn(row, F.monotonically_increasing_id()), policy, rules, policies)
    return out.where(F.col("q_kept") & (F.col(row) >= 0)).drop(row)


def ablations(led: DataFrame, policy: str, rules=RULES, policies=None) -> DataFrame:
    """Per enforced rule: documents failing it, failing it alone, and kept
    without it.  The ledger is first reduced to counts per failure mask (at
    most 2^rules rows, pre-aggregated), so the rest is tiny."""
    m = mask(policy, rules, policies)
    names = (policies or POLICIES)[policy]
    counts = (led.groupBy(F.col("q_failed").bitwiseAND(F.lit(m).cast("long")).alias("bits"))
              .agg(F.count(F.lit(1)).alias("n")))
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("b"))
                               for r in rules if r.name in names]))
    x = counts.select("bits", "n", each.alias("r")).select("bits", "n", "r.rule", "r.b")
    hit = F.col("bits").bitwiseAND(F.col("b")) != 0
    return x.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("b"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not("b")) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"))
