"""Ordered scans that stay balanced when one key holds most of the rows.

A plain ``Window.partitionBy(model).orderBy(time)`` sends every row of a
model to one task; with a handful of models that is a handful of tasks and a
hot model can hold a third of the data.  Every ordered computation in this
library therefore runs in two levels:

1. the ordered domain is cut into *chunks* (a time bucket, or an
   approximate-quantile slice of a value domain) and the window runs per
   ``(key, chunk)``, so a hot key spreads over many tasks;
2. a tiny per-``(key, chunk)`` summary is scanned per key (its size is
   keys x chunks, independent of row count) and joined back to carry the
   state across chunk borders.

The join back is left to AQE: it measures the summary at run time and
broadcasts it only when it is below the broadcast threshold, otherwise it
shuffles only the summary onto the partitioning the window already produced.
Results are exact; chunking only changes how work is spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in names]


def with_chunk(df: DataFrame, chunk: Column) -> DataFrame:
    return df.withColumn(CHUNK, chunk)


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 values: Sequence[str], prefix: str = "cum_",
                 inclusive: bool = True, totals_prefix: str | None = None) -> DataFrame:
    """Running sums of ``values`` per ``keys`` in ``order``.

    ``df`` must carry a ``_chunk`` column that is non-decreasing in ``order``
    within each key.  ``order`` must be a total order within a key.  With
    ``totals_prefix`` every row also gets the key's grand totals (taken from
    the small chunk summary, so no extra pass over the rows).
    """
    totals = df.groupBy(*keys, CHUNK).agg(*[F.sum(v).alias(v) for v in values])
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = totals.select(
        *keys, CHUNK,
        *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_off_{v}") for v in values],
        *([F.sum(v).over(whole).alias(f"{totals_prefix}{v}") for v in values] if totals_prefix else []))
    end = Window.currentRow if inclusive else -1
    within = Window.partitionBy(*keys, CHUNK).orderBy(*_cols(order)).rowsBetween(
        Window.unboundedPreceding, end)
    local = df.select("*", *[F.coalesce(F.sum(v).over(within), F.lit(0)).alias(f"_loc_{v}")
                             for v in values])
    out = local.join(offsets, [*keys, CHUNK], "left")
    return out.select(
        *[c for c in local.columns if not c.startswith("_loc_")],
        *[(F.col(f"_loc_{v}") + F.col(f"_off_{v}")).alias(f"{prefix}{v}") for v in values],
        *([F.col(f"{totals_prefix}{v}") for v in values] if totals_prefix else []))


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                out: str = "rn") -> DataFrame:
    """``ROW_NUMBER() OVER (PARTITION BY keys ORDER BY order)``, balanced."""
    one = "_one"
    res = running_sums(df.withColumn(one, F.lit(1)), keys, order, [one], prefix="_rn")
    return res.withColumnRenamed(f"_rn{one}", out).drop(one)


def last_non_null_before(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                         values: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """Per row: the last non-NULL value of each column strictly before it.

    Equals ``last(v) IGNORE NULLS OVER (PARTITION BY keys ORDER BY order
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)``.  The per-chunk
    summary is read off the chunk window itself (its last non-NULL value),
    so the rows are sorted once and the summary is a hash aggregate over
    rows already partitioned by (key, chunk).
    """
    within = Window.partitionBy(*keys, CHUNK).orderBy(*_cols(order))
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    whole = within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    local = df.select("*", *[F.last(v, ignorenulls=True).over(before).alias(f"_in_{v}") for v in values],
                      *[F.last(v, ignorenulls=True).over(whole).alias(f"_cl_{v}") for v in values])
    summary = local.groupBy(*keys, CHUNK).agg(*[F.first(f"_cl_{v}").alias(v) for v in values])
    prior = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(*keys, CHUNK, *[F.last(v, ignorenulls=True).over(prior).alias(f"_carry_{v}")
                                          for v in values])
    joined = local.join(carry, [*keys, CHUNK], "left")
    return joined.select(
        *df.columns,
        *[F.coalesce(F.col(f"_in_{v}"), F.col(f"_carry_{v}")).alias(f"{prefix}{v}") for v in values])


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
              values: Sequence[str], ties: Sequence[str] = (), chunk: str = "hour", within_seconds: int | None = None,
              strict: bool = False, prefix: str = "") -> DataFrame:
    """Every left row with the newest right row of its key at or before its time.

    Adds ``{prefix}{right_time}`` and ``{prefix}{value}`` columns, NULL where
    no right row qualifies.  ``strict`` takes rows before the time only;
    ``within_seconds`` ignores right rows older than that.  Of right rows with
    equal times the largest by ``ties`` counts.  NULL keys or times match
    nothing; every left row stays, repeated ones too.

    Both sides are merged in one order per (key, time chunk) and the last right
    row is carried across chunks by a per-chunk summary, so a hot key spreads
    over its chunks and no side is broadcast or paired with the other.
    """
    side, t, row, hit = "_side", "_t", "_row", "_hit"
    payload = F.struct(F.col(right_time).alias(f"{prefix}{right_time}"), *[F.col(v).alias(f"{prefix}{v}") for v in values])
    r = right.where(F.col(right_time).isNotNull())
    for k in keys:
        r = r.where(F.col(k).isNotNull())
    r = r.select(*keys, F.col(right_time).alias(t), F.lit(1 if strict else 0).alias(side), F.struct(*[F.col(c) for c in ties], payload.alias("_p")).alias(hit))
    whole_row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    lhs = left.select(*keys, F.col(left_time).alias(t), F.lit(0 if strict else 1).alias(side), whole_row.alias(row))
    both = with_chunk(lhs.unionByName(r, allowMissingColumns=True), F.date_trunc(chunk, t))
    if ties:
        # one right row per (key, time): the largest of its ties
        tied = r.groupBy(*keys, t, side).agg(F.max(hit).alias(hit))
        both = with_chunk(lhs.unionByName(tied, allowMissingColumns=True), F.date_trunc(chunk, t))
    order = Window.partitionBy(*keys, CHUNK).orderBy(F.col(t).asc_nulls_first(), side)
    seen = F.last(hit, ignorenulls=True)
    local = both.select(*keys, CHUNK, t, row, seen.over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_in"),
                        seen.over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_cl"))
    summary = local.groupBy(*keys, CHUNK).agg(F.first("_cl").alias("_cl"))
    prior = Window.partitionBy(*keys).orderBy(F.col(CHUNK).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(CHUNK).alias("_c"), F.last("_cl", ignorenulls=True).over(prior).alias("_carry"))
    cond = local[CHUNK].eqNullSafe(carry["_c"])
    for k in keys:
        cond = cond & local[k].eqNullSafe(carry[f"_k_{k}"])
    out = local.where(F.col(row).isNotNull()).join(carry, cond, "left").select(
        row, t, F.when(F.col(t).isNotNull(), F.coalesce("_in", "_carry")).getField("_p").alias("_p"))
    if within_seconds is not None:
        at = F.col("_p").getField(f"{prefix}{right_time}")
        fresh = F.unix_micros(F.col(t).cast("timestamp")) - F.unix_micros(at.cast("timestamp")) <= int(within_seconds) * 1_000_000
        out = out.withColumn("_p", F.when(fresh, F.col("_p")))
    names = [f"{prefix}{right_time}", *[f"{prefix}{v}" for v in values]]
    return out.select(*[F.col(row).getField(c).alias(c) for c in left.columns], *[F.col("_p").getField(n).alias(n) for n in names])


def rolling_means(df: DataFrame, keys: Sequence[str], time: str, value: str, span_seconds: int, step_seconds: int = 60,
                  chunk: str = "day", out: str = "rolling_mean") -> DataFrame:
    """Per key and step bucket that has rows: mean of ``value`` over the rows
    of the ``span_seconds`` before the bucket's start.

    Equals a RANGE frame of that length that ends just before the bucket.  A
    bucket's sum and count enter the running total at its start and leave it
    ``span_seconds`` later, so one balanced running sum answers every bucket.
    Sums are decimals, so what leaves is exactly what entered.
    """
    dec = "decimal(38,9)"
    b = df.select(*keys, F.window(time, f"{int(step_seconds)} seconds").getField("start").alias("bucket"),
                  F.col(value).cast("double").alias("_v"))
    b = b.groupBy(*keys, "bucket").agg(F.sum(F.col("_v").cast(dec)).cast(dec).alias("_s"), F.count("_v").alias("_n"))
    zero = F.lit(0).cast(dec)
    enter = b.select(*keys, "bucket", F.coalesce("_s", zero).alias("_s"), F.col("_n"), F.lit(1).alias("_own"))
    leave = enter.select(*keys, (F.col("bucket") + F.expr(f"INTERVAL {int(span_seconds)} SECONDS")).alias("bucket"),
                         (-F.col("_s")).alias("_s"), (-F.col("_n")).alias("_n"), F.lit(0).alias("_own"))
    net = enter.unionByName(leave).groupBy(*keys, "bucket").agg(F.sum("_s").cast(dec).alias("_s"), F.sum("_n").alias("_n"), F.max("_own").alias("_own"))
    run = running_sums(with_chunk(net, F.date_trunc(chunk, "bucket")), keys, ["bucket"], ["_s", "_n"], prefix="_cum", inclusive=False)
    mean = F.when(F.col("_cum_n") > 0, F.col("_cum_s").cast("double") / F.col("_cum_n"))
    return run.where(F.col("_own") == 1).select(*keys, "bucket", mean.alias(out))


def value_chunks(df: DataFrame, keys: Sequence[str], value: str, n_chunks: int = 64,
                 accuracy: int = 2000) -> DataFrame:
    """Attach an order-preserving ``_chunk`` to a value domain.

    Chunk borders are approximate quantiles of ``value`` per key (a bounded
    sketch per key), so a hot key is cut into ``n_chunks`` similar slices.
    Rows find their slice by an equi-join on the key plus a range condition
    against the (keys x n_chunks) interval table: code-generated, and AQE
    broadcasts the interval table when it measures it small, otherwise it
    uses a sort-merge join whose skewed partitions it splits.
    """
    probs = [i / n_chunks for i in range(1, n_chunks)]
    borders = df.groupBy(*keys).agg(F.percentile_approx(value, probs, accuracy).alias("_b"))
    lows = F.concat(F.array(F.lit(None).cast("double")), F.col("_b"))
    highs = F.concat(F.col("_b"), F.array(F.lit(None).cast("double")))
    iv = borders.select(*[F.col(k).alias(f"_k_{k}") for k in keys],
                        F.posexplode(F.arrays_zip(lows.alias("lo"), highs.alias("hi"))).alias(CHUNK, "_iv"))
    iv = iv.select(*[f"_k_{k}" for k in keys], CHUNK, F.col("_iv.lo").alias("_lo"), F.col("_iv.hi").alias("_hi"))
    cond = None
    for k in keys:
        c = df[k] == iv[f"_k_{k}"]
        cond = c if cond is None else cond & c
    # the outer slices have no outer border, so infinities and NaN have a slice too
    cond = cond & (iv["_lo"].isNull() | (df[value] > iv["_lo"])) & (iv["_hi"].isNull() | (df[value] <= iv["_hi"]))
    return df.join(iv, cond, "inner").drop(*[f"_k_{k}" for k in keys], "_lo", "_hi")


def rank_hits(dv: DataFrame, keys: Sequence[str], value: str, count: str, cum: str,
              targets: DataFrame) -> DataFrame:
    """Value at each requested 0-based rank: the row whose running-count
    range [cum - count, cum) holds it.  ``targets`` = (keys, _rank), small."""
    t = targets.select(*[F.col(k).alias(f"_t_{k}") for k in keys], "_rank")
    cond = None
    for k in keys:
        c = dv[k] == t[f"_t_{k}"]
        cond = c if cond is None else cond & c
    cond = cond & (t["_rank"] >= dv[cum] - dv[count]) & (t["_rank"] < dv[cum])
    return dv.where(F.col(count) > 0).join(t, cond, "inner").select(*keys, "_rank", F.col(value).alias("_val"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    probs: Sequence[float], n_chunks: int = 64) -> DataFrame:
    """Linear-interpolated quantiles (``percentile_cont``) per key, exactly.

    Works on distinct values with counts and running counts, so no group is
    ever materialised in one task.  Returns keys + ``q`` (array aligned with
    ``probs``) + ``n``.
    """
    dv = (df.where(F.col(value).isNotNull())
            .groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n")))
    scanned = running_sums(value_chunks(dv, keys, "_v", n_chunks), keys, ["_v"], ["_n"],
                           prefix="_cum", totals_prefix="_tot")
    return quantile_hits(scanned, keys, "_v", "_n", "_cum_n", "_tot_n", probs)


def quantile_hits(dv: DataFrame, keys: Sequence[str], value: str, count: str, cum: str,
                  total: str, probs: Sequence[float]) -> DataFrame:
    """Quantiles from a table that already carries, per distinct value, its
    inclusive running count ``cum`` and the key's ``total``.  Only the
    order statistics needed (at most 2 x len(probs) per key) are gathered."""
    p_arr = F.array(*[F.lit(float(p)) for p in probs])
    totals = dv.groupBy(*keys).agg(F.max(total).alias("_total"))
    pos = F.transform(p_arr, lambda p: (F.col("_total") - 1) * p)
    need = F.array_distinct(F.flatten(F.transform(
        pos, lambda r: F.array(F.floor(r).cast("long"), F.ceil(r).cast("long")))))
    targets = totals.select(*keys, F.explode(need).alias("_rank"))
    hit = rank_hits(dv, keys, value, count, cum, targets)
    at = hit.groupBy(*keys).agg(F.map_from_entries(F.collect_list(
        F.struct(F.col("_rank"), F.col("_val")))).alias("_at"))
    res = totals.join(at, list(keys), "left")

    def interp(r):
        lo = F.element_at("_at", F.floor(r).cast("long"))
        hi = F.element_at("_at", F.ceil(r).cast("long"))
        return lo + (r - F.floor(r)) * (hi - lo)

    return res.select(*keys, F.col("_total").alias("n"),
                      F.when(F.col("_total") > 0, F.transform(pos, interp)).alias("q"))
