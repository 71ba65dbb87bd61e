"""Operator 1, mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, language, source) triples found in the data.  A token
budget goes down the tree: children share their parent's budget by weight,
no child gets more than its subtree can give (available tokens times
``max_epochs``), and what a short child cannot take goes to its siblings;
only what all siblings cannot take reaches the parent's siblings, because a
parent's own share is bounded by its subtree.  The filling is exact integer
arithmetic over the leaf table (one row a leaf), by prefix sums in order of
capacity per weight.

A leaf with budget B and A available tokens takes ``B // A`` whole epochs and
the prefix of one more, in the seeded order of that epoch (md5 of seed, epoch
and doc_id), up to the document that reaches the rest.  The cut is found
without ordering a whole leaf: tokens are summed by hash bucket, and only the
one bucket that holds the cut is ordered.

Defined results: null domain, language or source is a leaf of its own; a null
or empty text has 0 tokens; rows equal in doc_id rank alike and are taken or
left together.  Shares are rounded down.  Nodes without a listed weight have
``default_weight``; weight 0 takes nothing.  An empty table gives no rows.
Extra columns pass through, whatever their names; the taken epoch is added as
``mx_epoch``, and a column of that name raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stage, free_of, packed, prepare, same
from .quality import BLANK

LEVELS = ("mx_l0", "mx_l1", "mx_l2")
BUCKET_ROWS = 4096
DEC = "decimal(38,0)"

#: The registered query and the pipeline use these.
WEIGHTS = {("d0",): 4, ("d1",): 3, ("d2",): 2, ("d3",): 1}
LANG_WEIGHTS = {"en": 6, "de": 2, "fr": 1, "es": 1}
SEED, SHARE, EPOCHS = 7, (1, 1), 2


def domain_of(source: str = "source") -> Column:
    """The stand-in for a domain column: the source's number modulo 4."""
    n = F.regexp_extract(source, r"([0-9]+)$", 1).try_cast("int") % 4
    return F.coalesce(F.concat(F.lit("d"), n.cast("string")), F.lit("none"))


def count_tokens(text: str = "text") -> Column:
    return F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), BLANK), lambda w: w != "")).cast("long")


def weight_table(spark: SparkSession, weights: dict[tuple, int]) -> DataFrame:
    """(depth, l0, l1, l2, weight) rows of the listed nodes; None in a path
    stands for any parent, e.g. (None, "en")."""
    rows = [(len(p), *p, *[None] * (3 - len(p)), int(w)) for p, w in weights.items()]
    return spark.createDataFrame(rows, "depth int, w0 string, w1 string, w2 string, weight long")


def _weighted(nodes: DataFrame, depth: int, table: DataFrame, default: int) -> DataFrame:
    """Nodes of one depth with their weight: listed exactly, else for any
    parent, else the default."""
    t = table.where(F.col("depth") == depth)
    last = f"w{depth - 1}"
    exact = t if depth == 1 else t.where(F.col("w0").isNotNull())
    cond = None
    for i in range(depth):
        c = same(F.col(LEVELS[i]), F.col(f"w{i}"))
        cond = c if cond is None else cond & c
    nodes = nodes.join(exact.withColumnRenamed("weight", "w_exact"), cond, "left").drop("depth", "w0", "w1", "w2")
    if depth > 1:
        anyp = t.where(F.col("w0").isNull()).select(F.col(last).alias("w_last"), F.col("weight").alias("w_any"))
        nodes = nodes.join(anyp, same(F.col(LEVELS[depth - 1]), F.col("w_last")), "left").drop("w_last")
    else:
        nodes = nodes.withColumn("w_any", F.lit(None).cast("long"))
    return nodes.withColumn("w", F.coalesce("w_exact", "w_any", F.lit(default)).cast(DEC)).drop("w_exact", "w_any")


def _fill(nodes: DataFrame, parent: list[str], me: list[str]) -> DataFrame:
    """Share ``b`` (the parent's budget) among siblings: adds ``budget``."""
    key = [*parent] or [F.lit(0)]
    by = Window.partitionBy(*key).orderBy((F.col("w") == 0), (F.col("cap").cast("decimal(38,9)") / F.col("w")), *[F.col(c).asc_nulls_first() for c in me])
    upto = by.rowsBetween(Window.unboundedPreceding, -1)
    rest = by.rowsBetween(0, Window.unboundedFollowing)
    zero = F.lit(0).cast(DEC)
    x = (nodes.withColumn("before", F.coalesce(F.sum("cap").over(upto), zero).cast(DEC))
         .withColumn("w_left", F.sum("w").over(rest).cast(DEC)))
    x = x.withColumn("full", (F.col("w") > 0) & (F.col("cap") * F.col("w_left") <= F.col("w") * (F.col("b") - F.col("before"))))
    every = Window.partitionBy(*key)
    x = (x.withColumn("b_open", F.col("b") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), zero))
         .withColumn("w_open", F.sum(F.when(F.col("full"), zero).otherwise(F.col("w"))).over(every)))
    share = F.when(F.col("w") == 0, zero).otherwise(F.expr("(w * b_open) div nullif(w_open, 0)"))
    return x.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(share).cast(DEC)).drop(
        "before", "w_left", "full", "b_open", "w_open")


def leaf_budgets(leaves: DataFrame, table: DataFrame, budget: Column, max_epochs: int, default_weight: int = 1) -> DataFrame:
    """Leaves (levels, ``avail`` tokens) with their ``budget``.  ``budget`` is an
    expression over ``total``, the tokens of all leaves."""
    cap = leaves.withColumn("cap", (F.col("avail") * max_epochs).cast(DEC))
    out = None
    for d in range(1, 4):
        me, up = list(LEVELS[:d]), list(LEVELS[:d - 1])
        nodes = cap.groupBy(*me).agg(F.sum("cap").cast(DEC).alias("cap"))
        nodes = _weighted(nodes, d, table, default_weight)
        if out is None:
            total = cap.agg(F.coalesce(F.sum("avail"), F.lit(0)).alias("total")).select(budget.cast(DEC).alias("b"))
            nodes = nodes.crossJoin(F.broadcast(total))          # one row
        else:
            p = out.select(*[F.col(c).alias(f"p_{c}") for c in up], F.col("budget").alias("b"))
            cond = None
            for c in up:
                e = same(F.col(c), F.col(f"p_{c}"))
                cond = e if cond is None else cond & e
            nodes = nodes.join(p, cond).drop(*[f"p_{c}" for c in up])
        out = _fill(nodes, up, [me[-1]]).select(*me, "cap", "budget")
    return out


def _rank(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("mx_id").cast("string"), F.lit(""))))


def mix(docs: DataFrame, levels: tuple[Column, Column, Column], weights: dict[tuple, int], share: tuple[int, int] = SHARE,
        max_epochs: int = EPOCHS, seed: int = SEED, tokens: Column | None = None, default_weight: int = 1) -> DataFrame:
    """``docs`` sampled to the weights; rows taken in several epochs repeat.
    The budget is ``share`` (a fraction) of all available tokens."""
    spark = docs.sparkSession
    prepare(spark)
    stage = Stage(spark, "mixing")
    free_of(docs, "mx_epoch")
    named = [*[c.cast("string").alias(n) for n, c in zip(LEVELS, levels)], F.col("doc_id").alias("mx_id")]
    sized = docs.select(packed(docs), *named)
    narrow = stage.put(docs.select(*named, (tokens if tokens is not None else count_tokens()).alias("tokens")), "sizes")
    leaves = narrow.groupBy(*LEVELS).agg(F.sum("tokens").alias("avail"), F.count(F.lit(1)).alias("n_docs"))
    leaves = stage.put(leaves, "leaves")
    b = F.expr(f"cast(total as {DEC}) * {int(share[0])} div {int(share[1])}")
    plan = leaf_budgets(leaves, weight_table(spark, weights), b, max_epochs, default_weight)
    a = leaves.select(*[F.col(c).alias(f"a_{c}") for c in LEVELS], "avail", "n_docs")
    plan = plan.join(a, _levels_match("a_")).drop(*[f"a_{c}" for c in LEVELS]).where("avail > 0")
    plan = plan.select(*LEVELS, F.floor(F.col("budget") / F.col("avail")).cast("long").alias("epochs"), "avail", "budget",
                       F.ceil(F.col("n_docs") / BUCKET_ROWS).cast("long").alias("buckets"))
    plan = stage.put(plan.withColumn("rest", (F.col("budget") - F.col("epochs") * F.col("avail")).cast("long")), "plan")

    # the cut of the last, partial epoch
    p = plan.select(*[F.col(c).alias(f"p_{c}") for c in LEVELS], "epochs", "rest", "buckets").where("rest > 0")
    ranked = narrow.join(p, _levels_match("p_")).drop(*[f"p_{c}" for c in LEVELS]).withColumn("rank", _rank(seed, F.col("epochs")))
    ranked = ranked.withColumn("bucket", F.floor(F.conv(F.substring("rank", 1, 8), 16, 10).cast("long") * F.col("buckets") / F.lit(2 ** 32)))
    sums = ranked.groupBy(*LEVELS, "bucket").agg(F.sum("tokens").alias("t"))
    run = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.sum("t").over(run)).withColumn("before", F.col("upto") - F.col("t"))
    s = sums.select(*[F.col(c).alias(f"s_{c}") for c in LEVELS], F.col("bucket").alias("s_bucket"), "before", "upto")
    edge = ranked.join(s, _levels_match("s_") & (F.col("bucket") == F.col("s_bucket"))).where("before < rest and rest <= upto")
    each = edge.groupBy(*LEVELS, "rank", "rest", "before").agg(F.sum("tokens").alias("t"))
    order = Window.partitionBy(*LEVELS).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("start", F.col("before") + F.sum("t").over(order) - F.col("t")).where("start < rest")
    cuts = each.groupBy(*[F.col(c).alias(f"c_{c}") for c in LEVELS]).agg(F.max("rank").alias("cut"))
    cut = stage.put(plan.select(*[F.col(c).alias(f"p_{c}") for c in LEVELS], "epochs").join(
        cuts, _levels_match("c_", "p_"), "left").drop(*[f"c_{c}" for c in LEVELS]), "cuts")

    taken = sized.join(cut, _levels_match("p_"))
    last = F.col("epochs") - F.when(_rank(seed, F.col("epochs")) <= F.col("cut"), 0).otherwise(1)
    taken = taken.withColumn("mx_last", last).where("mx_last >= 0")
    return taken.select("row.*", F.explode(F.expr("sequence(0L, mx_last)")).alias("mx_epoch"))


def _levels_match(prefix: str, mine: str = ""):
    cond = None
    for c in LEVELS:
        e = same(F.col(f"{mine}{c}"), F.col(f"{prefix}{c}"))
        cond = e if cond is None else cond & e
    return cond


def standard_mix(docs: DataFrame) -> DataFrame:
    """The registered mixture: domain by source number, then lang, source."""
    weights = {**WEIGHTS, **{(None, lang): w for lang, w in LANG_WEIGHTS.items()}}
    return mix(docs, (domain_of(), F.col("lang"), F.col("source")), weights)
