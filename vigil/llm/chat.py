"""Operator 4, chat formatting in budgeted windows (native expressions only).

A turn is written ``<|turn|>role\\ntext<|end|>\\n``.  Control strings inside
roles and texts are escaped reversibly: ``~`` becomes ``~0`` and the first
character of a control string ``~1`` (for ``<``) or ``~2`` (for ``[``); a
line feed in a role becomes ``~3``.

Prefix sums of the turns' tokens choose the windows.  With budget W, a system
turn of S tokens (the conversation's first turn, if its role is system) and
stride H = max(1, (W - S) // 2), turn i belongs to the window of
``start_i // H``: what starts in one stride has less than 2 * H tokens, unless
its last turn is longer than H; that turn opens a window of its own, which
alone can exceed the budget, because turns are never cut.  Every window
repeats the system turn and as many of the turns just before it as the
budget and ``history`` allow.  Only assistant turns in their own window are
targets; repeated ones are masked.

Defined results: a null text or role is empty; ties in ``turn`` are ordered by
role, then the text's first 64 code points, then its hash; a null turn comes first; a null conv_id is one conversation.
Repeated rows are turns of their own.  Extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, same, Stage

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
BUDGET, HISTORY = 1024, 256
TIE = 64                       # code points of a text that order ties, before its hash
#: Control strings of this and other public chat templates (fixed values).
CONTROLS = ("<|turn|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|startoftext|>", "<|endoftext|>", "<s>", "</s>",
            "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")


def escape(text: Column) -> Column:
    angle = "|".join(rf"\Q{c[1:]}\E" for c in CONTROLS if c[0] == "<")
    square = "|".join(rf"\Q{c[1:]}\E" for c in CONTROLS if c[0] == "[")
    t = F.replace(text, F.lit("~"), F.lit("~0"))
    t = F.regexp_replace(t, f"<(?={angle})", "~1")
    return F.regexp_replace(t, rf"\[(?={square})", "~2")


def unescape(text: Column) -> Column:
    for code, char in (("~3", "\n"), ("~2", "["), ("~1", "<"), ("~0", "~")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def count_tokens(text: Column) -> Column:
    """Words and signs, as a tokenizer's pre-tokens; never 0."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{M}]+|\p{N}|[^\s\p{L}\p{M}\p{N}]+"), F.lit(0))).cast("long")


def _placed(turns: DataFrame) -> DataFrame:
    """The turns with their escaped texts, ``seq`` (place in the conversation),
    ``system`` (tokens, if this is the system turn), ``sys`` (the same for the
    whole conversation) and ``upto`` (tokens of the turns up to this one, but
    for the system turn).

    All conversations are sorted as one and cut into ranges of even size, so a
    conversation with a third of all turns spreads over many tasks.  Numbers
    and sums run within (conversation, range); one row for each of these
    carries them on.  Only short keys are sorted; texts join by row."""
    stage = Stage(turns.sparkSession, "chat")
    role = F.replace(escape(F.coalesce(F.col("role"), F.lit(""))), F.lit("\n"), F.lit("~3"))
    body = escape(F.coalesce(F.col("text"), F.lit("")))
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                     F.coalesce("role", F.lit("")).alias("role"), role.alias("wrole"), body.alias("wtext"))
    t = t.withColumn("tokens", count_tokens(F.concat("wrole", F.lit(" "), "wtext")) + F.lit(4))
    t = stage.put(t.withColumn("row", F.monotonically_increasing_id()), "turns")
    key = ["turn", "role", "pre", "tie", "row"]
    slim = t.select("conv_id", "turn", "role", F.substring("wtext", 1, TIE).alias("pre"), F.xxhash64("wtext").alias("tie"), "row", "tokens")
    cut = slim.repartitionByRange("conv_id", *key).withColumn("chunk", F.spark_partition_id())
    cut = stage.put(cut, "ranges")
    order = Window.partitionBy("conv_id", "chunk").orderBy(*key)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = cut.select("conv_id", "chunk", "row", "role", "tokens", F.row_number().over(order).alias("i"), F.sum("tokens").over(upto).alias("sum"))
    x = stage.put(x, "local")
    lead = F.max(F.when((F.col("i") == 1) & (F.col("role") == "system"), F.col("tokens")))
    per = x.groupBy("conv_id", "chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("all"), lead.alias("lead"))
    chunks = Window.partitionBy("conv_id").orderBy("chunk")
    before = chunks.rowsBetween(Window.unboundedPreceding, -1)
    first = F.first("lead").over(chunks.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    carry = per.select(F.col("conv_id").alias("c_conv"), F.col("chunk").alias("c_chunk"), F.coalesce(first, F.lit(0)).alias("sys"),
                       F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("all").over(before), F.lit(0)).alias("sum0"))
    x = x.join(carry, same(F.col("conv_id"), F.col("c_conv")) & (F.col("chunk") == F.col("c_chunk")))
    seq = F.col("i") + F.col("n0")
    x = x.select("row", seq.alias("seq"), "sys", F.when(seq == 1, F.col("sys")).otherwise(F.lit(0)).alias("system"),
                 (F.col("sum") + F.col("sum0") - F.col("sys")).alias("upto"))
    return stage.put(t.join(x, "row").drop("row", "turn"), "placed")


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Rows (conv_id, window, text, n_repeated, spans, n_tokens): ``spans``
    are the (start, end) code points of the targets in ``text``; the first
    ``n_repeated`` turns of the window stand in it again."""
    prepare(turns.sparkSession)
    t = _placed(turns)
    is_sys = F.col("system") > 0
    t = t.withColumn("start", F.col("upto") - F.col("tokens") + F.col("system"))
    t = t.withColumn("stride", F.greatest(F.lit(1), F.floor((F.lit(budget) - F.col("sys")) / 2)).cast("long"))
    # window key: (stride number, 1 for a turn longer than the stride)
    t = t.withColumn("block", F.floor(F.col("start") / F.col("stride")).cast("long")).withColumn("long_", F.col("tokens") > F.col("stride"))
    t = t.withColumn("win", F.when(~is_sys, F.col("block") * 2 + F.col("long_").cast("long")))
    body_turns = t.where(~is_sys)
    win = body_turns.groupBy("conv_id", "win").agg(
        F.min("seq").alias("first"), F.min("start").alias("from"), F.max("upto").alias("to"), F.max("sys").alias("sys"),
        F.max("stride").alias("stride"))
    room = F.greatest(F.lit(0), F.least(F.lit(history), F.lit(budget) - F.col("sys") - (F.col("to") - F.col("from"))))
    win = win.withColumn("room", room.cast("long"))
    w = win.select(F.col("conv_id").alias("w_conv"), F.col("win").alias("w_win"), "first", "from", "room")
    own = body_turns.select("conv_id", "win", "seq", "wrole", "wtext", "tokens", (F.col("role") == "assistant").alias("target"), F.lit(0).alias("again"))
    # history: a window's ``room`` reaches back over few strides, so windows
    # and turns meet on (conversation, stride)
    h = w.where("room > 0").join(win.select(F.col("conv_id").alias("x_conv"), F.col("win").alias("x_win"), "stride"),
                                 same(F.col("w_conv"), F.col("x_conv")) & (F.col("w_win") == F.col("x_win"))).drop("x_conv", "x_win")
    h = h.withColumn("block", F.explode(F.expr("sequence(cast(floor(greatest(`from` - room, 0) / stride) as bigint), cast(floor(`from` / stride) as bigint))")))
    hist = h.join(body_turns.select("conv_id", F.col("block").alias("b_block"), "seq", "wrole", "wtext", "tokens", "start"),
                  same(F.col("w_conv"), F.col("conv_id")) & (F.col("block") == F.col("b_block"))
                  & (F.col("seq") < F.col("first")) & (F.col("start") >= F.col("from") - F.col("room")))
    hist = hist.select("conv_id", F.col("w_win").alias("win"), "seq", "wrole", "wtext", "tokens", F.lit(False).alias("target"), F.lit(1).alias("again"))
    # the system turn: new in the first window, repeated in the others
    s = t.where(is_sys).select(F.col("conv_id").alias("s_conv"), "seq", "wrole", "wtext", "tokens")
    heads = win.groupBy("conv_id").agg(F.min("first").alias("lead"))
    every = win.select("conv_id", "win", "first").join(heads.select(F.col("conv_id").alias("l_conv"), "lead"), same(F.col("conv_id"), F.col("l_conv")))
    sys_turns = every.join(s, same(F.col("conv_id"), F.col("s_conv"))).select(
        "conv_id", "win", "seq", "wrole", "wtext", "tokens", F.lit(False).alias("target"), (F.col("first") > F.col("lead")).cast("int").alias("again"))
    alone = t.where(is_sys).join(heads.select(F.col("conv_id").alias("l_conv")), same(F.col("conv_id"), F.col("l_conv")), "left_anti").select(
        "conv_id", F.lit(0).cast("long").alias("win"), "seq", "wrole", "wtext", "tokens", F.lit(False).alias("target"), F.lit(0).alias("again"))
    parts = own.unionByName(hist).unionByName(sys_turns).unionByName(alone)
    one = F.struct("seq", F.concat(F.lit(OPEN), "wrole", F.lit("\n")).alias("head"), "wtext", "target", "again", "tokens")
    g = parts.groupBy("conv_id", "win").agg(F.array_sort(F.collect_list(one)).alias("ts"))
    g = g.select("conv_id", "win", "ts", F.transform("ts", lambda x: F.concat(x["head"], x["wtext"], F.lit(CLOSE))).alias("pieces"))
    ends = F.aggregate("pieces", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x))))
    g = g.withColumn("ends", ends)
    span = F.transform("ts", lambda x, i: F.struct(x["target"].alias("target"), (F.get("ends", i) + F.length(x["head"])).alias("start"),
                                                   (F.get("ends", i + 1) - F.lit(len(CLOSE))).alias("end")))
    spans = F.transform(F.filter(span, lambda x: x["target"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return g.select("conv_id", F.col("win").alias("window"), F.array_join("pieces", "").alias("text"),
                    F.size(F.filter("ts", lambda x: x["again"] == 1)).alias("n_repeated"), spans.alias("spans"),
                    F.aggregate("ts", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("n_tokens"))


def read_back(wins: DataFrame) -> DataFrame:
    """Per conversation, from the windows' texts and spans alone: turns,
    targets and sizes."""
    segs = F.split("text", F.lit("\\Q" + CLOSE + "\\E"))
    new = F.slice(segs, F.col("n_repeated") + 1, F.size(segs) - 1 - F.col("n_repeated"))
    # a segment is OPEN role \n text; roles hold no line feed
    turn = F.transform(new, lambda x: F.concat(
        unescape(F.substring_index(F.substr(x, F.lit(len(OPEN) + 1)), "\n", 1)), F.lit("\n"),
        unescape(F.substr(x, F.instr(x, F.lit("\n")) + 1)), F.lit("\n")))
    loss = F.transform("spans", lambda s: unescape(F.substr(F.col("text"), s["start"] + 1, s["end"] - s["start"])))
    w = wins.select("conv_id", "window", F.size(new).cast("long").alias("n"), F.array_join(turn, "").alias("turns"),
                    F.array_join(loss, "").alias("loss"), F.length("text").cast("long").alias("chars"))
    g = w.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
                                 F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("ws"))
    turns, loss = (F.array_join(F.transform("ws", lambda x: x[c]), "") for c in ("turns", "loss"))
    return g.select("conv_id", "n_turns", F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
                    F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
