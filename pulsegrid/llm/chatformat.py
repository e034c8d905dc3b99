"""Chat formatting in budgeted windows: prefix sums of turn tokens choose turn-aligned spans; history repeats under a mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Tokens of a window, of them at most HISTORY for turns repeated from before it; what the marks of a turn count for.
BUDGET, HISTORY, MARKS = 1024, 128, 4
#: Turns that one task sums up at once; the sums of such blocks are summed up after.
BLOCK_TURNS = 4096


def escape(text: Column) -> Column:
    """``<`` and ``|`` never meet in the result: each ``<\\\\..|`` gets one backslash more, so that the marks are the template's alone."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def _role_in(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def count_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, r"\s+"), ""))


def chat_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Formats conversations into windows of about ``budget`` tokens (words and marks).

    Each turn is new in exactly one window: that of the multiple of half the room at which its tokens begin; a turn longer than that
    is a window alone and never cut. Every window repeats the system turn that opens the conversation, and whole
    turns from the last ``history`` tokens before it; only assistant turns that are new there are under the loss mask.
    A row per window: conv_col, major, minor (their order), text, n_tokens, new_from (code points repeated before the new turns
    begin; the opening system turn is new in the first window), n_new, loss (array of start, length in code points).
    Null roles and texts are empty; turns with one number go by role and text, null numbers last; a null id is a conversation.
    """
    t = turns.select(
        F.struct(F.col(conv_col).alias("id")).alias("c"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")
    )
    t = t.withColumn("tokens", (count_words(F.col("text")) + MARKS).cast("bigint")).withColumn("block", F.floor(F.coalesce(F.col("turn").cast("double"), F.lit(1e15)) / BLOCK_TURNS))
    inside = Window.partitionBy("c", "block").orderBy(F.asc_nulls_last("turn"), "role", "text")
    t = t.withColumn("at", F.row_number().over(inside).cast("bigint"))
    blocks = t.groupBy("c", "block").agg(F.count("*").alias("n"))
    order = Window.partitionBy("c").orderBy("block")
    blocks = blocks.select("c", "block", (F.sum("n").over(order) - F.col("n")).alias("ahead"), F.sum("n").over(Window.partitionBy("c")).alias("turns"))
    t = t.join(blocks, ["c", "block"]).withColumn("at", F.col("at") + F.col("ahead") - 1).drop("ahead")

    opening = (F.col("at") == 0) & (F.col("role") == "system") & (F.col("turns") > 1)
    piece = F.concat(F.lit(OPEN), _role_in(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(CLOSE))
    t = t.withColumn("piece", piece).withColumn("skip", F.char_length(_role_in(F.col("role"))) + len(OPEN) + 1)
    head = t.where(opening).select("c", F.col("tokens").alias("head_tokens"), F.col("piece").alias("head"))
    body = t.where(~opening).join(head.select("c", "head_tokens"), "c", "left")
    half = F.greatest(F.lit(1), F.floor((budget - history - F.coalesce("head_tokens", F.lit(0))) / 2))
    body = body.withColumn("half", half).withColumn("long", (F.col("tokens") > F.col("half")).cast("bigint"))
    within = Window.partitionBy("c", "block").orderBy("at")
    body = body.withColumn("cum", F.sum("tokens").over(within) - F.col("tokens")).withColumn("longs", F.sum("long").over(within) - F.col("long"))
    sums = body.groupBy("c", "block").agg(F.sum("tokens").alias("a"), F.sum("long").alias("b"))
    sums = sums.select("c", "block", (F.sum("a").over(order) - F.col("a")).alias("a"), (F.sum("b").over(order) - F.col("b")).alias("b"))
    body = body.join(sums, ["c", "block"]).withColumn("cum", F.col("cum") + F.col("a"))
    body = body.withColumn("major", 2 * (F.col("longs") + F.col("b")) + F.col("long")).withColumn("minor", F.floor(F.col("cum") / F.col("half")))

    windows = body.groupBy("c", "major", "minor").agg(F.min("at").alias("first"), F.min("cum").alias("begins"))
    new = body.select("c", "major", "minor", "at", "role", "piece", "skip", "tokens", F.lit(False).alias("again"))
    # A turn may be history of the windows that begin within ``history`` tokens of its start: those of one cell of half a room, or two.
    reach = F.least(F.lit(history), F.col("half"))
    past = body.where(F.col("tokens") <= reach).withColumn("upto", F.col("cum") + reach)
    past = past.withColumn("cell", F.explode(F.sequence(F.floor((F.col("cum") + F.col("tokens")) / F.col("half")), F.floor(F.col("upto") / F.col("half")))))
    later = windows.select("c", F.col("minor").alias("cell"), "major", "minor", "first", "begins")
    past = past.drop("major", "minor").join(later, ["c", "cell"]).where("first > at and begins <= upto")
    past = past.select("c", "major", "minor", "at", "role", "piece", "skip", "tokens", F.lit(True).alias("again"))
    opened = windows.withColumn("start", F.min("first").over(Window.partitionBy("c"))).join(head, "c")
    opened = opened.select("c", "major", "minor", F.lit(-1).cast("bigint").alias("at"), F.lit("system").alias("role"), F.col("head").alias("piece"), F.lit(len(OPEN) + 7).alias("skip"), F.col("head_tokens").alias("tokens"), (F.col("first") != F.col("start")).alias("again"))
    parts = new.unionByName(past).unionByName(opened)

    line = Window.partitionBy("c", "major", "minor").orderBy("at")
    size = F.char_length("piece")
    parts = parts.withColumn("from", F.sum(size).over(line) - size)
    loss = F.when(~F.col("again") & (F.col("role") == "assistant"), F.struct((F.col("from") + F.col("skip")).alias("start"), (size - F.col("skip") - len(CLOSE)).alias("length")))
    made = parts.groupBy("c", "major", "minor").agg(
        F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("pieces"), F.sum("tokens").alias("n_tokens"), F.min(F.when(~F.col("again"), F.col("from"))).alias("new_from"),
        F.count_if(~F.col("again")).alias("n_new"), F.array_sort(F.collect_list(loss)).alias("loss"),
    )
    return made.select(F.col("c.id").alias(conv_col), "major", "minor", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("text"), "n_tokens", "new_from", "n_new", "loss")


def read_windows(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Reads windows back: conv_col, major, minor, turns (array of role, text; new ones only), losses (texts under the mask, unescaped)."""
    new = F.substring(F.col("text"), F.col("new_from") + 1, F.char_length("text"))
    blocks = F.filter(F.split(new, r"<\|im_end\|>\n"), lambda b: b != "")
    body = lambda b: F.substring(b, F.lit(len(OPEN) + 1), F.char_length(b))

    def turn(block: Column) -> Column:
        inner = body(block)
        role = F.substring_index(inner, "\n", 1)
        return F.struct(_role_out(role).alias("role"), unescape(F.substring(inner, F.char_length(role) + 2, F.char_length(inner))).alias("text"))

    losses = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return windows.select(conv_col, "major", "minor", F.transform(blocks, turn).alias("turns"), losses.alias("losses"), F.char_length("text").alias("chars"))
