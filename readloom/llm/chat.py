"""Budgeted chat windows, in DataFrame operations only.

Prefix sums of a conversation's turn tokens lay its turns on a line that is ruled into cells of new_tokens. Turns that lie
within a cell form a window; a turn that crosses a cell's edge forms a window of its own. So windows are turn-aligned and
hold at most new_tokens of new turns, unless a single turn is longer. Each window begins with the conversation's system
turn and with as many whole earlier turns as fit history_tokens; these repeats are outside the loss mask.

The sums are taken in blocks of turns and then over blocks, so no conversation is ordered as a whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

NEW_TOKENS = 1024
HISTORY_TOKENS = 256
BLOCK_TURNS = 256
TURN_OVERHEAD = 4  # tokens counted for a turn's markers
CHARS_PER_TOKEN = 4

END = "</turn>\n"


def estimated_tokens(text: Column) -> Column:
    """A fixed estimate of a turn's tokens, markers included."""
    return (F.ceil(F.length(text) / CHARS_PER_TOKEN) + TURN_OVERHEAD).cast("long")


def escape(text: Column) -> Column:
    """No marker can occur in the result: backslashes are doubled, then one is put into each ## and </turn>."""
    for plain, safe in (("\\", "\\\\"), ("##", "#\\#"), ("</turn>", "<\\/turn>")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _header(role: Column) -> Column:
    return F.concat(F.lit("### "), F.replace(escape(role), F.lit(":"), F.lit("\\:")), F.lit(": "))


def turn_windows(turns: DataFrame, new_tokens: int = NEW_TOKENS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """turns: conv_id, turn, role, text. One row for each window: conv_id, window_start (tokens of the conversation before
    it), n_context (repeated turns at its head), n_turns, n_tokens, formatted, and loss (start and length of each span of
    formatted under the loss mask, in code points).

    Null roles and texts count as empty, null turns come first, rows of the same turn are ordered by role and text and
    repeated rows stay. Rows without conv_id form a conversation of their own. Other columns are ignored.
    """
    if history_tokens > new_tokens:
        raise ValueError("history_tokens must not be above new_tokens")
    rows = turns.select(
        F.col("conv_id").isNull().alias("no_id"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"),
        F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(1 << 60))).cast("long").alias("block"), "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("n", estimated_tokens(F.col("text")))
    key = ["no_id", "conv"]
    inside = Window.partitionBy(*key, "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    over = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    bases = rows.groupBy(*key, "block").agg(F.sum("n").alias("total")).select(*key, "block", (F.sum("total").over(over) - F.col("total")).alias("base"))
    placed = rows.withColumn("after", F.sum("n").over(inside)).join(bases, [*key, "block"])
    after = F.col("after") + F.col("base")
    placed = placed.select(*key, "role", "text", "n", (after - F.col("n")).alias("before"), after.alias("after"))
    cell = F.floor(F.col("before") / new_tokens)
    placed = placed.withColumns({"cell": cell, "across": F.floor((F.col("after") - 1) / new_tokens) > cell, "head": (F.col("before") == 0) & (F.col("role") == "system")})

    window = [*key, "cell", "across"]
    member = F.struct("kind", "before", "role", "text", "n").alias("member")
    new = placed.withColumn("kind", F.lit(2))
    spans = placed.groupBy(*window).agg(F.min("before").alias("start"))
    reach = F.sequence(F.floor(F.col("after") / new_tokens), F.floor((F.col("before") + history_tokens) / new_tokens))
    history = placed.filter((F.col("n") <= history_tokens) & ~F.col("head")).drop("cell", "across").withColumn("cell", F.explode(reach)).join(spans, [*key, "cell"])
    history = history.filter((F.col("after") <= F.col("start")) & (F.col("before") + history_tokens >= F.col("start"))).withColumn("kind", F.lit(1))
    system = placed.filter("head").drop("cell", "across").join(spans, key).filter("start > 0").withColumn("kind", F.lit(0))
    parts = new.select(*window, member).unionAll(history.select(*window, member)).unionAll(system.select(*window, member))

    shown = F.transform("turns", lambda t: F.struct(_header(t["role"]).alias("header"), escape(t["text"]).alias("text"), ((t["kind"] == 2) & (t["role"] == "assistant")).alias("loss")))
    pieces = F.array_join(F.transform("shown", lambda t: F.concat(t["header"], t["text"], F.lit(END))), "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(a: Column, t: Column) -> Column:
        begin = a["at"] + F.length(t["header"])
        span = F.struct(begin.alias("start"), F.length(t["text"]).alias("length"))
        return F.struct((begin + F.length(t["text"]) + len(END)).alias("at"), F.when(t["loss"], F.array_append(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    done = parts.groupBy(*window).agg(F.sort_array(F.collect_list("member")).alias("turns")).withColumn("shown", shown)
    return done.select(
        F.when(~F.col("no_id"), F.col("conv")).alias("conv_id"), F.array_min(F.transform(F.filter("turns", lambda t: t["kind"] == 2), lambda t: t["before"])).alias("window_start"),
        F.size(F.filter("turns", lambda t: t["kind"] < 2)).alias("n_context"), F.size("turns").alias("n_turns"), F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["n"]).alias("n_tokens"),
        pieces.alias("formatted"), F.aggregate("shown", start, step, lambda a: a["spans"]).alias("loss"),
    )


def parsed_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted window, unescaped."""
    ended = F.split(formatted, END)
    header = r"(?s)^### ([^\\:]*+(?:\\.[^\\:]*+)*+): "

    def turn(t: Column) -> Column:
        role = F.regexp_extract(t, header, 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(t, F.length(role) + 7, F.length(t))).alias("text"))

    return F.transform(F.slice(ended, 1, F.size(ended) - 1), turn)


def masked_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")
