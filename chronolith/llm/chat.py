"""Chat formatting into budgeted windows, with DataFrame expressions only.

Prefix sums of turn tokens cut a conversation into windows of whole turns.  Each window repeats the system turn and as much
of a limited history of turns before its span as the budget leaves room for; only assistant turns of the span itself are
targets, so a target that is repeated as history is masked.  Texts are escaped, so control strings appear only where the
template puts them.

Turns are sorted once by range over all conversations and written.  Their places in that order give numbers and prefix sums by
counts of parts, so a long conversation is spread over tasks, whatever its turn numbers are; after that only a cell, which
holds a budget of turns, is gathered.  All of this goes without the texts, which meet their windows in one join by place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.llm.common import checkpointed

#: Control strings of the template, and the escapes that keep them out of texts.
OPEN, MIDDLE, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


#: The tokenizer that the budget counts by: words and numbers cut into runs, other signs, white space; and a turn's markers.
TOKEN = r" ?\p{L}{1,8}| ?\p{N}{1,3}| ?[^\x09-\x0D\x20\p{L}\p{N}]{1,3}|[\x09-\x0D\x20]{1,8}"
MARK_TOKENS = 4
#: Characters of a text by which turns of one number and role are dealt; those that agree in them are sorted in one task.
DEALT_CHARS = 256


def turn_tokens(text: Column) -> Column:
    """Tokens of a turn: matches of ``TOKEN`` in its text, and ``MARK_TOKENS``."""
    return (F.regexp_count(text, F.lit(TOKEN)) + MARK_TOKENS).cast("long")


def sorted_turns(turns: DataFrame, partitions: int | None = None) -> DataFrame:
    """(conv, at, role, text, tokens), written: ``at`` rises along each conversation, by one within a partition (``at`` >> 33).

    Sorted by (conv_id, turn, role, text), nulls first.  Parts are cut at rows, so a conversation of any length, and turns of
    one or no number, are spread.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    keys = ["conv_id", "turn", "role", F.substring("text", 1, DEALT_CHARS)]
    dealt = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    placed = dealt.sortWithinPartitions("conv_id", "turn", "role", "text").withColumn("at", F.monotonically_increasing_id())
    return checkpointed(placed.select(F.struct("conv_id").alias("conv"), "at", "role", "text", turn_tokens(F.col("text")).alias("tokens")))


def _cells(turns: DataFrame, budget: int) -> DataFrame:
    """(conv, at, number, tokens, is_head, head_at, room, before, window, last) of :func:`sorted_turns`, without texts.

    window: the number of the first turn of its span; last: where the span ends, in tokens.
    """
    light = turns.select("conv", "at", "tokens", F.shiftright("at", 33).alias("part"))
    parts = light.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("sum"))
    along = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv", "part", "first", *[F.coalesce(F.sum(c).over(along), F.lit(0)).alias(f"base_{c}") for c in ("n", "sum")])
    openings = parts.where("base_n = 0").select("conv", F.col("first").alias("head_at"))
    # a conversation's first turn, if it is a system turn that leaves room
    heads = turns.where((F.col("role") == "system") & (F.col("tokens") <= budget // 2)).select(F.col("at").alias("head_at"), F.col("tokens").alias("head_tokens"))
    parts = parts.join(openings.join(heads, "head_at"), "conv", "left")
    within = Window.partitionBy("conv", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = light.join(parts, ["conv", "part"], "left").withColumn("is_head", F.col("head_at").isNotNull() & (F.col("at") == F.col("head_at")))
    cost = F.when(F.col("is_head"), F.lit(0)).otherwise(F.col("tokens"))
    base = F.when(F.col("base_n") > 0, F.col("base_sum") - F.coalesce("head_tokens", F.lit(0))).otherwise(0)
    rows = rows.select("conv", "at", (F.col("base_n") + F.col("at") - F.col("first") + 1).alias("number"), "tokens", "is_head", "head_at", (budget - F.coalesce("head_tokens", F.lit(0))).alias("room"), cost.alias("cost"), (base + F.coalesce(F.sum(cost).over(within), F.lit(0))).alias("before"))
    rows = rows.withColumn("after", F.col("before") + F.col("cost")).withColumn("cell", F.floor(F.col("before") / F.col("room")))
    crosses = F.col("after") > (F.col("cell") + 1) * F.col("room")
    start = F.min(F.when(~crosses, F.col("before"))).over(Window.partitionBy("conv", "cell"))
    rows = rows.withColumn("own", crosses & ~F.coalesce(F.col("after") - start <= F.col("room"), F.lit(False)))
    span = Window.partitionBy("conv", "cell", "own")
    return rows.withColumn("window", F.min("number").over(span)).withColumn("last", F.max("after").over(span)).drop("cost", "after", "cell", "own")


def format_windows(turns: DataFrame, budget: int = 1024, history: int = 2, partitions: int | None = None) -> DataFrame:
    """One row per window: conv_id, window (the number of its first own turn), text, spans.

    ``turns``: conv_id, turn (whole numbers), role, text; ordered by turn (null first), ties by role, then text; null roles
    and texts count as empty; other columns are ignored.  A window holds the conversation's first turn if its role is
    system, up to ``history`` turns before its span, and its span, and no more than ``budget`` tokens; the history gives
    way first.  Over the budget is only a turn that does not fit beside the system turn: it is its window's only own turn.
    A system turn of more than half the budget is not repeated but stands in a span like any other.  With the room that
    the system turn leaves, prefix sums cut a conversation into cells of one room: turns within a cell are a span, and a turn
    that crosses a cell's end joins them if it fits, else it is a span of its own.  What turn numbers are makes no difference, only
    their order.

    spans: one struct for each turn in the window's text, with number (from 1 in the conversation), role, start and length
    of its escaped text (in characters, from 0), tokens, fresh (of this window's span) and loss (an assistant turn of the
    span).  A null conv_id is a conversation of its own; an empty table gives no windows.  The turns of one window, so at
    most a budget of them or one turn, are gathered together.
    """
    rows = sorted_turns(turns, partitions)
    cells = checkpointed(_cells(rows, budget))
    spans = cells.where("number = window").select("conv", F.col("window").alias("placed"), "head_at", F.col("last").alias("until"))
    own = cells.select("conv", "at", "number", F.col("window").alias("placed"), F.lit(True).alias("fresh"))
    parts = [own, spans.where("placed > 1 AND head_at IS NOT NULL").select("conv", F.col("head_at").alias("at"), F.lit(1).cast("long").alias("number"), "placed", F.lit(False).alias("fresh"))]
    if history:
        # the turns before a span, as far as it leaves room for them
        asked = spans.select("conv", "placed", "until", F.explode(F.sequence(F.lit(1), F.lit(history))).alias("k")).withColumn("number", F.col("placed") - F.col("k"))
        fits = ~F.col("is_head") & (F.col("until") - F.col("before") <= F.col("room"))
        parts.append(cells.join(asked, ["conv", "number"]).where(fits).select("conv", "at", "number", "placed", F.lit(False).alias("fresh")))
    places = reduce(DataFrame.unionByName, parts)
    body = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE), escape(F.col("text")), F.lit(CLOSE))
    turn = F.struct(F.col("number").cast("long").alias("number"), "role", "tokens", "fresh", F.length(escape(F.col("role"))).alias("role_chars"), body.alias("body"))
    placed = places.join(rows.drop("conv"), "at").select("conv.conv_id", F.col("placed").alias("window"), turn.alias("turn"))
    grouped = placed.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    # start of each turn: the lengths of those before it
    starts = F.aggregate("turns", F.array(F.lit(0)), lambda s, t: F.concat(s, F.array(F.element_at(s, -1) + F.length(t["body"]))))
    grouped = grouped.withColumn("starts", starts)

    def span_of(turn: Column, n: Column) -> Column:
        start = F.get("starts", n) + len(OPEN) + len(MIDDLE) + turn["role_chars"]
        return F.struct(
            turn["number"].alias("number"), turn["role"].alias("role"), start.alias("start"), (F.get("starts", n + 1) - len(CLOSE) - start).alias("length"),
            turn["tokens"].alias("tokens"), turn["fresh"].alias("fresh"), (turn["fresh"] & (turn["role"] == "assistant")).alias("loss"),
        )

    return grouped.select("conv_id", "window", F.array_join(F.transform("turns", lambda t: t["body"]), "").alias("text"), F.transform("turns", span_of).alias("spans"))


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, number, role, text, loss): the turns, from the windows' text; each once, from the window whose span has it."""
    parts = F.split(F.col("text"), "<\\|(?:turn|text|end)\\|>")
    rows = windows.select("conv_id", "window", "spans", parts.alias("parts"), F.col("text").alias("whole"))
    each = rows.select("conv_id", "parts", "whole", F.posexplode("spans").alias("n", "span")).where("span.fresh")
    masked = F.substring(F.col("whole"), F.col("span.start") + 1, F.col("span.length"))
    return each.select(
        "conv_id",
        F.col("span.number").alias("number"),
        unescape(F.get("parts", F.col("n") * 3 + 1)).alias("role"),
        unescape(F.get("parts", F.col("n") * 3 + 2)).alias("text"),
        F.when(F.col("span.loss"), unescape(masked)).alias("loss"),
    )


def digests(windows: DataFrame) -> DataFrame:
    """One row per conversation: what :func:`read_back` finds in its windows, and the characters of all their texts.

    A digest needs its conversation's turns in one row, so a conversation may hold 2 GB of text at most.
    """
    turns = read_back(windows).withColumn("key", F.struct(F.col("conv_id")))
    line = F.concat(F.col("role"), F.lit("\n"), F.col("text"), F.lit("\n"))
    listed = turns.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("number", line.alias("line"), F.coalesce("loss", F.lit("")).alias("loss")))).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: t["line"]), "")
    loss = F.array_join(F.transform("turns", lambda t: t["loss"]), "")
    sizes = windows.groupBy(F.struct("conv_id").alias("key")).agg(F.sum(F.length("text").cast("long")).alias("formatted_chars"))
    return listed.join(sizes, "key").select(
        F.col("key.conv_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
