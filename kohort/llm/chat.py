"""Preference formatting: one shared prompt and two masked completions for each pair of conversations. Native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the rendering.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _render(turns: Column) -> Column:
    """Each turn as OPEN role newline text CLOSE; a null role or text counts as empty."""
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(CLOSE))))


def _mask(turns: Column) -> Column:
    """Character spans ``(start, length)`` of a completion that are trained on: the text and CLOSE of assistant turns."""
    head = lambda t: F.length(F.lit(OPEN)) + F.length(F.coalesce(t["role"], F.lit(""))) + 1
    body = lambda t: F.length(F.coalesce(t["text"], F.lit(""))) + len(CLOSE)
    none = F.array().cast("array<struct<start:int,length:int>>")
    walked = F.aggregate(
        turns,
        F.struct(F.lit(0).alias("at"), none.alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + head(t) + body(t)).alias("at"),
            F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(F.struct((acc["at"] + head(t)).cast("int").alias("start"), body(t).cast("int").alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return walked["spans"]


def format_preferences(conversations: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Longest common turn prefix as ``prompt``, the rest as ``chosen`` and ``rejected`` with loss masks.

    conversations: ``conv_id, turn, role, text``. pairs: ``pair_id, chosen_id, rejected_id``; without it conversation
    2k is preferred to 2k+1 and k is the pair. Turns are ordered by turn, then role and text; two turns are equal when
    role and text are (null equals null). Rows with a null conv_id belong to no pair. A pair that lacks a side has a
    null completion there and an empty prompt, and ``complete`` is false. Repeated rows of a conversation stay turns
    of their own. No rows give no rows. One shuffle by pair: a group is one pair of conversations, never a hot key.
    """
    turns = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", F.struct("turn", "role", "text").alias("t"))
    if pairs is None:
        sided = turns.select(F.expr("(conv_id - pmod(conv_id, 2)) div 2").alias("pair_id"), (F.pmod("conv_id", F.lit(2)) == 1).alias("second"), "t")
    else:
        ids = pairs.select("pair_id", F.explode(F.array(F.struct(F.col("chosen_id").alias("id"), F.lit(False).alias("second")), F.struct(F.col("rejected_id").alias("id"), F.lit(True).alias("second")))).alias("s"))
        ids = ids.select("pair_id", F.col("s.second").alias("second"), F.col("s.id").alias("conv_id"))
        sided = ids.join(turns, "conv_id").select("pair_id", "second", "t")
    grouped = sided.groupBy("pair_id").agg(
        F.array_sort(F.collect_list(F.when(~F.col("second"), F.col("t")))).alias("a"),
        F.array_sort(F.collect_list(F.when(F.col("second"), F.col("t")))).alias("b"),
    )
    return format_turns(grouped)


def format_turns(pairs: DataFrame) -> DataFrame:
    """The same for ``pair_id, a, b``: the chosen and the rejected turns (``turn, role, text``) in order, empty for a side that lacks."""
    n = F.least(F.size("a"), F.size("b"))
    same = lambda i: F.get("a", i)["role"].eqNullSafe(F.get("b", i)["role"]) & F.get("a", i)["text"].eqNullSafe(F.get("b", i)["text"])
    first = F.when(n > 0, F.get(F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~same(i)), F.lit(0)))
    cut = pairs.withColumn("n", n).withColumn("prefix_turns", F.coalesce(first, F.col("n")))
    rest = lambda side: F.slice(side, F.col("prefix_turns") + 1, F.size(side))
    parts = cut.select("pair_id", "prefix_turns", (F.size("a") > 0).alias("has_a"), (F.size("b") > 0).alias("has_b"), F.slice("a", F.lit(1), F.col("prefix_turns")).alias("p"), rest("a").alias("ra"), rest("b").alias("rb"))
    return parts.select(
        "pair_id",
        "prefix_turns",
        _render(F.col("p")).alias("prompt"),
        F.when(F.col("has_a"), _render(F.col("ra"))).alias("chosen"),
        F.when(F.col("has_b"), _render(F.col("rb"))).alias("rejected"),
        F.when(F.col("has_a"), _mask(F.col("ra"))).alias("chosen_mask"),
        F.when(F.col("has_b"), _mask(F.col("rb"))).alias("rejected_mask"),
        (F.col("has_a") & F.col("has_b")).alias("complete"),
    )


def swapped_replies(conversations: DataFrame) -> DataFrame:
    """``pair_id, a, b`` for format_turns: each conversation is preferred to itself with another's last reply.

    The rejected side is the conversation whose last assistant turn (the greatest turn, of equal ones the greatest text) has
    the text of the last assistant turn of its neighbour (conv_id with the lowest bit changed), or is empty if there is none;
    repeated rows of that turn change alike, and a conversation without an assistant turn is the same on both sides.
    pair_id is conv_id. Rows with a null conv_id go. One shuffle: neighbours meet in one row.
    """
    own = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", F.struct("turn", "role", "text").alias("t"))
    odd = F.col("conv_id").bitwiseAND(F.lit(1)) == 1
    two = own.groupBy(F.shiftright("conv_id", 1).alias("_k")).agg(F.array_sort(F.collect_list(F.when(~odd, F.col("t")))).alias("e"), F.array_sort(F.collect_list(F.when(odd, F.col("t")))).alias("o"))
    last = lambda turns: F.array_max(F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: F.struct(t["turn"].alias("turn"), t["text"].alias("text"))))
    two = two.withColumns({"le": last("e"), "lo": last("o")})
    side = lambda bit, turns, mine, other: F.struct((F.shiftleft("_k", 1) + bit).alias("pair_id"), F.col(turns).alias("a"), F.col(mine).alias("mine"), F.coalesce(F.col(other)["text"], F.lit("")).alias("other"))
    each = two.select(F.explode(F.array(side(0, "e", "le", "lo"), side(1, "o", "lo", "le"))).alias("x")).select("x.*").where(F.size("a") > 0)

    def changed(t: Column) -> Column:
        is_last = F.coalesce(F.col("mine").isNotNull() & (t["role"] == "assistant") & t["turn"].eqNullSafe(F.col("mine")["turn"]) & t["text"].eqNullSafe(F.col("mine")["text"]), F.lit(False))
        return F.struct(t["turn"].alias("turn"), t["role"].alias("role"), F.when(is_last, F.col("other")).otherwise(t["text"]).alias("text"))

    return each.select("pair_id", "a", F.array_sort(F.transform("a", changed)).alias("b"))
