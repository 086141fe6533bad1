"""Preference formatting of conversations, in DataFrame operations only.

A pair has a chosen and a rejected conversation. Their longest common prefix of turns is rendered
once as the prompt; what follows on each side is a completion. Each rendered turn is a row, so no
task gathers a conversation whatever its length, and says whether it is trained on: the assistant's
turns of a completion are, all else is masked.

Turns are rows ``(pair_id, turn, role, text)``. Cases: rows without a pair id or turn number are
left out; of several rows with one pair id and turn number the least (role, text) stays, nulls
first, so ties do not matter; a null role or text counts as empty; a turn's text is carried whole,
however long; other columns are not carried, whatever their names; a pair with one side only, or with the same
conversation twice, has no completions to tell apart and is left out; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import saved

START, END = "<|", "<|end|>\n"


def one_per_turn(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``(conv, turn, role, text)``, one row for each conversation and turn number."""
    ident = F.col(f"`{id_col}`")
    said = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.where(ident.isNotNull() & F.col("turn").isNotNull()).select(ident.alias("conv"), "turn", said.alias("said"))
    rows = rows.groupBy("conv", "turn").agg(F.min("said").alias("said"))
    return rows.select("conv", "turn", "said.role", "said.text")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("|>\n"), text, F.lit(END))


def preference_rows(chosen: DataFrame, rejected: DataFrame, id_col: str = "pair_id") -> DataFrame:
    """Rows ``(pair_id, part, turn, role, text, train)`` of the prompt and both completions."""
    a = one_per_turn(chosen, id_col).withColumn("side", F.lit("a"))
    b = one_per_turn(rejected, id_col).withColumn("side", F.lit("b"))
    said = F.struct("role", "text")
    of = lambda x: F.max(F.when(F.col("side") == x, said)).alias(x)
    both = saved(a.unionByName(b).groupBy("conv", "turn").agg(of("a"), of("b")), "chat-turns")
    differs = ~F.col("a").eqNullSafe(F.col("b"))
    split = both.groupBy("conv").agg(F.min(F.when(differs, F.col("turn"))).alias("at"), F.count("a").alias("na"), F.count("b").alias("nb"))
    split = split.where(F.col("at").isNotNull() & (F.col("na") > 0) & (F.col("nb") > 0)).select("conv", "at")
    rows = both.join(split, "conv")
    sides = F.when(F.col("turn") < F.col("at"), F.array(F.struct(F.lit("prompt").alias("part"), F.col("a").alias("said")))).otherwise(
        F.array(F.struct(F.lit("chosen").alias("part"), F.col("a").alias("said")), F.struct(F.lit("rejected").alias("part"), F.col("b").alias("said")))
    )
    rows = rows.select("conv", "turn", F.inline(sides)).where(F.col("said").isNotNull())
    train = (F.col("part") != "prompt") & (F.col("said.role") == "assistant")
    return rows.select(F.col("conv").alias("pair_id"), "part", "turn", F.col("said.role").alias("role"), rendered(F.col("said.role"), F.col("said.text")).alias("text"), train.alias("train"))


def crossed(turns: DataFrame, id_col: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turns for conversations without human preferences.

    Conversations 2k and 2k+1 go over into each other at a turn that the assistant has in both: the
    first such turn if k is even, the last if it is odd. The chosen side is the conversation whole,
    the rejected one has the other's turns from there on. How far they agree is not known before,
    as the other may say the same. A conversation without partner or such a turn is left out.
    """
    rows = one_per_turn(turns, id_col).withColumn("pair", F.shiftright("conv", 1))
    side = F.col("conv").bitwiseAND(F.lit(1))
    said = F.struct("role", "text")
    of = lambda k, name: F.max(F.when(side == k, said)).alias(name)
    both = saved(rows.groupBy("pair", "turn").agg(of(0, "x"), of(1, "y")), "chat-pairs")
    meet = F.when((F.col("x.role") == "assistant") & (F.col("y.role") == "assistant"), F.col("turn"))
    at = both.groupBy("pair").agg(F.min(meet).alias("lo"), F.max(meet).alias("hi")).where("lo is not null")
    at = at.select("pair", F.when(F.col("pair") % 2 == 0, F.col("lo")).otherwise(F.col("hi")).alias("at"))
    both = both.join(at, "pair")

    def turns_of(first, second):
        """Turns of both conversations of a pair: each one's own, then from the meeting turn on ``first`` and ``second``."""
        own = F.array(F.struct(F.lit(0).alias("k"), F.when(F.col("turn") < F.col("at"), F.col("x")).otherwise(F.col(first)).alias("said")), F.struct(F.lit(1).alias("k"), F.when(F.col("turn") < F.col("at"), F.col("y")).otherwise(F.col(second)).alias("said")))
        out = both.select("pair", "turn", F.inline(own)).where(F.col("said").isNotNull())
        return out.select((F.col("pair") * 2 + F.col("k")).alias("pair_id"), "turn", "said.role", "said.text")

    return turns_of("x", "y"), turns_of("y", "x")
