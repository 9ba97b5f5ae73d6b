"""Preference pairs: one prompt, two masked completions.

The turns of a chosen and a rejected conversation are compared from the start.  Their longest
common prefix of turns (same role, same text) is rendered once as the prompt; what follows
in each conversation is its completion.  A completion's mask is the list of spans
to train on: the text and end mark of each assistant turn.

The turns of a pair meet by one shuffle on the pair, which is all that moves: the output row
holds both conversations anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Marks around a turn; the role and a line end follow the first.
BEGIN, END = "<|im_start|>", "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def render(turn: Column) -> Column:
    return F.concat(F.lit(BEGIN), turn["role"], F.lit("\n"), turn["text"], F.lit(END))


def joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, render), "")


def trained_spans(turns: Column) -> Column:
    """[start, end) of each trained span in the rendered turns, in characters."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def add(acc: Column, turn: Column) -> Column:
        end = (acc["at"] + F.length(render(turn))).cast("long")
        span = F.struct((end - F.length(turn["text"]) - len(END)).cast("long").alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(turn["role"] == TRAINED_ROLE, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, add, lambda acc: acc["spans"])


def format_preferences(turns: DataFrame, pair: Column, chosen: Column, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per pair: pair, prefix_turns, prompt, chosen, rejected, chosen_spans, rejected_spans.

    ``pair`` names the pair of a turn's conversation and ``chosen`` says which of the two it is.
    Turns are in the order of ``turn`` (null first), equal ones in that of role and text;
    a turn that is repeated in all of these counts once.  A null role or text is empty.  Rows with a null
    pair or side belong to no pair and are left out.  Of a pair with one conversation the other
    completion is empty, as is the prompt; equal conversations have empty completions.
    """
    own = turns.select(pair.alias("pair"), F.struct(
        chosen.alias("side"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(text, F.lit("")).alias("text")).alias("t")).where("pair IS NOT NULL AND t.side IS NOT NULL")
    both = own.groupBy("pair").agg(F.sort_array(F.collect_set("t")).alias("turns"))
    sides = both.select("pair", F.filter("turns", lambda t: t["side"]).alias("c"), F.filter("turns", lambda t: ~t["side"]).alias("r"))
    same = F.zip_with("c", "r", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    prefix = let(F.array_position(same, False), lambda p: F.when(p > 0, p - 1).otherwise(F.size("c")).cast("int"))
    cut = sides.withColumn("prefix_turns", prefix)
    rest = lambda side: F.slice(side, F.col("prefix_turns") + 1, F.greatest(F.size(side) - F.col("prefix_turns"), F.lit(0)))
    return cut.select(
        "pair", "prefix_turns", joined(F.slice("c", F.lit(1), F.col("prefix_turns"))).alias("prompt"),
        joined(rest("c")).alias("chosen"), joined(rest("r")).alias("rejected"),
        trained_spans(rest("c")).alias("chosen_spans"), trained_spans(rest("r")).alias("rejected_spans"))
