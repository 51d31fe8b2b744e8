"""Preference pairs for training: one prompt, a chosen and a rejected completion, and their masks.

The prompt is the longest common turn prefix of the two conversations, rendered once. Masks give the
parts of a completion that are learnt: the assistant's turns with their end marks, as character spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, HEAD_END, TURN_END = "<|turn|>", "\n", "<|end|>\n"
LEARNT_ROLE = "assistant"
TURNS = "array<struct<role:string,text:string>>"


def ordered_turns(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, turns) of every conversation, by turn; a conversation is one row, as a document is.

    Null roles and texts count as empty; of repeated turns all stay, ordered by role and text; rows
    without an id are left out.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), turn.alias("t"))
    grouped = rows.groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("all"))
    return grouped.select("id", F.transform("all", lambda t: F.struct(t["role"], t["text"])).cast(TURNS).alias("turns"))


def rendered(turns: Column) -> Column:
    """Turns as one text."""
    return F.array_join(F.transform(turns, rendered_turn), "")


def rendered_turn(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(HEAD_END), turn["text"], F.lit(TURN_END))


def learnt_spans(turns: Column) -> Column:
    """Character spans (first, last exclusive) of the assistant's turns in the rendered text."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,last:int>>").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        head = state["at"] + len(OPEN) + F.length(turn["role"]) + len(HEAD_END)
        end = head + F.length(turn["text"]) + len(TURN_END)
        own = F.array(F.struct(head.alias("first"), end.alias("last")))
        spans = F.when(turn["role"] == LEARNT_ROLE, F.concat(state["spans"], own)).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda state: state["spans"])


def format_preferences(pairs: DataFrame, id_col: str = "pair_id") -> DataFrame:
    """Prompt, completions and masks of rows (id, chosen, rejected), both lists of (role, text) turns.

    Row by row, without a shuffle. Pairs that lack a side are left out. Where one side is the beginning
    of the other, its completion is empty, and equal sides leave both empty. Turns must not be null
    (``ordered_turns`` makes none); other columns are dropped; an empty table gives an empty result.
    """
    both = pairs.where(F.col("chosen").isNotNull() & F.col("rejected").isNotNull())
    same = F.zip_with("chosen", "rejected", lambda a, b: a.eqNullSafe(b))
    differs = F.array_position(same, False)
    common = F.when(differs > 0, differs - 1).otherwise(F.size("chosen")).cast("int")
    cut = both.withColumn("n", common)
    rest = {
        side: F.slice(side, F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0)))
        for side in ("chosen", "rejected")
    }
    return cut.select(
        F.col(id_col),
        F.col("n").cast("bigint").alias("n_prompt_turns"),
        rendered(F.slice("chosen", F.lit(1), F.col("n"))).alias("prompt"),
        rendered(rest["chosen"]).alias("chosen"),
        rendered(rest["rejected"]).alias("rejected"),
        learnt_spans(rest["chosen"]).alias("chosen_mask"),
        learnt_spans(rest["rejected"]).alias("rejected_mask"),
    )


def exchanged_answers(conversations: DataFrame) -> DataFrame:
    """Pairs made of conversations: chosen as it is; rejected ends in another conversation's last answer.

    Conversations 2k and 2k + 1 lend one another their last assistant turn. One without an answer, or
    whose partner has none, gives no pair.
    """
    turns = ordered_turns(conversations)
    roles = F.reverse(F.transform("turns", lambda t: t["role"]))
    last = (F.size("turns") - F.array_position(roles, LEARNT_ROLE) + 1).cast("int")
    answered = turns.where(F.exists("turns", lambda t: t["role"] == LEARNT_ROLE)).withColumn("last", last)
    partner = F.col("id").bitwiseXOR(F.lit(1).cast("bigint"))
    answers = answered.select(partner.alias("id"), F.element_at("turns", F.col("last"))["text"].alias("other"))

    def lent(turn: Column, i: Column) -> Column:
        text = F.when(i + 1 == F.col("last"), F.col("other")).otherwise(turn["text"])
        return F.struct(turn["role"].alias("role"), text.alias("text"))

    joined = answered.join(answers, "id")
    rejected = F.transform("turns", lent).cast(TURNS)
    return joined.select(F.col("id").alias("pair_id"), F.col("turns").alias("chosen"), rejected.alias("rejected"))
