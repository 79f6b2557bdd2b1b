"""Preference pairs of conversations as one prompt and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Role whose turns carry loss.
LEARNED = "assistant"


def gather_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """``conv_id, turns``: each conversation's ``(role, text)`` in the order of turn, role and text.

    Repeated rows count once; null roles and texts are empty strings; null turns come first.  Rows
    without a conversation are left to the caller (``conv_id`` null is one group here).
    """
    one = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                       F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")).distinct()
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return one.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["role"], t["text"])).alias("turns"))


def render(turns: Column) -> Column:
    """The turns as marked text, each ``<|role|>\\n text <|end|>\\n``."""
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))), "")


def loss_spans(turns: Column) -> Column:
    """Character ranges of a rendered completion that carry loss: the learned role's texts and end marks."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,last:int>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        first = state["at"] + F.length(t["role"]) + 5
        last = first + F.length(t["text"]) + 7
        span = F.array(F.struct(first.alias("first"), last.alias("last")))
        return F.struct((last + 1).alias("at"),
                        F.when(t["role"] == LEARNED, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda state: state["spans"])


def format_preferences(pairs: DataFrame, id_col: str = "pair_id", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Render each pair of turn lists once: common prompt, chosen and rejected completion.

    Returns ``pair_id, status, n_prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans``.  The prompt is
    the longest common prefix of turns; it carries no loss and has no spans.  Spans are half-open character
    ranges of the completions that carry loss.  ``status`` is ``pair``; ``same`` if the lists are equal, so nothing
    is preferred; ``missing`` if a list is null, which counts as empty; ``no_loss`` if a completion has no turn of
    the learned role.  Every input row gives one row; repeated rows and ids are kept; other columns are ignored.
    All work is on one row, so no group is gathered.
    """
    empty = F.array().cast("array<struct<role:string,text:string>>")
    lists = pairs.select(F.col(id_col).alias("pair_id"), (F.col(chosen).isNull() | F.col(rejected).isNull()).alias("missing"),
                         F.coalesce(F.col(chosen), empty).alias("c"), F.coalesce(F.col(rejected), empty).alias("r"))
    # The first turn that differs; beyond the shorter list every turn does.
    differs = F.transform(F.arrays_zip("c", "r"), lambda z: ~z["c"].eqNullSafe(z["r"]))
    at = F.array_position(differs, True)
    split = lists.withColumn("n", F.when(at > 0, at - 1).otherwise(F.size(differs)).cast("int"))
    rest = lambda name: F.slice(name, F.col("n") + 1, F.greatest(F.size(name) - F.col("n"), F.lit(0)))
    split = split.select("pair_id", "missing", "n", F.slice("c", 1, F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    out = split.select("pair_id", "missing", F.col("n").alias("n_prompt_turns"), render(F.col("p")).alias("prompt"),
                       render(F.col("c")).alias("chosen"), render(F.col("r")).alias("rejected"),
                       loss_spans(F.col("c")).alias("chosen_spans"), loss_spans(F.col("r")).alias("rejected_spans"))
    status = (F.when(F.col("missing"), "missing").when((F.col("chosen") == "") & (F.col("rejected") == ""), "same")
              .when((F.size("chosen_spans") == 0) | (F.size("rejected_spans") == 0), "no_loss").otherwise("pair"))
    return out.withColumn("status", status).select(
        "pair_id", "status", "n_prompt_turns", "prompt", "chosen", "rejected", "chosen_spans", "rejected_spans")


def echo_pairs(conversations: DataFrame) -> DataFrame:
    """``pair_id, chosen, rejected`` from unlabelled conversations (``conv_id, turns``).

    The conversation is the chosen list.  The rejected one ends with its last learned turn, whose text
    is replaced by the turn before it: an answer that only echoes.  Without such a turn, or with
    none before it, there is no rejected list.
    """
    turns = F.col("turns")
    roles = F.transform(turns, lambda t: t["role"])
    last = F.size(roles) - F.array_position(F.reverse(roles), LEARNED).cast("int")  # 0-based
    has = F.array_contains(roles, LEARNED) & (last > 0)
    echo = F.array(F.struct(F.lit(LEARNED).alias("role"), F.element_at(turns, last)["text"].alias("text")))
    return conversations.select(F.col("conv_id").alias("pair_id"), turns.alias("chosen"),
                                F.when(has, F.concat(F.slice(turns, 1, last), echo)).alias("rejected"))
