"""Preference formatting: a chosen and a rejected conversation as one prompt and two masked completions.

The turns that both conversations begin with are found as their longest common prefix and rendered once, as the prompt; each
remainder becomes a completion. Training counts the assistant's words in the completions only: every completion comes with the
character spans to train on.

A turn is rendered as ``<|role|>\\ntext<|end|>\\n``. The mark ``<|`` inside a role or text is written ``< |``, so that no text can
pass for a turn. A span covers an assistant's text with the end mark after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED_ROLE = "assistant"


def _clean(value: Column) -> Column:
    return F.replace(value, F.lit("<|"), F.lit("< |"))


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), _clean(role), F.lit("|>\n"), _clean(text), F.lit("<|end|>\n"))


def _turn() -> Column:
    return F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def common_prefix(a: Column, b: Column) -> Column:
    """The number of turns, equal in role and text, that both lists begin with."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x.role == y.role) & (x.text == y.text), F.lit(False)))
    at = F.array_position(same, F.lit(False))
    return F.when(at > 0, at - 1).otherwise(F.size(same)).cast("long")


def _completion(turns: Column, start: Column) -> Column:
    """The rendered turns from start on, and the spans to train on as ``from-to`` joined by blanks."""
    rest = F.slice(turns, (start + 1).cast("int"), F.size(turns))
    pieces = F.transform(rest, lambda t: F.struct(rendered(t.role, t.text).alias("piece"), t.role.alias("role"), F.length(_clean(t.role)).alias("r")))

    def add(acc: Column, p: Column) -> Column:
        n = F.length(p.piece)
        span = F.concat((acc.at + p.r + 5).cast("string"), F.lit("-"), (acc.at + n - 1).cast("string"))
        spans = F.when(p.role == TRAINED_ROLE, F.concat(acc.spans, F.array(span))).otherwise(acc.spans)
        return F.struct((acc.at + n).cast("int").alias("at"), spans.alias("spans"))

    start_state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    spans = F.aggregate(pieces, start_state, add, lambda acc: F.array_join(acc.spans, " "))
    return F.struct(F.array_join(F.transform(pieces, lambda p: p.piece), "").alias("text"), spans.alias("spans"))


def format_preferences(pairs: DataFrame) -> DataFrame:
    """pairs(pair_id, chosen, rejected), both lists of turns, as pair_id, n_prompt_turns, prompt, chosen, rejected and both spans.

    A missing side is a conversation without turns: the prompt and its completion are then empty. Two equal conversations give the
    whole as prompt and empty completions.
    """
    turns = lambda c: F.coalesce(c, F.array().cast("array<struct<turn:bigint,role:string,text:string>>"))
    both = pairs.select("pair_id", turns(F.col("chosen")).alias("_c"), turns(F.col("rejected")).alias("_r"))
    both = both.withColumn("n_prompt_turns", common_prefix(F.col("_c"), F.col("_r")))
    prompt = F.array_join(F.transform(F.slice("_c", 1, F.col("n_prompt_turns").cast("int")), lambda t: rendered(t.role, t.text)), "")
    made = both.select("pair_id", "n_prompt_turns", prompt.alias("prompt"), _completion(F.col("_c"), F.col("n_prompt_turns")).alias("c"), _completion(F.col("_r"), F.col("n_prompt_turns")).alias("r"))
    return made.select("pair_id", "n_prompt_turns", "prompt", F.col("c.text").alias("chosen"), F.col("r.text").alias("rejected"), F.col("c.spans").alias("chosen_spans"), F.col("r.spans").alias("rejected_spans"))


def neighbours(turns: DataFrame) -> DataFrame:
    """pair_id, even, odd of turns(conv_id, turn, role, text): the turns of the conversations 2k and 2k + 1, in the order of turn, role and text.

    Null turn numbers come first, a null role is ``unknown`` and a null text empty; repeated rows are repeated turns; rows without
    conv_id belong to no conversation and are left out; a missing conversation has no turns. Two neighbours must fit a row, as what is
    made of them must.
    """
    t, even = _turn(), F.pmod(F.col("conv_id"), F.lit(2)) == 0
    each = turns.where("conv_id is not null").select(F.shiftright(F.col("conv_id").cast("long"), 1).alias("pair_id"), F.when(even, t).alias("e"), F.when(~even, t).alias("o"))
    return each.groupBy("pair_id").agg(F.array_sort(F.collect_list("e")).alias("even"), F.array_sort(F.collect_list("o")).alias("odd"))


def neighbouring_pairs(turns: DataFrame) -> DataFrame:
    """pairs(pair_id, chosen, rejected): conversation 2k is preferred to conversation 2k + 1, as preference sets are laid out."""
    return neighbours(turns).select("pair_id", F.col("even").alias("chosen"), F.col("odd").alias("rejected"))


def answer_pairs(turns: DataFrame) -> DataFrame:
    """pairs(pair_id, chosen, rejected), one for each conversation: itself, and its turns before its last answer with another answer after them.

    An answer is a turn of TRAINED_ROLE; the other one is the last answer of the neighbour (2k and 2k + 1 are neighbours), if there is that
    conversation and it has an answer. A conversation without an answer is wholly kept before the other answer.
    """
    both = neighbours(turns)
    id_ = F.shiftleft("pair_id", 1)
    sides = F.array(
        F.struct(id_.alias("pair_id"), F.col("even").alias("chosen"), F.col("odd").alias("other")),
        F.struct(id_.bitwiseOR(F.lit(1)).alias("pair_id"), F.col("odd").alias("chosen"), F.col("even").alias("other")),
    )
    each = both.select(F.inline(sides)).where(F.size("chosen") > 0)
    from_end = lambda c: F.array_position(F.reverse(F.transform(c, lambda t: t.role)), TRAINED_ROLE).cast("int")
    own, others = from_end(F.col("chosen")), from_end(F.col("other"))
    before = F.when(own > 0, F.slice("chosen", 1, F.size("chosen") - own)).otherwise(F.col("chosen"))
    answer = F.when(others > 0, F.slice("other", F.size("other") - others + 1, 1)).otherwise(F.slice("other", 1, 0))
    return each.select("pair_id", "chosen", F.concat(before, answer).alias("rejected"))
