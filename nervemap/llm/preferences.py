"""Preference formatting: one prompt for what two conversations share, and a masked completion for each.

A chosen and a rejected conversation are lists of turns. The longest prefix of equal turns is rendered once, as the prompt; what
follows is rendered as two completions, with the spans of characters that a loss should see: those of the assistant's turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nervemap.runtime import own_columns, unused

#: A turn is START role MIDDLE text END; START cannot come from a text or role, in which "<|" becomes "< |".
START, MIDDLE, END = "<|", "|>\n", "<|end|>\n"
TURN = "struct<role:string,text:string>"


def _safe(x: Column) -> Column:
    return F.replace(F.coalesce(x, F.lit("")), F.lit("<|"), F.lit("< |"))


def render_turn(turn: Column) -> Column:
    return F.concat(F.lit(START), _safe(turn["role"]), F.lit(MIDDLE), _safe(turn["text"]), F.lit(END))


def common_turns(a: Column, b: Column) -> Column:
    """How many turns from the start are equal; nulls equal nulls."""
    same = F.zip_with(a, b, lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]) & x.isNotNull() & y.isNotNull())
    at = F.array_position(F.transform(same, lambda s: F.coalesce(s, F.lit(False))), False)
    return F.when(F.coalesce(at, F.lit(0)) > 0, at - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")


def _completion(turns: Column, trained: str) -> Column:
    """text and spans (start, end) of the turns: of the trained role all after the head, the end mark included."""
    start = F.struct(F.lit("").alias("text"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(acc: Column, turn: Column) -> Column:
        text = F.concat(acc["text"], render_turn(turn))
        head = F.length(acc["text"]) + F.length(F.lit(START)) + F.length(_safe(turn["role"])) + F.length(F.lit(MIDDLE))
        span = F.array(F.struct(head.cast("int").alias("start"), F.length(text).cast("int").alias("end")))
        return F.struct(text.alias("text"), F.when(turn["role"] == trained, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, add)


def format_preferences(pairs: DataFrame, chosen_col: str = "chosen", rejected_col: str = "rejected", trained: str = "assistant") -> DataFrame:
    """``pairs`` with n_prompt_turns, prompt, chosen_completion, chosen_spans, rejected_completion, rejected_spans in place of the two lists of turns.

    Lists are of (role, text); a null list is empty, a null role or text renders as empty. Equal lists have two empty completions; lists
    that differ at once have an empty prompt. Spans count characters of their completion. Repeated rows stay; an empty table gives an
    empty result; other columns stay unless they bear the names above, which they lose.
    """
    made = ["n_prompt_turns", "prompt", "chosen_completion", "chosen_spans", "rejected_completion", "rejected_spans"]
    kept = [c for c in own_columns(pairs.drop(chosen_col, rejected_col, *made))]
    x, *sides = unused(pairs, "turns", "chosen_side", "rejected_side")
    none = F.array().cast(f"array<{TURN}>")
    a, b = (F.coalesce(F.col(c).cast(f"array<{TURN}>"), none) for c in (chosen_col, rejected_col))
    base = pairs.select(*kept, F.struct(a.alias("a"), b.alias("b"), common_turns(a, b).alias("n")).alias(x))
    rest = lambda side: F.slice(F.col(x)[side], F.col(x)["n"] + 1, F.size(F.col(x)[side]))
    out = base.select(
        *kept,
        F.col(x)["n"].alias("n_prompt_turns"),
        F.concat_ws("", F.transform(F.slice(F.col(x)["a"], F.lit(1), F.col(x)["n"]), render_turn)).alias("prompt"),
        *(_completion(rest(s), trained).alias(n) for s, n in zip("ab", sides, strict=True)),
    )
    return out.select(*kept, "n_prompt_turns", "prompt", *(F.col(s)[x].alias(f"{n}_{y}") for s, n in zip(sides, ("chosen", "rejected"), strict=True) for x, y in (("text", "completion"), ("spans", "spans"))))


def preference_pairs(
    conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: str = "assistant"
) -> DataFrame:
    """(id, chosen, rejected) of every conversation.

    chosen: the turns up to the last of the trained role, in order of turn, role and text; turns after it answer nothing and are left out. rejected: the
    same, but the last turn repeats the first of that role, or is empty if it is itself the first or equal to it. A conversation without
    a turn of that role gives all its turns on both sides. Repeated rows count once; each row without an id is a conversation of its
    own. A conversation is one row, however long, since it is rendered as one text. An empty table gives an empty result. Other columns play no part.
    """
    row = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    once = conversations.select(F.col(id_col).alias("_id"), row.alias("t")).distinct()
    whole = once.groupBy("_id", F.when(F.col("_id").isNull(), F.col("t")).alias("_own")).agg(F.sort_array(F.collect_list("t")).alias("t"))
    is_reply = lambda x: F.coalesce(x["role"] == trained, F.lit(False))
    flags = F.transform("t", is_reply)
    last = F.size("t") - F.array_position(F.reverse(flags), True).cast("int") + 1
    replied = F.exists("t", is_reply)
    cut = whole.select("_id", replied.alias("replied"), F.when(replied, F.slice("t", F.lit(1), last)).otherwise(F.col("t")).alias("t"))
    first = F.filter("t", is_reply)[0]["text"]
    final = F.element_at("t", -1)
    other = F.when((F.size(F.filter("t", is_reply)) > 1) & ~first.eqNullSafe(final["text"]), first).otherwise(F.lit(""))
    turns = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    rejected = F.concat(F.slice(turns, F.lit(1), F.size("t") - 1), F.array(F.struct(final["role"].alias("role"), other.alias("text"))))
    return cut.select(F.col("_id").alias(id_col), turns.alias("chosen"), F.when(F.col("replied"), rejected).otherwise(turns).alias("rejected"))
