"""Preference examples: shared opening turns become the prompt, the rest two completions with training masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is written: role line, text, end mark.
OPEN, AFTER_ROLE, CLOSE = "<|", "|>\n", "\n<|end|>\n"


def render(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(AFTER_ROLE), turn["text"], F.lit(CLOSE))


def _spans(turns: Column) -> Column:
    """Character ranges ``start-end`` (end exclusive) of assistant texts in a rendered completion, joined by ``;``."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        head = state["at"] + F.length(turn["role"]) + len(OPEN) + len(AFTER_ROLE)
        end = head + F.length(turn["text"])
        mark = F.concat(F.when(state["spans"] == "", "").otherwise(";"), head.cast("string"), F.lit("-"), end.cast("string"))
        spans = F.when(turn["role"] == "assistant", F.concat(state["spans"], mark)).otherwise(state["spans"])
        return F.struct((end + len(CLOSE)).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s["spans"])


def _item(role: str = "role", text: str = "text") -> Column:
    return F.struct("turn", F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def preference_examples(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id") -> DataFrame:
    """One row per pair from the turns (key, turn, role, text) of its chosen and its rejected conversation, see ``examples``.

    Turns go by their number, ties by role and text; a null role or text counts as empty. A pair that is missing on one side
    has an empty conversation there.
    """
    sides = [
        turns.select(F.col(key).alias("key"), F.lit(side).alias("side"), _item().alias("item"))
        for side, turns in (("chosen", chosen), ("rejected", rejected))
    ]
    both = sides[0].unionByName(sides[1]).groupBy("key").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("item")))).alias(side) for side in ("chosen", "rejected")],
    )
    return examples(both.withColumnRenamed("key", key), key)


def examples(both: DataFrame, key: str) -> DataFrame:
    """Prompt and completions of (key, chosen, rejected), the two conversations as arrays of turns (turn, role, text) in order.

    The longest run of opening turns that agree in role and text is rendered once as ``prompt``; what follows on either
    side is rendered as ``chosen`` and ``rejected``. ``chosen_mask`` and ``rejected_mask`` list the character ranges of the
    assistant texts in the completion, the only part a loss should count. An empty conversation makes the prompt and its own
    completion empty; conversations that agree in full have empty completions. A conversation must fit in a cell, as its result does.
    """
    n = F.least(F.size("chosen"), F.size("rejected"))
    differs = F.filter(
        F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")),
        lambda i: (F.element_at("chosen", i)["role"] != F.element_at("rejected", i)["role"]) | (F.element_at("chosen", i)["text"] != F.element_at("rejected", i)["text"]),
    )
    shared = both.select(F.col(key).alias("key"), "chosen", "rejected", F.coalesce(F.array_min(differs) - 1, n).alias("n_prompt"))
    rest = {side: F.slice(side, F.col("n_prompt") + 1, F.greatest(F.size(side), F.lit(1))) for side in ("chosen", "rejected")}
    text = lambda turns: F.concat_ws("", F.transform(turns, render))
    return shared.select(
        F.col("key").alias(key), F.col("n_prompt").cast("long").alias("n_prompt_turns"),
        text(F.when(F.col("n_prompt") > 0, F.slice("chosen", F.lit(1), F.greatest(F.col("n_prompt"), F.lit(1)))).otherwise(F.slice("chosen", F.lit(1), F.lit(0)))).alias("prompt"),
        text(rest["chosen"]).alias("chosen"), _spans(rest["chosen"]).alias("chosen_mask"),
        text(rest["rejected"]).alias("rejected"), _spans(rest["rejected"]).alias("rejected_mask"),
    )


def swapped_replies(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, chosen, rejected) for ``examples`` from single conversations: the rejected side has all turns but the last assistant
    text, which is that of the neighbour (ids 2k and 2k + 1 are neighbours; ids are whole numbers).

    Without a neighbour, or where the neighbour has no assistant turn, the last assistant turn is left out. Every turn without
    an id is a conversation of its own with equal sides and needs no group. Neighbours meet in one group, so every text is shuffled once.
    """
    number = F.col(key).cast("long")
    odd = F.coalesce(F.pmod(number, F.lit(2)) == 1, F.lit(False))
    pairs = turns.where(number.isNotNull()).groupBy(F.shiftright(number, 1).alias("pair")).agg(
        F.array_sort(F.collect_list(F.when(~odd, _item()))).alias("even"), F.array_sort(F.collect_list(F.when(odd, _item()))).alias("odd"),
    )

    def assistant(side: str) -> Column:
        return F.filter(side, lambda t: t["role"] == "assistant")

    def one(side: str, other: str, place: int) -> Column:
        return F.struct(
            (F.col("pair") * 2 + place).alias("number"), F.col(side).alias("chosen"),
            F.array_max(F.transform(assistant(side), lambda t: t["turn"])).alias("last"), F.try_element_at(assistant(other), F.lit(-1))["text"].alias("reply"),
        )

    def replaced(turn: Column) -> Column:
        return F.coalesce((turn["role"] == "assistant") & (turn["turn"] == F.col("last")), F.lit(False))

    def swapped(turn: Column) -> Column:
        return F.struct(turn["turn"].alias("turn"), turn["role"].alias("role"), F.when(replaced(turn), F.col("reply")).otherwise(turn["text"]).alias("text"))

    rejected = F.when(F.col("reply").isNull(), F.filter("chosen", lambda t: ~replaced(t))).otherwise(F.transform("chosen", swapped))
    single = pairs.select(F.inline(F.array(one("even", "odd", 0), one("odd", "even", 1)))).where(F.size("chosen") > 0)
    nameless = turns.where(number.isNull()).select(F.col(key), F.array(_item()).alias("chosen")).withColumn("rejected", F.col("chosen"))
    return single.select(F.col("number").cast(turns.schema[key].dataType).alias(key), "chosen", rejected.alias("rejected")).unionByName(nameless)
