"""Preference examples against their SQL and a plain version, and odd tables."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from pairloom.llm import preference
from pairloom.llm.queries import QUERIES, SQL

from ..compare import connect, differences
from .cases import FOLDER

SCHEMA = "pair_id long, turn int, role string, text string"


def test_query_matches_sql(spark):
    assert differences(QUERIES["op5_preference"](spark, FOLDER), connect(FOLDER), SQL["op5_preference"]) is None


def in_order(turns):
    """Turns by key: (turn, role, text) sorted, a null role or text as empty."""
    found = defaultdict(list)
    for key, turn, role, text in turns:
        found[key].append((turn, role or "", text or ""))
    return {k: [(role, text) for _, role, text in sorted(v, key=lambda t: (t[0] is not None, t[0] or 0, t[1:]))] for k, v in found.items()}


def plain(chosen, rejected):
    chosen, rejected, found = in_order(chosen), in_order(rejected), {}
    for key in chosen.keys() | rejected.keys():
        c, r = chosen.get(key, []), rejected.get(key, [])
        n = 0
        while n < min(len(c), len(r)) and c[n][0] == r[n][0] and c[n][1] == r[n][1]:
            n += 1
        sides = []
        for turns in (c[:n], c[n:], r[n:]):
            text, spans = "", []
            for role, said in turns:
                text += f"<|{role}|>\n"
                if role == "assistant":
                    spans.append(f"{len(text)}-{len(text) + len(said)}")
                text += f"{said}\n<|end|>\n"
            sides += [text, ";".join(spans)]
        found[key] = (n, sides[0], *sides[2:])
    return found


def result(df, key="pair_id"):
    return {r[key]: (r["n_prompt_turns"], r["prompt"], r["chosen"], r["chosen_mask"], r["rejected"], r["rejected_mask"]) for r in df.collect()}


def test_random_pairs(spark):
    draw = random.Random(3)
    said = [None, "", "yes", "no", "é 漢\U0001f600", "<|end|>\n", "a\nb"]
    sides = ([], [])
    for key in [None, *range(120)]:
        shared = [(k if draw.random() < 0.9 else 1, draw.choice(["user", "assistant", None]), draw.choice(said)) for k in range(draw.randint(0, 5))]
        for side in sides:
            side += [(key, *t) for t in shared[: draw.randint(0, 5)]]
            side += [(key, 9 + k, draw.choice(["user", "assistant", "system"]), draw.choice(said)) for k in range(draw.randint(0, 3))]
    frames = [spark.createDataFrame(s, SCHEMA) for s in sides]
    clash = [f.withColumns({c: F.lit("clash") for c in ("key", "side", "chosen", "rejected", "prompt")}) for f in frames]
    assert result(preference.preference_examples(*clash)) == plain(*sides)


def test_ends(spark):
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "a" * 200_000), (2, 0, "user", "only here"), (3, 0, "user", "x"), (3, 0, "user", "x")]
    chosen = spark.createDataFrame(turns, SCHEMA)
    none = chosen.limit(0)
    assert result(preference.preference_examples(chosen, chosen)) == plain(turns, turns)
    assert result(preference.preference_examples(chosen, none)) == plain(turns, [])
    assert result(preference.preference_examples(none, chosen)) == plain([], turns)
    assert preference.preference_examples(none, none).count() == 0


def test_masks_are_the_assistant_texts(spark):
    turns = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    said = defaultdict(set)
    for r in turns.where("role = 'assistant'").collect():
        said[r["conv_id"]].add(r["text"] or "")
    for r in QUERIES["op5_preference"](spark, FOLDER).collect():
        for span in filter(None, r["chosen_mask"].split(";")):
            a, b = map(int, span.split("-"))
            assert r["chosen"][a:b] in said[r["conv_id"]]


def test_swapped_replies(spark):
    turns = [
        (0, 0, "user", "q0"), (0, 1, "assistant", "first"), (0, 2, "assistant", "r0"), (1, 0, "assistant", None), (2, 0, "assistant", "alone"), (2, 1, "user", "end"),
        (4, 0, "user", "q4"), (5, 0, "assistant", "r5"), (None, 0, "assistant", "kept"),
    ]
    rows = preference.swapped_replies(spark.createDataFrame(turns, SCHEMA.replace("pair_id", "conv_id"))).collect()
    want = {
        (0, 0, "user", "q0"), (0, 1, "assistant", "first"), (0, 2, "assistant", ""), (1, 0, "assistant", "r0"), (2, 1, "user", "end"), (4, 0, "user", "q4"), (None, 0, "assistant", "kept"),
    }
    for side, found in (("chosen", {(*t[:3], t[3] or "") for t in turns}), ("rejected", want)):
        got = [(r["conv_id"], *t) for r in rows for t in r[side]]
        assert set(got) == found and len(got) == len(found)


def test_neighbours_below_zero_and_ties(spark):
    turns = [(-2, 0, "assistant", "m2"), (-1, 0, "assistant", "m1"), (-1, 0, "assistant", "m0"), (-1, 0, "user", "u")]
    rows = preference.swapped_replies(spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")).collect()
    got = {r["conv_id"]: [t["text"] for t in r["rejected"]] for r in rows}
    assert got == {-2: ["m1"], -1: ["m2", "m2", "u"]}


def test_turns_without_an_id_stand_alone(spark):
    turns = [(None, k, "assistant", f"n{k}") for k in range(50)] + [(0, 0, "assistant", "r0"), (1, 0, "assistant", "r1")]
    rows = preference.swapped_replies(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")).collect()
    alone = [r for r in rows if r["conv_id"] is None]
    assert len(alone) == 50 and all(len(r["chosen"]) == 1 and r["chosen"] == r["rejected"] for r in alone)
    assert {r["conv_id"]: r["rejected"][0]["text"] for r in rows if r["conv_id"] is not None} == {0: "r1", 1: "r0"}
