"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation finds out how far to trust each."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .words import BYTE_CODE, per_text, slices, span_hashes

SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits"]
REPEAT_WINDOW = 3


def _byte_set(chars: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(chars)] = True
    return found


IS_SYMBOL, IS_DIGIT, IS_UPPER = _byte_set(SYMBOLS), _byte_set(b"0123456789"), _byte_set(bytes(range(0x41, 0x5B)))


def _counts(texts) -> dict[str, np.ndarray]:
    data, bounds = texts.data, texts.bounds
    space = np.ones(len(data), bool)
    # Bytes of words that start a code point.
    inside = np.zeros(len(data) + 1, np.int8)
    inside[texts.starts] += 1
    np.subtract.at(inside, texts.ends, 1)
    space = np.cumsum(inside[:-1]) == 0
    chars = ~space & ((data & 0xC0) != 0x80)

    # Lines: runs between line ends, inside a text.
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate([bounds[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([breaks, bounds[1:]]))
    owner = np.repeat(np.arange(texts.n), per_text(data == 0x0A, bounds) + 1)
    sums = np.concatenate([[0], np.cumsum(~space)])
    worded = sums[ends] > sums[starts]
    starts, ends, owner = starts[worded], ends[worded], owner[worded]
    lines = np.bincount(owner, minlength=texts.n)
    key = np.stack([owner.astype(np.uint64), span_hashes(BYTE_CODE[data], starts, ends)], 1)
    order = np.lexsort((key[:, 1], key[:, 0]))
    same = (key[order][1:] == key[order][:-1]).all(1)
    dup_lines = np.bincount(owner[order][1:][same], minlength=texts.n)

    # Words under a window that its text has twice or more.
    first, window = texts.windows(texts.hashes, REPEAT_WINDOW)
    window = window ^ (texts.text_of_word[first].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    order = np.argsort(window)
    twin = window[order][1:] == window[order][:-1]
    found = np.zeros(len(window), bool)
    found[order[1:][twin]] = True
    found[order[:-1][twin]] = True
    covered = np.zeros(len(texts.starts), bool)
    for k in range(REPEAT_WINDOW):
        covered[first[found] + k] = True
    return {
        "n_words": texts.n_words, "word_chars": per_text(chars, bounds), "n_symbols": per_text(IS_SYMBOL[data], bounds), "n_lines": lines,
        "n_dup_lines": dup_lines, "n_repeat_words": per_text(covered, texts.word_bounds), "n_upper": per_text(IS_UPPER[data], bounds),
        "n_digits": per_text(IS_DIGIT[data], bounds),
    }


def text_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts over the whole of every text (a null counts as empty), one row per row of ``docs``.

    n_words; word_chars (code points in words); n_symbols; n_lines (lines with a word); n_dup_lines (those equal to an earlier
    one of the text); n_repeat_words (words under a three-word window that the text has twice or more); n_upper (A-Z); n_digits.
    Lines and windows are compared by 64-bit hashes.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            found = _counts(texts)
            yield pa.RecordBatch.from_arrays([part.column("id"), *[pa.array(found[c].astype(np.int64)) for c in COUNTS]], names=["id", *COUNTS])

    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(count, ", ".join([f"id {kind}", *[f"{c} bigint" for c in COUNTS]])).withColumnRenamed("id", id_column)


@dataclass(frozen=True)
class Rule:
    """Votes bad (0) beyond ``bad``, good (1) up to ``good``, and abstains (null) in between."""

    name: str
    share: Column  # never null
    good: float
    bad: float

    def vote(self) -> Column:
        return F.when(self.share > self.bad, 0).when(self.share <= self.good, 1).cast("int")


def rules() -> list[Rule]:
    """The rules; each looks at a share that junk has more of than prose."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    length = F.coalesce(F.try_divide(F.col("word_chars").cast("double"), F.col("n_words")), F.lit(0.0))
    return [
        Rule("symbols", share("n_symbols", "n_words"), 0.05, 0.25),
        Rule("dup_lines", share("n_dup_lines", "n_lines"), 0.05, 0.3),
        Rule("repeats", share("n_repeat_words", "n_words"), 0.1, 0.4),
        Rule("capitals", share("n_upper", "word_chars"), 0.15, 0.4),
        Rule("digits", share("n_digits", "word_chars"), 0.05, 0.25),
        Rule("word_length", F.abs(length - 6.0), 3.0, 6.0),
    ]


@dataclass(frozen=True)
class Weights:
    """What a vote adds to the log odds of good quality, by rule and vote; a missing vote adds nothing."""

    prior: float
    votes: dict[str, tuple[float, float]]  # rule: (bad, good)

    def posterior(self) -> Column:
        total = F.lit(self.prior)
        for name, (bad, good) in self.votes.items():
            total = total + F.when(F.col(name) == 0, bad).when(F.col(name) == 1, good).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


#: Votes of either kind that every rule is given in both classes, so that no rate is 0.
SMOOTH = 0.0001
#: Share of every text's weight that stays with the belief at the start. Where a single rule tells the classes apart, many splits are
#: equally likely and the votes alone would let the estimate drift to one class that explains everything; this share then decides.
ANCHOR = 0.0005


def _estimate(votes: np.ndarray, count: np.ndarray, rounds: int, start_bad: float, least_good: float) -> tuple[float, np.ndarray, np.ndarray]:
    """(log odds of good before any vote, what a bad vote adds by rule, what a good vote adds)."""
    cast, good = ~np.isnan(votes), np.nan_to_num(votes)
    belief = start = np.where((cast & (good == 0)).any(1), start_bad, 1 - start_bad)
    for _ in range(rounds):
        prior = min(max((count * belief).sum() / count.sum(), least_good), 1 - 1e-6)
        rates = []
        for weight in (count * (1 - belief), count * belief):
            cast_weight = weight[:, None] * cast
            rates.append(((cast_weight * good).sum(0) + SMOOTH) / (cast_weight.sum(0) + 2 * SMOOTH))
        for_good, for_bad = np.log(rates[1] / rates[0]), np.log((1 - rates[1]) / (1 - rates[0]))
        odds = math.log(prior / (1 - prior)) + (cast * np.where(good == 1, for_good, for_bad)).sum(1)
        belief, before = (1 - ANCHOR) / (1 + np.exp(-odds)) + ANCHOR * start, belief
        if np.abs(belief - before).max() < 1e-9:
            break
    return math.log(prior / (1 - prior)), for_bad, for_good


#: A bad vote that adds more than this to the odds of good is taken to speak against its rule; smaller sums are chance.
WRONG_SIGN = 0.1


def fit(patterns: list[tuple[tuple[int | None, ...], int]], names: list[str], rounds: int = 100, start_bad: float = 0.1, least_good: float = 0.5) -> Weights:
    """Expectation-maximisation over (votes, count): two classes, and for each rule and class how often a vote is good.

    Abstaining is taken to say nothing about the class. It starts from the belief that a text with any bad vote is likely bad,
    and ANCHOR of it stays.
    Counts are smoothed by SMOOTH, and the prior of good stays at or above ``least_good``. If the classes that are found make a bad vote
    of some rule speak for good, they do not tell good from bad for it: the rule with the largest such vote gets weight 0 and
    the rest is estimated anew. So no bad vote raises the odds by more than WRONG_SIGN, and those within are set to 0.
    """
    weights = dict.fromkeys(names, (0.0, 0.0))
    used = list(range(len(names)))
    while patterns and used:
        votes = np.array([[np.nan if p[j] is None else p[j] for j in used] for p, _ in patterns], float)
        prior, for_bad, for_good = _estimate(votes, np.array([n for _, n in patterns], float), rounds, start_bad, least_good)
        worst = int(np.argmax(for_bad))
        if for_bad[worst] <= WRONG_SIGN:
            return Weights(prior, weights | {names[j]: (min(float(for_bad[i]), 0.0), float(for_good[i])) for i, j in enumerate(used)})
        del used[worst]
    return Weights(0.0, weights)


def judged(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep_from: float = 0.5, learn_from: Column | None = None) -> DataFrame:
    """Counts, votes and posterior probability of good quality for every text; ``kept`` where it reaches ``keep_from``.

    Accuracies are estimated from how often each pattern of votes occurs among the rows where ``learn_from`` (a condition on the counts)
    holds, by default all: texts that other rules reject anyway, such as very short ones, would be taken for the bad class, whatever
    the votes. At most 3 ** 6 patterns reach the driver, whatever the number of rows. Texts without words get votes of shares that are 0; a
    text's verdict depends on its votes alone, so equal texts share it and null or repeated ids do not matter. An empty table gives no rows.
    """
    used = rules()
    names = [r.name for r in used]
    voted = cut_lineage(text_counts(docs, id_column, text_column).withColumns({r.name: r.vote() for r in used}))
    learnt = voted if learn_from is None else voted.where(learn_from)
    patterns = [(tuple(row[n] for n in names), row["n"]) for row in learnt.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()]
    weights = fit(sorted(patterns, key=str), names)
    return voted.withColumn("p_good", weights.posterior()).withColumn("kept", F.col("p_good") >= keep_from)
