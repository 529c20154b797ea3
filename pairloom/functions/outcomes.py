"""The labelling rules: evidence to outcome, votes to a three-valued label, prediction cases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrays as A
from .text import _col

# Fixed values of the labelling rules.
SIGNIFICANT = 0.05
WEAK = 0.1
DOUBTFUL = 0.2
HOPELESS = 0.5
APPROVED_PHASE = "4.0"
LATE_PHASE = 3
QUIET_SINCE = "2020"


def outcome_from_stats(median: Column, below: Column, above: Column, lowest: Column) -> Column:
    """Outcome of one trial from the median, the shares below 0.05 and above 0.2, and the minimum.

    Some inputs match no branch and stay null; so does a trial without p-values.
    """
    conflicting = (lowest < SIGNIFICANT) & (above > 0.5)
    success = (median <= SIGNIFICANT) | ((median <= WEAK) & (below >= 0.5) & ~conflicting)
    unclear = (median <= DOUBTFUL) | ((median <= HOPELESS) & (below >= 0.1) & (below < 0.5)) | conflicting
    return (
        F.when(median.isNull(), F.lit(None).cast("string"))
        .when(success, "success")
        .when(unclear, "unknown")
        .when((median > DOUBTFUL) & (below < 0.1), "fail")
    )


def value_stats(p_values: Column | str) -> dict[str, Column]:
    """The four statistics an outcome is decided on, of an ascending list of p-values; null for an empty list."""
    p = _col(p_values)
    return {
        "median": A.middle_of(p),
        "below": A.share_of(p, lambda x: x < SIGNIFICANT),
        "above": A.share_of(p, lambda x: x > DOUBTFUL),
        "lowest": F.get(p, F.lit(0)),
    }


def pair_label(max_phase: Column | str, top_phase: Column, wins: Column, losses: Column, last_date: Column | str) -> Column:
    """Three-valued label of a pair: approval decides, then the vote at the highest phase, then silence."""
    voted = (
        F.when((top_phase >= LATE_PHASE) & (wins > 2 * losses), True)
        .when(losses > 2 * wins, False)
    )
    quiet = F.when(_col(last_date) < QUIET_SINCE, False)
    return F.when(_col(max_phase) == APPROVED_PHASE, True).otherwise(F.coalesce(voted, quiet))


def case_tag(label: Column | str, predicted: Column | str) -> Column:
    """TP, TN, FP or FN of a 0/1 label and a 0/1 prediction."""
    label, predicted = _col(label), _col(predicted)
    right = F.when(label == predicted, "T").otherwise("F")
    return F.concat(right, F.when(predicted == 1, "P").otherwise("N"))
