"""Pairs of sets that are alike: an exact similarity join by rare elements, without comparing all sets with all.

The elements of every set are put in one order, the rarest first. Two sets with a Jaccard (Tanimoto) similarity of at least t share an element among the first
n - ceil(t n) + 1 of each, n being its size (Chaudhuri et al., "A primitive operator for similarity joins in data cleaning", 2006). Only these
are looked up; sizes, and what is left behind the shared element, bound the similarity further before sets are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .joins import hot_rows, salted_join

#: Sets under one element that meet in one task; longer lists are cut in blocks that meet pair by pair.
BLOCK = 4096


def _least_overlap(a: Column, b: Column, least: float) -> Column:
    """The smallest number of shared elements of sets of sizes a and b that makes them alike; a little lower for rounding."""
    return F.ceil((a + b) * (least / (1 + least)) - 1e-9)


def distinct_sets(entries: DataFrame, set_id: str, element: str) -> DataFrame:
    """(set_id, members, size, n_ids): the different sets of a table of entries, under their smallest id, elements with the rarest first.

    ``n_ids`` is how many ids have the set. Rarity counts ids; ties go by the element. Repeated entries count once, null elements not at all,
    so ids without an element do not appear. An element that a large share of the ids has is salted.
    """
    once = cut_lineage(entries.where(F.col(element).isNotNull()).select(F.col(set_id).alias("id"), F.col(element).alias("e")).distinct())
    frequency = cut_lineage(once.groupBy("e").agg(F.count("*").alias("f")))
    ranked = salted_join(once, frequency, "e", hot_rows(frequency, "f", "e"), ["id"])
    members = F.transform(F.array_sort(F.collect_list(F.struct("f", "e"))), lambda x: x["e"])
    sets = ranked.groupBy("id").agg(members.alias("members"))
    return sets.groupBy("members").agg(F.min("id").alias(set_id), F.count("*").alias("n_ids")).select(set_id, "members", F.size("members").alias("size"), "n_ids")


def alike(entries: DataFrame, set_id: str, element: str, least: float, block: int = BLOCK) -> DataFrame:
    """(left, right, n_left, n_right, shared, similarity) for all pairs of different sets with a similarity of at least ``least``.

    Sets are given as entries (set_id, element). Ids with equal sets are one, under the smallest of them: ``n_left`` and ``n_right`` say
    how many ids stand behind each side, ``left`` < ``right``. Nothing is lost: an element that many sets have among their rare ones is cut
    in blocks of sets, and every two blocks meet in a task of their own.
    """
    if not 0 < least <= 1:
        raise ValueError("the similarity must be above 0 and at most 1")
    sets = cut_lineage(distinct_sets(entries, set_id, element))
    n = F.col("size")
    prefix = (n - F.ceil(n * least - 1e-9) + 1).cast("int")
    listed = sets.select(F.col(set_id).alias("id"), "members", "size", "n_ids", F.posexplode(F.slice("members", F.lit(1), prefix)).alias("place", "e"))
    many = listed.groupBy("e").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = listed.join(many, "e")
    own, all_ = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.explode(F.transform(F.sequence(F.lit(1), F.col("blocks")), lambda i: i - 1))

    def side(name: str, mine: str, other: str) -> DataFrame:
        rows = dealt.withColumn(mine, own).withColumn(other, all_)
        return rows.select("e", "x", "y", *[F.col(c).alias(f"{c}_{name}") for c in ("id", "members", "size", "n_ids", "place")])

    met = side("a", "x", "y").join(side("b", "y", "x"), ["e", "x", "y"])
    small, large = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    wanted = _least_overlap(F.col("size_a"), F.col("size_b"), least)
    behind = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))  # elements from the one they meet under
    near = met.where((F.col("id_a") < F.col("id_b")) & (small >= large * least - 1e-9) & (behind >= wanted))
    both = near.withColumn("both", F.array_intersect("members_a", "members_b"))
    # A pair meets under every rare element that both share; it counts under the first, which is the first of all they share.
    first = both.where(F.get("both", F.lit(0)).eqNullSafe(F.col("e")))
    shared = F.size("both")
    return first.withColumn("shared", shared).where(F.col("shared") >= wanted).select(
        F.col("id_a").alias("left"), F.col("id_b").alias("right"), F.col("n_ids_a").alias("n_left"), F.col("n_ids_b").alias("n_right"), "shared",
        (F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared"))).alias("similarity"),
    ).where(F.col("similarity") >= least - 1e-12)
