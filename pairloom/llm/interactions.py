"""How filters overlap: forward and backward path counts over the lattice of filters already applied.

A document that fails the set F of filters is removed, in any order of the filters, by the first filter of F. So all that an
order does follows from one small table, the number of documents for each set of failed filters. The states of the lattice
are the sets of filters applied so far; an edge applies one more filter and removes the documents that fail it and none before.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: All orders are listed, so their number, the factorial of the filters', must stay small.
MOST_FILTERS = 7


def lattice_paths(k: int) -> list[tuple[int, int, int, int]]:
    """(state, filter, reach, leave) for every edge: the orders that come to the state, and those that go on behind the edge.

    States are bit sets of the filters applied. ``reach`` is added up from the empty state forwards, ``leave`` from the
    full state backwards; reach * leave orders use the edge.
    """
    full = (1 << k) - 1
    reach, leave = [0] * (full + 1), [0] * (full + 1)
    reach[0] = leave[full] = 1
    for state in range(full + 1):  # every state comes after those it is reached from
        for f in range(k):
            if not state >> f & 1:
                reach[state | 1 << f] += reach[state]
    for state in range(full, -1, -1):
        for f in range(k):
            if state >> f & 1:
                leave[state ^ 1 << f] += leave[state]
    return [(s, f, reach[s], leave[s | 1 << f]) for s in range(full + 1) for f in range(k) if not s >> f & 1]


def lattice_steps(spark: SparkSession, names: str) -> DataFrame:
    """(state, bit, filter_order, step): the edge that every order takes at each step; k * k! rows."""
    rows = []
    for order in permutations(range(len(names))):
        state = 0
        for step, f in enumerate(order, 1):
            rows.append((state, 1 << f, "".join(names[i] for i in order), step))
            state |= 1 << f
    return spark.createDataFrame(rows, "state int, bit int, filter_order string, step int")


def failed_sets(docs: DataFrame, labels: DataFrame, conditions: Sequence[Column], id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of each part fail just the filters of a bit set.

    ``conditions`` are the failures of the filters, conditions on the column ``text`` (never null), in the order of their bits. Copies
    are the last filter, with the next bit: a row fails it if a row with a smaller id has the same text anywhere in the table. Texts are compared by two
    64-bit hashes and never shuffled. Rows of a text are counted by part and label before they meet, so a group of copies with
    any share of the rows is a few rows in its task.

    Null texts are empty and equal each other; a null part is the part ""; a row without an id has no smaller one and is
    nobody's, so it is no copy; rows that share id and text are not smaller than each other. Labels are looked up by id, repeated labels
    count as good or toxic if one of them says so. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    read = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(part_column), F.lit("")).alias("part"), text.alias("text"))
    bits = [F.when(failure, F.lit(1 << i)).otherwise(F.lit(0)) for i, failure in enumerate(conditions)]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit)
    slim = read.select("id", "part", mask.alias("mask"), F.xxhash64("text").alias("t"), F.xxhash64(F.lit(1), "text").alias("u"))
    counted = cut_lineage(slim.groupBy("id", "part", "mask", "t", "u").agg(F.count(F.lit(1)).alias("n")))

    marks = labels.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    plain = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    named = counted.where("id IS NOT NULL").join(marks, "id", "left").select("id", "part", "mask", "t", "u", "n", *plain)
    groups = named.groupBy("t", "u", "mask", "part", "good", "toxic").agg(F.min("id").alias("low"), F.min_by("n", "id").alias("n_low"), F.sum("n").alias("n"))
    least = F.min("low").over(Window.partitionBy("t", "u"))
    first = F.when(F.col("low") == least, F.col("n_low")).otherwise(F.lit(0))
    split = groups.withColumn("first", first).select("part", "mask", "good", "toxic", "first", (F.col("n") - F.col("first")).alias("copy"))
    kinds = F.explode(F.array(F.struct(F.col("mask"), F.col("first").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(1 << len(conditions))).alias("mask"), F.col("copy").alias("n"))))
    told = split.select("part", "good", "toxic", kinds.alias("kind")).select("part", "good", "toxic", "kind.*")
    nameless = counted.where("id IS NULL").select("part", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "mask", "n")
    either = told.unionByName(nameless).groupBy("part", "mask").agg(
        F.sum("n").cast("long").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(F.lit(0))).cast("long").alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(F.lit(0))).cast("long").alias("toxic"))
    return cut_lineage(either)


def audit(failed: DataFrame, names: str, part: str = "part") -> DataFrame:
    """What every filter does at every step of every order: one row per part, filter_order and step.

    ``failed`` has rows (part, mask, n, good, toxic): how many documents of a part fail just the filters in the bit set
    ``mask`` (bit i is filter ``names[i]``), and how many of these are marked good or toxic; a mask may come in
    several rows. Columns: kept, removed, redundant, unique_fails, good_lost, toxic_lost, and shapley, the sum of ``removed`` of the
    step's filter over all orders: the removals of its edges, weighted by their paths. All are 0 where nothing is counted;
    a part without rows does not appear. Per part at most 2 ** k sums meet in a row, whatever the number of documents.
    """
    k = len(names)
    if len(set(names)) != k or not 0 < k <= MOST_FILTERS:
        raise ValueError(f"names must be 1 to {MOST_FILTERS} different letters")
    sums = failed.groupBy(part, "mask").agg(*[F.sum(c).cast("long").alias(c) for c in ("n", "good", "toxic")])
    cells = sums.groupBy(part).agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    edges = F.array(*[
        F.struct(F.lit(state).alias("state"), F.lit(1 << f).alias("bit"), F.lit(names[f]).alias("letter"), F.lit(reach * leave).cast("long").alias("paths"))
        for state, f, reach, leave in lattice_paths(k)
    ])
    rows = cells.withColumn("edge", F.explode(edges)).select(part, "cells", "edge.*")

    def total(value: str, takes) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda sum_, c: sum_ + F.when(takes(c["mask"]), c[value]).otherwise(F.lit(0)))

    state, bit = F.col("state"), F.col("bit")
    passed = lambda mask: mask.bitwiseAND(state) == 0
    fails = lambda mask: mask.bitwiseAND(bit) != 0
    taken = lambda mask: passed(mask) & fails(mask)
    counted = rows.select(
        part, "state", "bit", "letter", "paths", total("n", lambda m: passed(m) & ~fails(m)).alias("kept"), total("n", taken).alias("removed"),
        total("n", lambda m: ~passed(m) & fails(m)).alias("redundant"), total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", taken).alias("good_lost"), total("toxic", taken).alias("toxic_lost"),
    ).withColumn("shapley", F.sum(F.col("removed") * F.col("paths")).over(Window.partitionBy(part, "letter")))
    steps = lattice_steps(failed.sparkSession, names)  # k * k! rows
    return counted.join(F.broadcast(steps), ["state", "bit"]).select(
        part, "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
