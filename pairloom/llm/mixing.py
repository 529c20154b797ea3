"""Mixing sources to target weights by systematic sampling: prefix sums of expected copies, one offset a source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import row_index, running_totals
from ..session import cut_lineage

#: Expected copies are whole numbers of 2 ** -24, so that their sums are exact in any order.
TICK_BITS = 24
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of words of a text, without an array of them; a null text has none."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.translate(marks, SPACES, "")).cast("long")


def hex_number(text: Column, digits: int) -> Column:
    """The first hex digits of the MD5 of a text as a number; the same on every engine."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """(source, source_size, target, ticks): how much each source gives, in the unit of its size, and copies expected of each document.

    Sources in code point order, null last, take the ``weights`` in turn and share ``share`` times all sizes. None gets more than
    ``most`` times its size; what it leaves is shared by weight among the others, until none is above. Sharing again and
    again ends at one level per unit of weight: with the sources in order of cap over weight, it is the largest of
    (what is left after the caps before) / (weight from here on), and a target is the lesser of the cap and the level.
    Sources of size 0 get 0. There may be any number of sources.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = row_index(totals, F.col("source").asc_nulls_last(), name="at")
    turns = F.array(*[F.lit(int(w)) for w in weights])
    weighed = numbered.select("source", "source_size", "at", F.element_at(turns, (F.col("at") % len(weights) + 1).cast("int")).cast("long").alias("weight"))
    capped = cut_lineage(weighed.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight")))
    every = capped.agg(F.sum("source_size"), F.sum("weight")).first()
    size, weight = every[0] or 0, every[1] or 0
    runs = running_totals(capped, ["ratio", "at"], {"caps": "cap", "weights": "weight"})
    level = (F.lit(share * size) - (F.col("caps") - F.col("cap"))) / (F.lit(weight) - (F.col("weights") - F.col("weight")))
    highest = runs.agg(F.max(level)).first()[0] or 0.0
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(highest))
    ticks = F.when(F.col("source_size") > 0, F.floor(target / F.col("source_size") * (1 << TICK_BITS) + 0.5)).otherwise(F.lit(0))
    return cut_lineage(capped.select("source", "source_size", target.alias("target"), ticks.cast("long").alias("ticks")))


def copies_of(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 42,
    id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
) -> DataFrame:
    """How often the mix takes each document: (id, text_key, size, source, source_size, target, copies), a row for each row of ``docs``.

    Inside a source, rows stand in order of size, rows of one size in a seeded random order. Their expected copies are added up over
    this order, on top of one random offset below 1 a source, and a row is taken once for every whole number its part of the sum
    crosses: the copies of a row differ from the expected ones by less than 1 and never pass ``most``. Because sizes rise along the order, the words taken
    of a source are off its target by no more than its largest document.

    The order is cut in ranges of rows: a source with any share of the rows lies in many of them, and only sums by
    range and source meet. Texts pass no shuffle. Null texts have size 0; a null source is a source of its own, the last; rows
    without an id or with a repeated one are rows like others; equal rows are interchangeable; an empty table gives no rows.
    Other columns are not read. The same table and seed give the same copies, however it is partitioned.
    """
    named = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    slim = cut_lineage(docs.select(
        F.col(id_column).alias("id"), F.col(source_column).alias("source"), word_count(F.col(text_column)).alias("size"),
        hex_number(F.concat(named, F.lit(f":{seed}")), 15).alias("tie"), F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("text_key"),
        F.monotonically_increasing_id().alias("row"),  # lets equal rows fall into different ranges
    ))
    targets = source_targets(slim, weights, share, most)
    same = slim["source"].eqNullSafe(targets["source"])
    expected = slim.join(targets, same).select(slim["*"], "source_size", "target", "ticks")
    order = [F.col("source").asc_nulls_last(), "size", "tie", F.col("id").asc_nulls_first(), "text_key", "row"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(expected.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))

    # At most one row a range more than there are sources; a source has at most one a range.
    sums = ranged.groupBy("source", "part").agg(F.sum("ticks").alias("ticks"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = hex_number(F.concat(F.coalesce("source", F.lit("")), F.lit(f":{seed}")), TICK_BITS // 4)
    starts = sums.select(F.col("source").alias("_source"), F.col("part").alias("_part"), (offset + F.coalesce(F.sum("ticks").over(earlier), F.lit(0))).alias("_start"))
    inside = Window.partitionBy("source", "part").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn("_end", F.sum("ticks").over(inside))
    placed = summed.join(starts, (F.col("part") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source")))
    end = F.col("_start") + F.col("_end")
    copies = F.shiftright(end, TICK_BITS) - F.shiftright(end - F.col("ticks"), TICK_BITS)
    return placed.select(F.col("id").alias(id_column), "text_key", "size", F.col("source").alias(source_column), "source_size", "target", copies.alias("copies"))


def mixed(docs: DataFrame, copies: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as ``copies`` (of ``copies_of``) takes them; all columns are kept.

    Rows with the same id, source and text are told apart by nothing, so their copies are added up and given by one of them.
    """
    keys = [id_column, source_column, "text_key"]
    sums = copies.groupBy(*keys).agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("rows")).where("n > 0").toDF("_id", "_source", "_key", "_n", "_rows")
    own = F.xxhash64(F.coalesce(F.col(text_column), F.lit("")))
    found = docs.join(sums, F.col(id_column).eqNullSafe(F.col("_id")) & F.col(source_column).eqNullSafe(F.col("_source")) & (own == F.col("_key")))
    once = found.where("_rows = 1").unionByName(found.where("_rows > 1").dropDuplicates(["_id", "_source", "_key"]))
    return once.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(docs.columns)
