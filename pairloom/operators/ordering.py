"""Order-dependent operators: keep-first, top-k, global positions, splits and running totals.

Every order ends in a unique column given by the caller, so results do not depend on how rows are spread.
Nothing here uses an unpartitioned window over table-sized data: global positions come from a range-partitioned
sort whose partition sizes (one number per partition) are summed up.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage, cut_slim
from .joins import hot_rows, salted_join
from .selection import rows_at

ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its low 33 bits


def keep_first(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """First row of every key in the given order.

    The filter on the row number is pushed below the shuffle (one row per key and task), so a hot key is cheap.
    """
    return top_k(df, keys, 1, *order)


def top_k(df: DataFrame, keys: Sequence[str], k: int, *order: Column | str, rank: str | None = None) -> DataFrame:
    """First ``k`` rows of every key in the given order."""
    window = W.partitionBy(*keys).orderBy(*order)
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k > limit:
        # Too many rows for the built-in group limit: thin out each of several parts of a key first. Any parts will do.
        parts = F.pmod(F.monotonically_increasing_id(), F.lit(64))
        df = (
            df.withColumn("_part", parts)
            .withColumn("_rank", F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*order)))
            .filter(F.col("_rank") <= k)
            .drop("_part", "_rank")
        )
    ranked = df.withColumn(rank or "_rank", F.row_number().over(window)).filter(F.col(rank or "_rank") <= k)
    return ranked if rank else ranked.drop("_rank")


def top_items(items: Column | str, n: int, score: str) -> Column:
    """The ``n`` best structs of an array by one of their fields, best first; ties keep their array order."""
    ordered = F.array_sort(items, lambda a, b: F.when(a[score] > b[score], -1).when(a[score] < b[score], 1).otherwise(0))
    return F.slice(ordered, 1, n)


def _sorted_parts(df: DataFrame, order: Sequence[Column | str], rows: int | None = None) -> DataFrame:
    """Rows sorted over the whole table, written once (in few files, if about ``rows`` are known to come), with their partition and place in it."""
    placed = df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = cut_lineage(placed) if rows is None else cut_slim(placed, rows)
    return placed.withColumns(
        {"_part": F.shiftright("_place", ROW_BITS), "_row": F.col("_place").bitwiseAND(F.lit((1 << ROW_BITS) - 1))}
    ).drop("_place")


def row_index(df: DataFrame, *order: Column | str, name: str = "row_index", rows: int | None = None) -> DataFrame:
    """Dense position 0..n-1 of every row in the given total order. ``rows``: about how many there are, if that is known."""
    parts = _sorted_parts(df, order, rows)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    joined = parts.join(F.broadcast(starts), "_part")
    return joined.withColumn(name, F.col("_start") + F.col("_row")).drop("_part", "_row", "_start")


def running_totals(df: DataFrame, order: Sequence[Column | str], totals: Mapping[str, str]) -> DataFrame:
    """Cumulative sums in a total order, in two levels: inside each sorted part, then over the parts.

    ``totals`` names each output and the column it adds up.
    """
    parts = _sorted_parts(df, order)
    sums = parts.groupBy("_part").agg(*[F.sum(c).alias(f"_s_{o}") for o, c in totals.items()])
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    starts = sums.select("_part", *[F.coalesce(F.sum(f"_s_{o}").over(before), F.lit(0)).alias(f"_b_{o}") for o in totals])
    inside = W.partitionBy("_part").orderBy("_row").rowsBetween(W.unboundedPreceding, 0)
    out = parts.join(F.broadcast(starts), "_part")
    out = out.select(*df.columns, *[(F.sum(c).over(inside) + F.col(f"_b_{o}")).alias(o) for o, c in totals.items()])
    return out


def group_places(counted: DataFrame, key: str, value: str, n: str) -> DataFrame:
    """Add to each counted value of a group how many of the group's rows come before it, and the group's size.

    ``counted`` has one row per (key, value) with its number of rows ``n``. Positions come from one global
    running total, so even a group with most of the rows is spread over many tasks.
    """
    runs = running_totals(counted, [key, value], {"_cum": n})
    groups = runs.groupBy(key).agg(
        F.min(F.col("_cum") - F.col(n)).alias("_first"), F.sum(n).alias("group_size"), F.count("*").alias("_values")
    )
    placed = salted_join(runs, groups.drop("_values"), key, hot_rows(groups, "_values", key), [value])
    return placed.withColumn("before", F.col("_cum") - F.col(n) - F.col("_first")).drop("_cum", "_first")


def median_part(value: Column | str, n: Column | str) -> Column:
    """Summed over a group of ``group_places``, this is the group's exact (interpolating) median."""
    value, n = (F.col(c) if isinstance(c, str) else c for c in (value, n))
    before, size = F.col("before"), F.col("group_size")

    def covers(place: Column) -> Column:
        return ((before <= place) & (place < before + n)).cast("int")

    return value * (covers(F.floor((size - 1) / 2)) + covers(F.floor(size / 2))) / 2


def shuffle_key(row_id: Column | str, seed: int) -> Column:
    """Seeded pseudo-random sort key of an id; the same on every engine and every run."""
    return F.md5(F.concat(F.col(row_id).cast("string") if isinstance(row_id, str) else row_id, F.lit(f":{seed}")))


def key_batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """Group an ordered key list in batches of ``size`` keys (one row per batch)."""
    placed = row_index(df.select(key).distinct(), key, name="_i")
    batch = F.floor(F.col("_i") / size).alias("batch")
    return placed.groupBy(batch).agg(F.array_sort(F.collect_list(key)).alias("keys"))


def _order_key(order: Sequence[Column | str]) -> Column:
    return F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"key{i}") for i, c in enumerate(order)])


def time_split(df: DataFrame, *order: Column | str, train: float = 0.85) -> DataFrame:
    """Mark the first ``floor(n * train)`` rows of an ascending order as train, the rest as test.

    The row at the cut is found by counting (see ``selection``) and every row is compared with it in place: nothing is sorted, shuffled or written.
    """
    cut = rows_at(df, None, [floor(df.count() * train)], order).first()
    if cut is None:
        return df.withColumn("part", F.lit("train"))
    first_test = F.struct(*[F.lit(v).alias(f"key{i}") for i, v in enumerate(cut["key"])])
    return df.withColumn("part", F.when(_order_key(order) < first_test, "train").otherwise("test"))


def value_at(df: DataFrame, column: str, fraction: float, *order: Column | str) -> DataFrame:
    """The value that stands at position ``floor(n * fraction)`` of an ascending order, found by counting."""
    return rows_at(df, None, [floor(df.count() * fraction)], order, [column]).select(column)


def _passed_cuts(df: DataFrame, label: str, cuts: Column, order: Sequence[Column | str], name: str) -> DataFrame:
    """Add how many of its class's cuts each row has reached; ``cuts`` makes the positions from the class size ``_size``.

    The rows at the cuts are found by counting. Every row is compared with those of its class; the join is planned from the size of
    the class table, which is small however many rows a class has.
    """
    classes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_size")).select(label, F.posexplode(cuts).alias("slot", "position"))
    found = rows_at(df, label, classes, order).groupBy(F.col(label).alias("_class")).agg(F.collect_list("key").alias("_cuts"))
    joined = df.join(found, F.col(label).eqNullSafe(F.col("_class")), "left").withColumn("_key", _order_key(order))
    passed = F.size(F.filter("_cuts", lambda c: F.col("_key") >= c))
    return joined.withColumn(name, F.when(F.col("_cuts").isNull(), 0).otherwise(passed)).drop("_class", "_cuts", "_key")


def stratified_split(df: DataFrame, label: str, row_id: str, train: float = 0.85, seed: int = 42) -> DataFrame:
    """Random split with the same share of every class: exactly ``floor(size * train)`` train rows per class."""
    at = F.array(F.floor(F.col("_size") * F.lit(train)))
    placed = _passed_cuts(df, label, at, [shuffle_key(row_id, seed), F.col(row_id)], "_passed")
    return placed.withColumn("part", F.when(F.col("_passed") == 0, "train").otherwise("test")).drop("_passed")


def stratified_folds(df: DataFrame, label: str, folds: int, *order: Column | str, name: str = "fold") -> DataFrame:
    """Fold number per row: contiguous blocks of each class in the given ascending order, as equal in size as can be."""
    # Position k of a class of n rows is in fold floor(k * folds / n), so fold f begins at the first k of at least f * n / folds.
    at = F.transform(F.sequence(F.lit(1), F.lit(max(folds - 1, 1))), lambda f: F.ceil(f * F.col("_size") / F.lit(folds)))
    if folds < 2:
        return df.withColumn(name, F.lit(0))
    return _passed_cuts(df, label, at, order, name)


def rolling_mean(df: DataFrame, order: str, columns: Sequence[str], rows: int = 4) -> DataFrame:
    """Trailing mean over the last ``rows`` rows, fewer at the start; a null group comes last and counts as a row.

    Meant for tables already reduced to one row per period: the window is not partitioned.
    """
    frame = W.orderBy(F.col(order).asc_nulls_last()).rowsBetween(1 - rows, 0)
    return df.withColumns({c: F.avg(c).over(frame) for c in columns})
