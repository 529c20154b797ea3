"""Rows at given positions of an order, without sorting the table: counts by bucket, then on into the bucket that holds the position.

An order is a list of ascending expressions, nulls first, ending in a unique one. Each becomes one or more numbers that sort alike. The numbers are
taken in turn: a round counts the rows still in question by at most a thousand or so equal ranges of the number, and keeps, for each position wanted, the range it
lies in. Counts are combined before the shuffle and nothing of the table is written. A round narrows a range a thousandfold; when few
rows are left in it they are sorted. Any number of groups and of positions go through the same rounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

#: Buckets of a round are 2 ** BUCKET_BITS or half as many.
BUCKET_BITS = 10
#: So few rows of a range are sorted instead of counted again.
FEW_ROWS = 256
CHUNK_BYTES = 7


def _numbers(rows: DataFrame, n_keys: int) -> list[Column]:
    """Numbers, whole or double, whose order, one after the other, is that of the keys ``_key0`` on; never null, infinite or NaN."""
    found: list[Column] = []
    for i in range(n_keys):
        key, kind = F.col(f"_key{i}"), rows.schema[f"_key{i}"].dataType
        given = key.isNotNull().cast("long")
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            found.append(F.when(key.isNull(), 0).when(F.isnan(key), 4).when(key == float("inf"), 3).when(key == float("-inf"), 1).otherwise(2).cast("long"))
            found.append(F.when(F.isnan(key) | (F.abs(key) == float("inf")), 0.0).otherwise(F.coalesce(key.cast("double"), F.lit(0.0))))
            continue
        if isinstance(kind, (T.StringType, T.BinaryType)):
            raw = F.coalesce(key.cast("binary"), F.lit("").cast("binary"))
            longest = rows.agg(F.max(F.octet_length(raw))).first()[0] or 0
            chunks = [F.rpad(F.hex(F.substring(raw, at, CHUNK_BYTES)), 2 * CHUNK_BYTES, "0") for at in range(1, longest + 1, CHUNK_BYTES)]
            # Of texts that agree up to trailing zero bytes, the shorter is first.
            found += [given, *[F.conv(c, 16, 10).cast("long") for c in chunks], F.octet_length(raw).cast("long")]
            continue
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            number = key.cast("long")
        elif isinstance(kind, T.BooleanType):
            number = key.cast("int").cast("long")
        elif isinstance(kind, T.DateType):
            number = F.unix_date(key).cast("long")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            number = F.unix_micros(key.cast("timestamp"))
        elif isinstance(kind, T.DecimalType) and kind.precision <= 18:
            number = (key * F.lit(10**kind.scale)).cast("long")
        else:
            raise TypeError(f"cannot select in an order of {kind.simpleString()}")
        found += [given, F.coalesce(number, F.lit(0).cast("long"))]
    return found


def _magnitude(number: Column) -> Column:
    """Never falls as a double rises; about its power of two, so that numbers of all sizes are spread out."""
    return F.when(number == 0, 0.0).otherwise(F.signum(number) * (F.log2(F.abs(number)) + 1076))


def _bucket(number: Column, low: Column, high: Column, whole: bool) -> Column:
    """Bucket of a number between low and high, which fall into different ones; never falling as the number rises.

    Ranges of doubles over several powers of two are cut by magnitude, closer ones evenly.
    """
    if whole:
        bits = F.greatest(F.lit(0), F.ceil(F.log2(high.cast("double") - low.cast("double") + 1)) - BUCKET_BITS).cast("int")
        return F.call_function("shiftright", number, bits)
    span = _magnitude(high) - _magnitude(low)
    share = F.when(span > 8, (_magnitude(number) - _magnitude(low)) / span).otherwise((number - low) / (high - low))
    return F.floor(share * (1 << BUCKET_BITS))


def rows_at(df: DataFrame, group: str | None, wanted: DataFrame | Sequence[int], order: Sequence[Column | str], keep: Sequence[str] = ()) -> DataFrame:
    """(group, slot, key, and the columns ``keep``) of the rows at wanted positions of every group, in the given order.

    ``wanted`` has (group, slot, position), with positions from 0; without a group it is a list of positions, numbered as slots. ``key`` is the struct
    of the order's values: ``struct(order) >= key`` holds from that row on. Positions beyond a group's rows have no row; a null group is a group. Rows
    with equal keys, which an order should not have, are one place, held by the least of their kept values.
    The table is read once a round; hand in a stored table if it is dear to compute.
    """
    named = [(F.col(c) if isinstance(c, str) else c).alias(f"_key{i}") for i, c in enumerate(order)]
    kept = [f"_keep{i}" for i in range(len(keep))]
    own = F.lit(0) if group is None else F.col(group)
    rows = df.select(own.alias("_of"), *named, *[F.col(c).alias(k) for c, k in zip(keep, kept)])
    numbers = _numbers(rows, len(named))
    whole = [isinstance(f.dataType, T.LongType) for f in rows.select(*[n.alias(f"_c{i}") for i, n in enumerate(numbers)]).schema]
    if group is None:
        wanted = df.sparkSession.createDataFrame([(0, i, int(p)) for i, p in enumerate(wanted)], "_group int, _slot int, _want long")
    else:
        wanted = wanted.select(F.col(group).alias("_group"), F.col("slot").alias("_slot"), F.col("position").cast("long").alias("_want"))

    ends = [f(n).alias(f"_{name}{i}") for i, n in enumerate(numbers) for f, name in ((F.min, "low"), (F.max, "high"))]
    groups = rows.groupBy("_of").agg(F.count(F.lit(1)).alias("_n"), *ends)
    # For every group and slot: the position inside the range in question, how many rows the range has, and its ends.
    state = cut_lineage(wanted.join(groups, F.col("_group").eqNullSafe(F.col("_of"))).where("_want >= 0 AND _want < _n").drop("_of"))
    narrowed: list[int] = []

    def in_question(ranges: DataFrame) -> DataFrame:
        found = rows.join(ranges, F.col("_of").eqNullSafe(F.col("_group"))).drop("_of")
        for i in narrowed:
            found = found.where(numbers[i].between(F.col(f"_low{i}"), F.col(f"_high{i}")))
        return found

    for i, number in enumerate(numbers):
        low, high = F.col(f"_low{i}"), F.col(f"_high{i}")
        while True:
            wide = state.where((F.col("_n") > FEW_ROWS) & (low < high))
            if not wide.head(1):
                break
            counted = in_question(wide).groupBy("_group", "_slot", "_want", _bucket(number, low, high, whole[i]).alias("_bucket")).agg(
                F.count(F.lit(1)).alias("_rows"), F.min(number).alias("_least"), F.max(number).alias("_most"))
            upto = F.sum("_rows").over(W.partitionBy("_group", "_slot").orderBy("_bucket"))
            chosen = counted.withColumn("_upto", upto).where("_want < _upto AND _want >= _upto - _rows").select(
                F.col("_group").alias("_g"), F.col("_slot").alias("_s"), (F.col("_want") - F.col("_upto") + F.col("_rows")).alias("_left"), "_rows", "_least", "_most")
            beside = state.join(chosen, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_slot") == F.col("_s")), "left")
            state = cut_lineage(beside.withColumns({
                "_want": F.coalesce("_left", "_want"), "_n": F.coalesce("_rows", "_n"), f"_low{i}": F.coalesce("_least", low), f"_high{i}": F.coalesce("_most", high),
            }).drop("_g", "_s", "_left", "_rows", "_least", "_most"))
            if i not in narrowed:
                narrowed.append(i)

    key = F.struct(*[F.col(f"_key{i}").alias(f"key{i}") for i in range(len(named))])
    left = in_question(state).select("_group", "_slot", "_want", "_n", F.struct(key.alias("key"), *kept).alias("_row"))
    place = F.row_number().over(W.partitionBy("_group", "_slot").orderBy("_row")) - 1
    few = left.where(F.col("_n") <= FEW_ROWS).withColumn("_place", place).where("_place = _want").select("_group", "_slot", "_row")
    equal = left.where(F.col("_n") > FEW_ROWS).groupBy("_group", "_slot").agg(F.min("_row").alias("_row"))
    out = [] if group is None else [F.col("_group").alias(group)]
    return few.unionByName(equal).select(*out, F.col("_slot").alias("slot"), "_row.key", *[F.col(f"_row.{k}").alias(c) for k, c in zip(kept, keep)])
