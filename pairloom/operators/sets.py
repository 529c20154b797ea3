"""Set operations on rows and id lists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stacked(*tables: DataFrame) -> DataFrame:
    """Union all by column name; columns a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def distinct_rows(*tables: DataFrame) -> DataFrame:
    """Union without exact duplicates."""
    return stacked(*tables).distinct()


def ids_of(df: DataFrame, column: str, out: str = "id") -> DataFrame:
    """Distinct non-null ids of a scalar or array column."""
    is_array = df.schema[column].dataType.typeName() == "array"
    value = F.explode(column) if is_array else F.col(column)
    return df.select(value.alias(out)).filter(F.col(out).isNotNull()).distinct()


def id_union(sources: Sequence[tuple[DataFrame, str]], out: str = "id") -> DataFrame:
    return reduce(lambda a, b: a.union(b), [ids_of(df, c, out) for df, c in sources]).distinct()


def id_intersection(a: tuple[DataFrame, str], b: tuple[DataFrame, str], out: str = "id") -> DataFrame:
    return ids_of(*a, out).intersect(ids_of(*b, out))
