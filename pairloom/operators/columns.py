"""Projections and schema operations, decided from the schema alone."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def without(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def first_columns(df: DataFrame, *first: str) -> DataFrame:
    """The named columns first, the others after them in their order."""
    return df.select(*first, *[c for c in df.columns if c not in first])


def unnest(df: DataFrame, *structs: str) -> DataFrame:
    """Replace struct columns by their fields; a null struct gives null fields."""
    kept = [c for c in df.columns if c not in structs]
    return df.select(*kept, *[f"{s}.*" for s in structs])


def columns_of_type(df: DataFrame, *kinds: str) -> list[str]:
    """Names of the columns of the given kinds: ``number``, ``bool``, ``text``, ``nested``."""
    def kind(t: T.DataType) -> str:
        if isinstance(t, NUMERIC):
            return "number"
        if isinstance(t, T.BooleanType):
            return "bool"
        if isinstance(t, (T.ArrayType, T.MapType, T.StructType)):
            return "nested"
        return "text" if isinstance(t, T.StringType) else "other"

    return [f.name for f in df.schema.fields if kind(f.dataType) in kinds]


def select_types(df: DataFrame, *kinds: str, keep: Sequence[str] = ()) -> DataFrame:
    wanted = {*keep, *columns_of_type(df, *kinds)}
    return df.select(*[c for c in df.columns if c in wanted])


def columns_like(df: DataFrame, pattern: str) -> list[str]:
    return [c for c in df.columns if re.search(pattern, c)]


def columns_with_prefix(df: DataFrame, *prefixes: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefixes)]


def numbered(df: DataFrame, array: str, prefix: str, size: int, start: int = 0) -> DataFrame:
    """Spread an array over ``size`` numbered columns."""
    return df.select(
        *[c for c in df.columns if c != array], *[F.get(array, F.lit(i)).alias(f"{prefix}{i + start}") for i in range(size)]
    )


def shared_columns(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables cut to the columns they have in common."""
    common = [c for c in a.columns if c in set(b.columns)]
    return a.select(*common), b.select(*common)


def invariant_columns(df: DataFrame, keep: Sequence[str] = ()) -> list[str]:
    """Columns with exactly one distinct non-null value, found in one pass by comparing min and max."""
    tested = [f.name for f in df.schema.fields
              if f.name not in keep and isinstance(f.dataType, (*NUMERIC, T.BooleanType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType))]
    if not tested:
        return []
    row = df.agg(*[(F.min(c) == F.max(c)).alias(c) for c in tested]).first()
    return [c for c in tested if row[c]]


def drop_invariant(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return df.drop(*invariant_columns(df, keep))
