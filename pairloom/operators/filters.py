"""Row filters with the null rules of the labelling workflow: a comparison with null is false, never unknown."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def known_and(condition: Column) -> Column:
    """A condition that reads unknown as false, for use under ``~`` and ``|``."""
    return F.coalesce(condition, F.lit(False))


def available(df: DataFrame, availability: str = "availability_type", withdrawn: str = "withdrawn_flag", rule: str = "open") -> DataFrame:
    """Marketable entities.

    ``open`` keeps a positive availability, or an unknown one that is not withdrawn, or an unknown flag;
    ``strict`` needs a positive availability and a flag that says "not withdrawn".
    """
    positive = known_and(F.col(availability) > 0)
    standing = known_and(~F.col(withdrawn))
    if rule == "strict":
        return df.filter(positive & standing)
    if rule == "open":
        return df.filter(positive | (F.col(availability).isNull() & standing) | F.col(withdrawn).isNull())
    raise ValueError(f"unknown rule {rule!r}")


def members_of(df: DataFrame, key: str, ids: DataFrame, id_column: str | None = None) -> DataFrame:
    """Rows whose key occurs in another table; the id list is never collected."""
    wanted = ids.select(F.col(id_column or key).alias(key))
    return df.join(wanted, key, "left_semi")


def overlapping(df: DataFrame, row_id: str, array: str, ids: DataFrame, id_column: str) -> DataFrame:
    """Rows with at least one array element in another table."""
    wanted = ids.select(F.col(id_column).alias("_member"))
    hits = (
        df.select(row_id, F.explode(F.array_distinct(array)).alias("_member"))
        .join(wanted, "_member", "left_semi")
        .select(row_id)
    )
    return df.join(hits, row_id, "left_semi")


def beyond(df: DataFrame, score: str, limit: float, name: str) -> DataFrame:
    """All rows of the entities that pass a score limit in at least one row (outliers back to their source)."""
    return members_of(df, name, df.filter(F.col(score) > limit).select(name))


def in_ranges(df: DataFrame, ranges: Mapping[str, tuple[object | None, object | None]]) -> DataFrame:
    """Rows whose value at every path (``struct.field`` to any depth) lies between two bounds, ends included; None is no bound.

    A null anywhere on a path fails its range. Conditions name the fields themselves, so a nested file is read
    only along the paths that are used, and skips row groups by the statistics of the fields.
    """
    for path, (low, high) in ranges.items():
        if low is not None:
            df = df.where(F.col(path) >= F.lit(low))
        if high is not None:
            df = df.where(F.col(path) <= F.lit(high))
    return df
