"""Nested records: JSON files, JSON text columns, pages of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_records(spark: SparkSession, path: str, schema: StructType | str, multiline: bool = False) -> DataFrame:
    """JSON records with a declared schema: no inference pass over the files."""
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def parsed(text: Column | str, schema: StructType | str) -> Column:
    """JSON text to a typed value, null where it does not parse."""
    return F.from_json(text, schema if isinstance(schema, str) else schema.simpleString())


def flatten_pages(df: DataFrame, items: str, out: str = "item") -> DataFrame:
    """One row per item of result pages (an array column); other columns are dropped."""
    return df.select(F.explode(items).alias(out)).select(f"{out}.*")
