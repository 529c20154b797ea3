"""Parquet tables by name, exports, and materialize-or-reuse."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A stored table, or None when it has not been written."""
    try:
        return spark.read.parquet(f"{folder}/{name}")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def save_table(df: DataFrame, folder: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_catalog(spark: SparkSession, folder: str, names: Sequence[str], views: bool = False) -> dict[str, DataFrame | None]:
    """All named tables of a folder, read lazily; ``views`` also registers them for SQL."""
    tables = {name: load_table(spark, folder, name) for name in names}
    if views:
        for name, df in tables.items():
            if df is not None:
                df.createOrReplaceTempView(name)
    return tables


# Names of the raw and the processed tables.
RAW_TABLES = ["drugs", "diseases", "indications", "mechanisms", "targets", "trials"]
PROCESSED_TABLES = ["drugs", "diseases", "trials", "indications", "embeddings"]


def load_drugs(spark: SparkSession, folder: str) -> DataFrame | None:
    return load_table(spark, folder, "drugs")


def load_diseases(spark: SparkSession, folder: str) -> DataFrame | None:
    return load_table(spark, folder, "diseases")


def load_trials(spark: SparkSession, folder: str) -> DataFrame | None:
    return load_table(spark, folder, "trials")


def load_indications(spark: SparkSession, folder: str) -> DataFrame | None:
    return load_table(spark, folder, "indications")


def load_embeddings(spark: SparkSession, folder: str) -> DataFrame | None:
    return load_table(spark, folder, "embeddings")


def flat_for_csv(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, since CSV has only scalars."""
    nested = ("array", "map", "struct")
    return df.select(*[
        F.to_json(f.name).alias(f.name) if f.dataType.typeName() in nested else F.col(f.name) for f in df.schema.fields
    ])


def export_pairs(df: DataFrame, folder: str, name: str) -> None:
    """The pair table as Parquet and as CSV with a header."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    flat_for_csv(df).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")


def export_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """A graph as two tables, partitioned by kind so that one kind can be read alone."""
    nodes.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/edges")


def materialize(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """Read a table if it has been written completely, else build, write and read it."""
    if not force:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/_SUCCESS")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return spark.read.parquet(f"{folder}/{name}")
    save_table(build(), folder, name)
    return spark.read.parquet(f"{folder}/{name}")
