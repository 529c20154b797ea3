"""Contiguous shards of nearly equal bytes, from prefix sums over per-partition totals; SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text plus one for its line end; a null text counts as empty."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def text_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; a null text counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def byte_shards(docs: DataFrame, n_shards: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Deal all rows into ``n_shards`` runs of the id order whose byte sizes are nearly equal.

    Rows are sorted by range over (id, checksum, size). Every range gets its total, the totals are added up to one
    offset per range, and the sum inside a range gives each row its exact place among all bytes. A row goes to the shard
    in which its middle byte lies, so a shard is off its target by at most half the largest text at either end.
    The text itself never passes a shuffle.

    Returns id, size, text_crc32, shard, slot (place in the shard, from 0). Null texts have size 1; null ids come first;
    equal rows are kept and lie next to each other; an empty table gives no rows. Other columns are not read.
    """
    slim = docs.select(
        F.col(id_column).alias("id"), text_size(F.col(text_column)).alias("size"), text_crc32(F.col(text_column)).alias("crc"),
        F.monotonically_increasing_id().alias("row"),  # lets equal rows fall into different ranges
    )
    order = ["id", "crc", "size", "row"]
    parts = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = cut_lineage(slim.repartitionByRange(int(parts), *order).withColumn("part", F.spark_partition_id()))

    # One row per range: as many as shuffle partitions, so a single task and a broadcast are in order.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    offsets = totals.select(
        "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    placed = ranged.join(F.broadcast(offsets), "part").select(
        "id", "size", "crc", "all_bytes",
        (F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("start"),
        (F.col("rows_before") + F.row_number().over(inside) - 1).alias("index"),
    )
    middle = F.expr(f"((2 * start + size) * {n_shards}) div (2 * all_bytes)")
    sharded = cut_lineage(placed.select("id", "size", "crc", "index", middle.cast("int").alias("shard")))
    first = sharded.groupBy("shard").agg(F.min("index").alias("first"))  # n_shards rows
    return sharded.join(F.broadcast(first), "shard").select(
        F.col("id").alias(id_column), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("index") - F.col("first")).alias("slot"),
    )
