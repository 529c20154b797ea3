"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, cut_slim


def _towards_least(edges: DataFrame) -> DataFrame:
    """Links of every node to larger ones move to its least neighbour (or itself)."""
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    least = both.groupBy("x").agg(F.min("y").alias("low")).select("x", F.least("x", "low").alias("low"))
    moved = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("low").alias("v"))
    return moved.distinct()


def _through_least(edges: DataFrame) -> DataFrame:
    """The smaller neighbours of every node are linked with the least of them instead."""
    least = edges.groupBy("u").agg(F.min("v").alias("low"))
    moved = edges.join(least, "u").where("v > low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(least.select("u", F.col("low").alias("v"))).distinct()


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): component is the least node that can be reached.

    Each round writes its links to the shared folder, in files by number of links (at first by ``rows``, the number of nodes, if it is given).
    Links from a node to itself and repeated links do no harm; null ends are ignored; nodes without links to others do not appear. The number of rounds grows with the logarithm of the longest path.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = cut_lineage(edges) if rows is None else cut_slim(edges, rows)
    digest = (F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")))
    before = edges.agg(*digest).first()
    while before[0]:
        edges = cut_slim(_through_least(_towards_least(edges)), before[0])
        now = edges.agg(*digest).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
