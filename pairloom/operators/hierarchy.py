"""Path hierarchies (``C20.111.197``): depth, descendants, members of a named root.

A node is matched to its ancestors by listing the prefixes of its own path and joining on equality;
comparing every path with every other one would be a nested-loop join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import distinct_prefixes
from ..functions.text import first_part, path_depth
from .joins import look_up


def descendant_counts(nodes: DataFrame, path: str, separator: str = ".", out: str = "descendants") -> DataFrame:
    """Rows whose path starts with each node's path, the node's own rows included.

    Every path is counted once per row before it is spread to its ancestors, so the root is no hot group.
    """
    counted = nodes.groupBy(path).agg(F.count("*").alias("_n"))
    spread = counted.select(F.explode(distinct_prefixes(path, separator)).alias(path), "_n")
    totals = spread.groupBy(path).agg(F.sum("_n").alias(out))
    return nodes.join(totals, path)


def root_members(nodes: DataFrame, roots: DataFrame, node_id: str, path: str, separator: str = ".") -> DataFrame:
    """Distinct ids of all nodes under any of the given root paths, the roots included."""
    prefixes = nodes.select(node_id, F.explode(distinct_prefixes(path, separator)).alias("_root"))
    wanted = roots.select(F.col(path).alias("_root")).distinct()
    return prefixes.join(wanted, "_root", "left_semi").select(node_id).distinct()


def all_paths(nodes: DataFrame, node_id: str, path: str, out: str = "paths", separator: str = ",") -> DataFrame:
    """All distinct paths of a node as one ascending text."""
    listed = nodes.select(node_id, path).distinct().groupBy(node_id).agg(F.array_sort(F.collect_list(path)).alias("_p"))
    return listed.select(node_id, F.concat_ws(separator, "_p").alias(out))


def hierarchy_features(
    nodes: DataFrame, node_id: str, path: str, categories: DataFrame, code: str, name: str, other: str = "not_disease"
) -> DataFrame:
    """Per (node, path) row: depth, descendants, and the named top-level categories over all paths of the node.

    ``categories`` maps a top-level code to its name; branches outside it are called ``other``.
    """
    tops = nodes.select(node_id, first_part(path, ".").alias(code)).distinct()
    named = look_up(tops, code, categories, name, other)
    listed = named.groupBy(node_id).agg(F.array_sort(F.collect_set(name)).alias("categories"))
    rows = descendant_counts(nodes, path).withColumn("depth", path_depth(path))
    return rows.join(listed, node_id)
