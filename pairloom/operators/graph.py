"""Typed graphs as two tables: ``nodes(kind, id, idx, features)`` and ``edges(src_kind, src, kind, dst_kind, dst, ...)``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .aggregates import vector_sums
from .ordering import row_index, top_k
from .sets import id_union, stacked

ENDS = ["src_kind", "src", "kind", "dst_kind", "dst"]


def nodes(df: DataFrame, kind: str, node_id: str, features: Sequence[str]) -> DataFrame:
    """Node table of one kind with a dense index in id order and its numeric features as one array."""
    vector = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
    rows = df.select(F.lit(kind).alias("kind"), F.col(node_id).cast("string").alias("id"), F.col(node_id).alias("_o"), vector.alias("features"))
    return row_index(rows, "_o", name="idx").select("kind", "id", "idx", "features")


def token_nodes(kind: str, *sources: tuple[DataFrame, str]) -> DataFrame:
    """Node table of the distinct tokens of several list columns, with a constant feature."""
    return nodes(id_union(sources).withColumn("_one", F.lit(1.0)), kind, "id", ["_one"])


def _edges(df: DataFrame, src_kind: str, src: Column, kind: str, dst_kind: str, dst: Column, *attributes: Column) -> DataFrame:
    return df.select(
        F.lit(src_kind).alias("src_kind"), src.cast("string").alias("src"), F.lit(kind).alias("kind"),
        F.lit(dst_kind).alias("dst_kind"), dst.cast("string").alias("dst"), *attributes,
    )


def list_edges(df: DataFrame, src_kind: str, src: str, array: str, kind: str, dst_kind: str) -> DataFrame:
    """One edge per entity and element of its list."""
    flat = df.select(F.col(src).alias("_s"), F.explode(array).alias("_d"))
    return _edges(flat, src_kind, F.col("_s"), kind, dst_kind, F.col("_d"))


def pair_edges(pairs: DataFrame, src_kind: str, src: str, kind: str, dst_kind: str, dst: str, *attributes: str) -> DataFrame:
    """One edge per pair, with the named columns as attributes."""
    return _edges(pairs, src_kind, F.col(src), kind, dst_kind, F.col(dst), *[F.col(a) for a in attributes])


def map_edges(df: DataFrame, src_kind: str, src: str, mapping: str, kind: str, dst_kind: str, attribute: str) -> DataFrame:
    """One edge per entity, map key and element of the key's list; the key is an attribute of the edge."""
    by_key = df.select(F.col(src).alias("_s"), F.explode(mapping).alias("_k", "_ids"))
    flat = by_key.select("_s", "_k", F.explode("_ids").alias("_d"))
    return _edges(flat, src_kind, F.col("_s"), kind, dst_kind, F.col("_d"), F.col("_k").alias(attribute))


def indexed_edges(edges: DataFrame, node_tables: Mapping[str, DataFrame]) -> DataFrame:
    """Add the node numbers of both ends; edges to unknown nodes are dropped.

    Each kind of node is joined from a table of its own, so a kind with few nodes (tokens, to which many edges lead) is planned
    by its own size.
    """
    def numbered(part: DataFrame, end: str) -> DataFrame:
        found = [
            part.where(F.col(f"{end}_kind") == kind).join(nodes.select(F.col("id").alias(end), F.col("idx").alias(f"{end}_idx")), end)
            for kind, nodes in node_tables.items()
        ]
        return stacked(*found)

    return numbered(numbered(edges, "src"), "dst").select(*edges.columns, "src_idx", "dst_idx")


def with_reverse(edges: DataFrame, prefix: str = "rev_") -> DataFrame:
    """All edges and the same edges turned round."""
    turned = edges.select(
        F.col("dst_kind").alias("src_kind"), F.col("dst").alias("src"), F.concat(F.lit(prefix), "kind").alias("kind"),
        F.col("src_kind").alias("dst_kind"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ENDS],
    )
    return edges.unionByName(turned)


#: Tokens that an entity carries in one cell at most.
LIGHT = 4096


def metapath_support(pairs: DataFrame, src: str, dst: str, src_edges: DataFrame, dst_edges: DataFrame, out: str = "paths") -> DataFrame:
    """Number of entity-token-entity paths of each given pair.

    Paths are counted for the pairs asked for; listing every pair under a common token would square the token's degree. An entity with at
    most LIGHT tokens carries them as one sorted cell, so a pair of two such entities is one row throughout and its cells are
    intersected; this is written once. Of a pair with a heavier end, the tokens of the lighter one are looked up among those of the heavier.
    """

    def side(edges: DataFrame, end: str, name: str) -> tuple[DataFrame, DataFrame]:
        """(entity, cell or null for a heavy one, degree), and the tokens of heavy entities."""
        tokens = edges.select(F.col("src").alias(end), F.col("dst").alias("_t")).distinct()
        degree = tokens.groupBy(end).agg(F.count("*").alias(f"_n{name}"))
        known = tokens.join(degree, end)
        light = known.where(F.col(f"_n{name}") <= LIGHT).groupBy(end).agg(F.sort_array(F.collect_list("_t")).alias(f"_c{name}"), F.first(f"_n{name}").alias(f"_n{name}"))
        heavy = known.where(F.col(f"_n{name}") > LIGHT)
        marked = heavy.select(end, f"_n{name}").distinct().withColumn(f"_c{name}", F.lit(None).cast("array<string>"))
        return light.withColumn(f"_c{name}", F.col(f"_c{name}").cast("array<string>")).unionByName(marked), heavy.select(end, "_t")

    (left, heavy_left), (right, heavy_right) = side(src_edges, src, "l"), side(dst_edges, dst, "r")
    both = F.col("_cl").isNotNull() & F.col("_cr").isNotNull()
    few = F.when(both, F.size(F.array_intersect("_cl", "_cr"))).when(F.col("_nl").isNull() | F.col("_nr").isNull(), 0).cast("bigint")
    counted = cut_lineage(pairs.join(left, src, "left").join(right, dst, "left").select(*pairs.columns, few.alias(out)))
    heavy = counted.where(F.col(out).isNull()).drop(out)
    rest = heavy.select(src, dst).distinct().join(left, src).join(right, dst)
    # The side whose tokens are listed is light, or both are heavy and it is the left one.
    by_right = rest.where(F.col("_cr").isNotNull()).select(src, dst, F.explode("_cr").alias("_t")).join(heavy_left, [src, "_t"])
    by_left = rest.where(F.col("_cr").isNull() & F.col("_cl").isNotNull()).select(src, dst, F.explode("_cl").alias("_t")).join(heavy_right, [dst, "_t"])
    by_both = rest.where(F.col("_cr").isNull() & F.col("_cl").isNull()).select(src, dst).join(heavy_left, src).join(heavy_right, [dst, "_t"])
    listed = by_right.select(src, dst).unionByName(by_left.select(src, dst)).unionByName(by_both.select(src, dst))
    summed = heavy.join(listed.groupBy(src, dst).agg(F.count("*").alias(out)), [src, dst], "left")
    return counted.where(F.col(out).isNotNull()).unionByName(summed.withColumn(out, F.coalesce(out, F.lit(0)).cast("bigint")))


def similarity_edges(scored: DataFrame, src_kind: str, src: str, dst_kind: str, dst: str, score: str, k: int = 5, kind: str = "similar") -> DataFrame:
    """Edges to the ``k`` best-scored partners of each node, ties by partner id."""
    best = top_k(scored, [src], k, F.desc(score), dst)
    return _edges(best, src_kind, F.col(src), kind, dst_kind, F.col(dst), F.col(score).alias("weight"))


def collapse(edges: DataFrame, priority: Column | str, *attributes: str) -> DataFrame:
    """One edge per (src, dst): attributes of the edge written last; of equals the smallest attributes."""
    order = (priority if isinstance(priority, Column) else F.col(priority)).alias("_o")
    ends = ["src_kind", "src", "dst_kind", "dst"]
    ties = edges.select(*ends, order, F.struct("kind", *attributes).alias("_a")).groupBy(*ends, "_o").agg(F.min("_a").alias("_a"))
    return ties.groupBy(*ends).agg(F.max_by("_a", "_o").alias("_a")).select("src_kind", "src", "dst_kind", "dst", "_a.*")


def hop(edges: DataFrame, features: DataFrame, width: int) -> DataFrame:
    """One round of typed neighbour aggregation: mean over the in-neighbours per edge type, summed over types.

    Vectors narrower than ``width`` are padded with zeros; a null element does not count in its mean, and a mean over
    none is zero. Sums are built by partial aggregation, so a node with very many in-edges costs one partial sum per task.
    """
    sources = features.select(F.col("kind").alias("src_kind"), F.col("id").alias("src"), F.col("features").alias("_v"))
    messages = edges.select(*ENDS).join(sources, ["src_kind", "src"])
    value = lambda i: F.when(F.size("_v") > i, F.get("_v", F.lit(i))).when(F.col("_v").isNotNull(), 0.0).cast("double")
    means = messages.groupBy("dst_kind", "dst", "src_kind", "kind").agg(*[F.coalesce(F.avg(value(i)), F.lit(0.0)).alias(f"_m{i}") for i in range(width)])
    summed = vector_sums(means, ["dst_kind", "dst"], [F.col(f"_m{i}") for i in range(width)], "features")
    return summed.select(F.col("dst_kind").alias("kind"), F.col("dst").alias("id"), "features")


def propagate(edges: DataFrame, features: DataFrame, width: int, hops: int = 2) -> DataFrame:
    """Own features followed by the aggregates of 1..hops rounds; a node without in-edges gets zeros.

    Edges are read once a round and therefore written once.
    """
    edges = cut_lineage(edges.select(*ENDS))
    base = F.slice(F.concat("features", F.array_repeat(F.lit(0.0), width)), 1, width)
    out = features.select("kind", "id", base.alias("features"))
    current = out
    for i in range(hops):
        current = cut_lineage(hop(edges, current, width))
        step = current.withColumnRenamed("features", "_h")
        zeros = F.array_repeat(F.lit(0.0), width)
        out = out.join(step, ["kind", "id"], "left").select(
            "kind", "id", F.concat("features", F.coalesce("_h", zeros)).alias("features")
        )
    return out


def link_features(pairs: DataFrame, src_kind: str, src: str, dst_kind: str, dst: str, embedded: DataFrame, out: str = "features") -> DataFrame:
    """Concatenated vectors of both ends of each pair."""
    a = embedded.filter(F.col("kind") == src_kind).select(F.col("id").alias("_sid"), F.col("features").alias("_a"))
    b = embedded.filter(F.col("kind") == dst_kind).select(F.col("id").alias("_did"), F.col("features").alias("_b"))
    keyed = pairs.withColumns({"_sid": F.col(src).cast("string"), "_did": F.col(dst).cast("string")})
    joined = keyed.join(a, "_sid").join(b, "_did")
    return joined.withColumn(out, array_to_vector(F.concat("_a", "_b"))).drop("_sid", "_did", "_a", "_b")


def graph_summary(node_table: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges by kind, with the median out-degree of the sources of each edge type.

    Degrees are counted per value before the median is taken.
    """
    node_rows = node_table.groupBy(F.lit("node").alias("part"), F.col("kind").alias("name")).agg(F.count("*").alias("n"))
    name = F.concat_ws("-", "src_kind", "kind", "dst_kind").alias("name")
    degrees = edges.groupBy(name, "src").agg(F.count("*").alias("degree"))
    spread = degrees.groupBy("name", "degree").agg(F.count("*").alias("sources"))
    edge_rows = spread.groupBy(F.lit("edge").alias("part"), "name").agg(
        F.sum(F.col("degree") * F.col("sources")).alias("n"), F.percentile("degree", F.lit(0.5), F.col("sources")).alias("median_degree")
    )
    return stacked(node_rows, edge_rows)
