"""Typed graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...operators import graph as N
from ...operators.joins import attach_map
from ...operators.sets import stacked
from ..registry import query
from .common import PAIRS, PART_NATIONS, SUPPLIER_NATIONS, pairs, part_nations, r6, supplier_nations
from .joining import SET_SCORES, set_scores


def graph_node_tables(t) -> dict[str, DataFrame]:
    left = t.part.withColumn("price", F.col("p_retailprice") / 1000)
    return {
        "part": N.nodes(left, "part", "p_partkey", ["p_size", "price"]), "supplier": N.nodes(t.supplier, "supplier", "s_suppkey", ["s_acctbal"]),
        "nation": N.token_nodes("nation", (part_nations(t), "part_nations"), (supplier_nations(t), "supplier_nations")),
    }


def graph_nodes(t) -> DataFrame:
    return stacked(*graph_node_tables(t).values())


NODES = f"""{PART_NATIONS}, {SUPPLIER_NATIONS}, nodes AS (
SELECT 'part' AS kind, CAST(p_partkey AS VARCHAR) AS id, row_number() OVER (ORDER BY p_partkey) - 1 AS idx, CAST(p_size AS DOUBLE) AS f0, p_retailprice / 1000 AS f1 FROM part
UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), row_number() OVER (ORDER BY s_suppkey) - 1, s_acctbal, NULL FROM supplier
UNION ALL SELECT 'nation', CAST(nation AS VARCHAR), row_number() OVER (ORDER BY nation) - 1, 1.0, NULL FROM (SELECT nation FROM part_nations UNION SELECT nation FROM supplier_nations))"""


@query("node_table", "G1 G2 P8 O6 U2", f"WITH {NODES} SELECT kind, id, idx, round(f0, 6) AS f0, round(f1, 6) AS f1 FROM nodes")
def node_table(t) -> DataFrame:
    return graph_nodes(t).select("kind", "id", "idx", F.round(F.get("features", F.lit(0)), 6).alias("f0"), F.round(F.get("features", F.lit(1)), 6).alias("f1"))


def token_edges(t) -> DataFrame:
    return stacked(
        N.list_edges(part_nations(t), "part", "l_partkey", "part_nations", "in", "nation"),
        N.list_edges(supplier_nations(t), "supplier", "l_suppkey", "supplier_nations", "serves", "nation"),
    )


TOKEN_EDGES = """token_edges AS (
SELECT 'part' AS src_kind, CAST(l_partkey AS VARCHAR) AS src, 'in' AS kind, 'nation' AS dst_kind, CAST(nation AS VARCHAR) AS dst FROM part_nations
UNION ALL SELECT 'supplier', CAST(l_suppkey AS VARCHAR), 'serves', 'nation', CAST(nation AS VARCHAR) FROM supplier_nations)"""


@query("edges_tokens", "G3", f"""
WITH {NODES}, {TOKEN_EDGES} SELECT e.*, a.idx AS src_idx, b.idx AS dst_idx FROM token_edges e
JOIN nodes a ON a.kind = e.src_kind AND a.id = e.src JOIN nodes b ON b.kind = e.dst_kind AND b.id = e.dst""")
def edges_tokens(t) -> DataFrame:
    return N.indexed_edges(token_edges(t), graph_node_tables(t))


@query("edges_labelled", "G4 G6", """
WITH l AS (SELECT CAST(l_partkey AS VARCHAR) AS p, CAST(l_suppkey AS VARCHAR) AS s, CAST(max(l_quantity) > 30 AS INTEGER) AS success FROM lineitem GROUP BY 1, 2)
SELECT 'part' AS src_kind, p AS src, 'tested' AS kind, 'supplier' AS dst_kind, s AS dst, success FROM l UNION ALL SELECT 'supplier', s, 'rev_tested', 'part', p, success FROM l""")
def edges_labelled(t) -> DataFrame:
    labelled = t.lineitem.groupBy("l_partkey", "l_suppkey").agg((F.max("l_quantity") > 30).cast("int").alias("success"))
    return N.with_reverse(N.pair_edges(labelled, "part", "l_partkey", "tested", "supplier", "l_suppkey", "success"))


@query("edges_attributed", "G5 J14", """
SELECT DISTINCT 'part' AS src_kind, CAST(l_partkey AS VARCHAR) AS src, 'sold' AS kind, 'supplier' AS dst_kind, CAST(l_suppkey AS VARCHAR) AS dst, l_returnflag AS action_type FROM lineitem""")
def edges_attributed(t) -> DataFrame:
    sold = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), "l_returnflag", F.array("l_suppkey").alias("ids"))
    parts = attach_map(t.part.select("p_partkey"), sold, "p_partkey", "l_returnflag", "ids", "targets", repeats=False)
    return N.map_edges(parts, "part", "p_partkey", "targets", "sold", "supplier", "action_type")


@query("metapath_support", "G7 X2", f"""
WITH {PAIRS}, {PART_NATIONS}, {SUPPLIER_NATIONS}, h AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM pairs JOIN part_nations USING (l_partkey) JOIN supplier_nations USING (l_suppkey, nation) GROUP BY 1, 2)
SELECT l_partkey, l_suppkey, coalesce(n, 0) AS paths FROM pairs LEFT JOIN h USING (l_partkey, l_suppkey)""")
def metapath_support(t) -> DataFrame:
    asked = pairs(t).select(F.col("l_partkey").cast("string").alias("l_partkey"), F.col("l_suppkey").cast("string").alias("l_suppkey"))
    edges = token_edges(t)
    counted = N.metapath_support(asked, "l_partkey", "l_suppkey", edges.filter(F.col("kind") == "in"), edges.filter(F.col("kind") == "serves"))
    return counted.select(F.col("l_partkey").cast("bigint").alias("l_partkey"), F.col("l_suppkey").cast("bigint").alias("l_suppkey"), "paths")


@query("similarity_edges", "G8 O4", f"""
WITH {SET_SCORES} SELECT 'part' AS src_kind, CAST(l_partkey AS VARCHAR) AS src, 'similar' AS kind, 'supplier' AS dst_kind, CAST(l_suppkey AS VARCHAR) AS dst, similarity AS weight
FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY similarity DESC, l_suppkey) AS place FROM scored) WHERE place <= 5""")
def similarity_edges(t) -> DataFrame:
    return N.similarity_edges(set_scores(t), "part", "l_partkey", "supplier", "l_suppkey", "similarity")


@query("collapsed_edges", "G9 G6", """
WITH e AS (SELECT CAST(l_partkey AS VARCHAR) AS src, CAST(l_suppkey AS VARCHAR) AS dst, l_returnflag AS kind, round(max(l_extendedprice), 2) AS weight FROM lineitem GROUP BY 1, 2, 3)
SELECT 'part' AS src_kind, src, 'supplier' AS dst_kind, dst, max(kind) AS kind, arg_max(weight, kind) AS weight FROM e GROUP BY src, dst""")
def collapsed_edges(t) -> DataFrame:
    rows = t.lineitem.groupBy("l_partkey", "l_suppkey", "l_returnflag").agg(F.max("l_extendedprice").alias("weight"))
    edges = N.pair_edges(rows, "part", "l_partkey", "x", "supplier", "l_suppkey", "l_returnflag", "weight").withColumn("kind", F.col("l_returnflag"))
    return N.collapse(edges, "l_returnflag", "weight")


def trade_graph(t) -> tuple[DataFrame, DataFrame]:
    """Parts and suppliers with features, and the edges between them in both directions."""
    edges = N.with_reverse(N.pair_edges(pairs(t), "part", "l_partkey", "sold", "supplier", "l_suppkey"))
    size, price, balance = F.sqrt("p_size"), F.sqrt("p_retailprice"), F.sqrt(F.col("s_acctbal") + 2000)
    nodes = stacked(
        t.part.select(F.lit("part").alias("kind"), F.col("p_partkey").cast("string").alias("id"), F.array(size, price).alias("features")),
        t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").cast("string").alias("id"), F.array(balance).alias("features")),
    )
    return edges, nodes


@query("hop_mean", "G10 G6", f"""
WITH {PAIRS}, p AS (SELECT p_partkey AS k, sqrt(p_size) AS a, sqrt(p_retailprice) AS b FROM part), s AS (SELECT s_suppkey AS k, sqrt(s_acctbal + 2000) AS a FROM supplier),
p1 AS (SELECT l_partkey AS k, avg(a) AS a, 0.0 AS b FROM pairs JOIN s ON l_suppkey = s.k GROUP BY 1),
s1 AS (SELECT l_suppkey AS k, avg(a) AS a, avg(b) AS b FROM pairs JOIN p ON l_partkey = p.k GROUP BY 1),
p2 AS (SELECT l_partkey AS k, avg(a) AS a, avg(b) AS b FROM pairs JOIN s1 ON l_suppkey = s1.k GROUP BY 1),
s2 AS (SELECT l_suppkey AS k, avg(a) AS a, avg(b) AS b FROM pairs JOIN p1 ON l_partkey = p1.k GROUP BY 1)
SELECT 'part' AS kind, CAST(p.k AS VARCHAR) AS id, round(p.a, 6) AS f0, round(p.b, 6) AS f1, round(coalesce(p1.a, 0), 6) AS f2, 0.0::DOUBLE AS f3,
  round(coalesce(p2.a, 0), 6) AS f4, round(coalesce(p2.b, 0), 6) AS f5 FROM p LEFT JOIN p1 ON p.k = p1.k LEFT JOIN p2 ON p.k = p2.k
UNION ALL SELECT 'supplier', CAST(s.k AS VARCHAR), round(s.a, 6), 0.0::DOUBLE, round(coalesce(s1.a, 0), 6), round(coalesce(s1.b, 0), 6),
  round(coalesce(s2.a, 0), 6), round(coalesce(s2.b, 0), 6) FROM s LEFT JOIN s1 ON s.k = s1.k LEFT JOIN s2 ON s.k = s2.k""")
def hop_mean(t) -> DataFrame:
    edges, nodes = trade_graph(t)
    reached = N.propagate(edges, nodes, 2)
    return reached.select("kind", "id", *[r6(F.get("features", F.lit(i))).alias(f"f{i}") for i in range(6)])


@query("graph_summary", "G12 A19", f"""
WITH {NODES}, {TOKEN_EDGES}, d AS (SELECT src_kind || '-' || kind || '-' || dst_kind AS name, src, count(*) AS degree FROM token_edges GROUP BY 1, 2)
SELECT 'node' AS part, kind AS name, count(*) AS n, CAST(NULL AS DOUBLE) AS median_degree FROM nodes GROUP BY kind
UNION ALL SELECT 'edge', name, CAST(sum(degree) AS BIGINT), median(degree) FROM d GROUP BY name""")
def graph_summary(t) -> DataFrame:
    return N.graph_summary(graph_nodes(t), token_edges(t))
