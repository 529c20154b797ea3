"""Joins, look-ups, hierarchies and set similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import arrays as A
from ...operators import hierarchy as H
from ...operators import joins as J
from ...operators import sets as U
from ...operators.features import pair_cosine
from ...operators.ordering import keep_first, top_k
from ...session import dealt
from ..registry import query
from .common import PAIRS, PART_NATIONS, ROWS_A_TASK, SUPPLIER_NATIONS, date_text, pairs, part_nations, r6, supplier_nations

SET_SCORES = f"""{PAIRS}, {PART_NATIONS}, {SUPPLIER_NATIONS},
a AS (SELECT l_partkey, list(nation) AS n FROM part_nations GROUP BY 1),
b AS (SELECT l_suppkey, list(nation) AS n FROM supplier_nations GROUP BY 1),
scored AS (
  SELECT l_partkey, l_suppkey, len(list_intersect(a.n, b.n)) AS shared,
         round(len(list_intersect(a.n, b.n)) / len(list_distinct(a.n || b.n)), 6) AS similarity
  FROM pairs JOIN a USING (l_partkey) JOIN b USING (l_suppkey))"""


def set_scores(t) -> DataFrame:
    """Every pair with the shared count and the Jaccard similarity of its two nation sets."""
    wide = J.star_join(pairs(t), (part_nations(t), "l_partkey"), (supplier_nations(t), "l_suppkey"))
    return wide.select(
        "l_partkey", "l_suppkey", A.shared_count("part_nations", "supplier_nations").cast("bigint").alias("shared"),
        F.round(A.jaccard("part_nations", "supplier_nations"), 6).alias("similarity"),
    )


@query("set_similarity_topk", "J2 J3 X1 X2 O4 U4 A6", f"""
WITH {SET_SCORES}
SELECT l_partkey, p_name, l_suppkey, shared, similarity, place FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY similarity DESC, l_suppkey) AS place FROM scored)
JOIN part ON l_partkey = p_partkey WHERE place <= 5""")
def set_similarity_topk(t) -> DataFrame:
    best = top_k(set_scores(t), ["l_partkey"], 5, F.desc("similarity"), "l_suppkey", rank="place")
    names = keep_first(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), ["l_partkey"], "p_name")
    return best.join(names, "l_partkey").withColumn("place", F.col("place").cast("bigint"))


@query("star_join", "J1 J2 J3", f"""
WITH {PAIRS}, m AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS quantity, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_partkey, l_suppkey, p_brand, p_size, s_nationkey, quantity, n FROM pairs
JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN m USING (l_partkey, l_suppkey)""")
def star_join(t) -> DataFrame:
    left = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    right = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    lines = dealt(t.lineitem.select("l_partkey", "l_suppkey", "l_quantity"), ROWS_A_TASK, "l_partkey", "l_suppkey")
    measures = lines.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("n"))
    return J.star_join(pairs(t), (left, "l_partkey"), (right, "l_suppkey"), (measures, ["l_partkey", "l_suppkey"]))


@query("left_join_default", "J4 A1", """
SELECT c_custkey, c_name, coalesce(d, '9999') AS first_date FROM customer LEFT JOIN
  (SELECT o_custkey, strftime(min(o_orderdate), '%Y-%m-%d') AS d FROM orders WHERE o_totalprice > 300000 GROUP BY 1) ON c_custkey = o_custkey""")
def left_join_default(t) -> DataFrame:
    big = t.orders.filter(F.col("o_totalprice") > 300000)
    firsts = big.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(date_text("o_orderdate")).alias("first_date"))
    return J.left_join_or(t.customer.select("c_custkey", "c_name"), firsts, "c_custkey", {"first_date": "9999"})


LISTS = f"""{PAIRS}, lists AS (
  SELECT l_partkey, unnest([s, s // 2, s]) AS e, unnest([0, 1, 2]) AS pos, s FROM (SELECT l_partkey, max(l_suppkey) AS s FROM pairs GROUP BY 1))"""


def id_lists(t) -> DataFrame:
    """Per part an ordered id array with a repeated element."""
    top = pairs(t).groupBy("l_partkey").agg(F.max("l_suppkey").alias("s"))
    return top.select("l_partkey", F.array("s", F.floor(F.col("s") / 2), "s").alias("ids"))


@query("array_map_lookup", "J5 A15", f"""
WITH {LISTS}, mapping AS (
  SELECT s_suppkey AS f, s_nationkey AS g FROM supplier WHERE s_acctbal > 2000
  UNION ALL SELECT s_suppkey, s_nationkey % 5 + 100 FROM supplier WHERE s_acctbal > 6000),
found AS (SELECT l_partkey, string_agg(g, ',' ORDER BY pos, g) AS v FROM lists JOIN mapping ON e = f GROUP BY 1)
SELECT l_partkey, coalesce(v, '') AS mapped FROM (SELECT DISTINCT l_partkey FROM lists) LEFT JOIN found USING (l_partkey)""")
def array_map_lookup(t) -> DataFrame:
    one = t.supplier.filter(F.col("s_acctbal") > 2000).select("s_suppkey", "s_nationkey")
    more = t.supplier.filter(F.col("s_acctbal") > 6000).select("s_suppkey", F.col("s_nationkey") % 5 + 100)
    mapped = J.map_elements(id_lists(t), "l_partkey", "ids", one.union(more), "s_suppkey", "s_nationkey", "mapped")
    return mapped.select("l_partkey", F.array_join(F.transform("mapped", lambda x: x.cast("string")), ",").alias("mapped"))


@query("array_keep_members", "J6", f"""
WITH {LISTS}, found AS (
  SELECT l_partkey, string_agg(e, ',' ORDER BY pos) AS v FROM lists WHERE e IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 4000) GROUP BY 1)
SELECT l_partkey, coalesce(v, '') AS kept FROM (SELECT DISTINCT l_partkey FROM lists) LEFT JOIN found USING (l_partkey)""")
def array_keep_members(t) -> DataFrame:
    primary = t.supplier.filter(F.col("s_acctbal") > 4000)
    kept = J.keep_members(id_lists(t), "l_partkey", "ids", primary, "s_suppkey", "kept")
    return kept.select("l_partkey", F.array_join(F.transform("kept", lambda x: x.cast("string")), ",").alias("kept"))


@query("multi_map", "A15", """
SELECT l_suppkey, count(DISTINCT l_returnflag || l_linestatus) AS n, string_agg(DISTINCT l_returnflag || l_linestatus, ',' ORDER BY l_returnflag || l_linestatus) AS flags
FROM lineitem GROUP BY 1""")
def multi_map(t) -> DataFrame:
    rows = t.lineitem.select("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("flag"))
    lists = J.multi_map(rows, "l_suppkey", "flag", "flags")
    return lists.select("l_suppkey", F.size("flags").cast("bigint").alias("n"), F.array_join("flags", ",").alias("flags"))


@query("last_wins_lookup", "J8", """
SELECT c_custkey, coalesce((SELECT o_orderstatus || o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1), '') AS last_order
FROM customer""")
def last_wins_lookup(t) -> DataFrame:
    rows = t.orders.select(
        F.col("o_custkey").alias("c_custkey"), F.concat("o_orderstatus", "o_orderkey").alias("last_order"), F.struct("o_orderdate", "o_orderkey").alias("at")
    )
    return J.look_up(t.customer.select("c_custkey"), "c_custkey", J.last_wins(rows, "c_custkey", "last_order", "at"), "last_order", "")


NODES = """nodes AS (
  SELECT 'r' || r_regionkey AS id, r_name AS label, 'A' || lpad(CAST(r_regionkey AS VARCHAR), 2, '0') AS path FROM region
  UNION ALL SELECT 'n' || n_nationkey, n_name, 'A' || lpad(CAST(n_regionkey AS VARCHAR), 2, '0') || '.' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') FROM nation
  UNION ALL SELECT 'c' || c_custkey, c_name, 'A' || lpad(CAST(n_regionkey AS VARCHAR), 2, '0') || '.' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') || '.' || lpad(CAST(c_custkey AS VARCHAR), 12, '0')
    FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'c' || c_custkey, c_name, 'B01.' || lpad(CAST(c_nationkey AS VARCHAR), 3, '0') FROM customer WHERE c_acctbal < 0)"""


def hierarchy_nodes(t) -> DataFrame:
    """Regions, nations and customers as (id, label, path); customers in debt have a second path."""
    pad = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    top = F.concat(F.lit("A"), pad("n_regionkey", 2))
    nation = t.nation.withColumn("n_path", F.concat_ws(".", top, pad("n_nationkey", 3)))
    customers = t.customer.join(nation.withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey")
    return U.stacked(
        t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("label"), F.concat(F.lit("A"), pad("r_regionkey", 2)).alias("path")),
        nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("label"), F.col("n_path").alias("path")),
        customers.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("label"), F.concat_ws(".", "n_path", pad("c_custkey", 12)).alias("path")),
        t.customer.filter(F.col("c_acctbal") < 0).select(
            F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("label"), F.concat(F.lit("B01."), pad("c_nationkey", 3)).alias("path")
        ),
    )


@query("prefix_descendants", "J9 E4", f"""
WITH {NODES}, p AS (SELECT DISTINCT path FROM nodes), d AS (SELECT p.path, count(*) AS descendants FROM p JOIN nodes n ON starts_with(n.path, p.path) GROUP BY 1)
SELECT id, path, len(string_split(path, '.')) AS depth, descendants FROM nodes JOIN d USING (path)""")
def prefix_descendants(t) -> DataFrame:
    from ...functions.text import path_depth

    counted = H.descendant_counts(hierarchy_nodes(t), "path")
    return counted.select("id", "path", path_depth("path").cast("bigint").alias("depth"), "descendants")


@query("root_members", "J10 J11 F9", f"""
WITH {NODES}, roots AS (SELECT path AS root FROM nodes WHERE label IN ('NATION_3', 'NATION_8', 'Customer#000000007'))
SELECT DISTINCT id FROM nodes JOIN roots ON starts_with(path, root)""")
def root_members(t) -> DataFrame:
    nodes = hierarchy_nodes(t)
    roots = nodes.filter(F.col("label").isin("NATION_3", "NATION_8", "Customer#000000007"))
    return H.root_members(nodes, roots, "id", "path")


@query("concat_distinct", "J11 A11", f"""
WITH {NODES} SELECT id, string_agg(DISTINCT path, ',' ORDER BY path) AS paths FROM nodes GROUP BY id""")
def concat_distinct(t) -> DataFrame:
    return H.all_paths(hierarchy_nodes(t), "id", "path")


@query("hierarchy_features", "B8 E4 J8 J9 J11", f"""
WITH {NODES}, names AS (SELECT 'A' || lpad(CAST(r_regionkey AS VARCHAR), 2, '0') AS code, replace(lower(r_name), ' ', '_') AS name FROM region WHERE r_regionkey <> 4),
tops AS (SELECT id, coalesce(name, 'not_disease') AS cat FROM nodes LEFT JOIN names ON code = split_part(path, '.', 1)),
cats AS (SELECT id, string_agg(DISTINCT cat, ',' ORDER BY cat) AS categories FROM tops GROUP BY 1),
p AS (SELECT DISTINCT path FROM nodes), d AS (SELECT p.path, count(*) AS descendants FROM p JOIN nodes n ON starts_with(n.path, p.path) GROUP BY 1)
SELECT id, path, len(string_split(path, '.')) AS depth, descendants, categories FROM nodes JOIN d USING (path) JOIN cats USING (id)""")
def hierarchy_features(t) -> DataFrame:
    names = t.region.filter(F.col("r_regionkey") != 4).select(
        F.concat(F.lit("A"), F.lpad(F.col("r_regionkey").cast("string"), 2, "0")).alias("code"), F.replace(F.lower("r_name"), F.lit(" "), F.lit("_")).alias("name")
    )
    made = H.hierarchy_features(hierarchy_nodes(t), "id", "path", names, "code", "name")
    return made.select("id", "path", F.col("depth").cast("bigint").alias("depth"), "descendants", F.array_join("categories", ",").alias("categories"))


@query("map_attach", "J14 E21 U4", """
WITH k AS (SELECT l_partkey, l_returnflag AS flag, s_nationkey AS nation, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
m AS (SELECT l_partkey, flag, string_agg(repeat(nation || ' ', n), '' ORDER BY nation) AS v FROM k GROUP BY 1, 2),
a AS (SELECT l_partkey, string_agg(flag || '=' || v, ';' ORDER BY flag) AS targets FROM m GROUP BY 1),
u AS (SELECT l_partkey, count(DISTINCT nation) AS members FROM k GROUP BY 1)
SELECT p_partkey, targets, members FROM part LEFT JOIN a ON p_partkey = a.l_partkey LEFT JOIN u ON p_partkey = u.l_partkey""")
def map_attach(t) -> DataFrame:
    side = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    sold = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), "l_suppkey", "l_returnflag").join(side, "l_suppkey")
    children = sold.select("p_partkey", "l_returnflag", F.array("s_nationkey").alias("items"))
    parents = J.attach_map(t.part.select("p_partkey"), children, "p_partkey", "l_returnflag", "items", "targets")
    text = F.array_join(F.transform(F.array_sort(F.map_entries("targets")), lambda e: F.concat(
        e["key"], F.lit("="), F.array_join(F.transform(J.repeated_items(e["value"]), lambda v: F.concat(v, F.lit(" "))), ""))), ";")
    return parents.select("p_partkey", text.alias("targets"), F.size(A.map_members(J.plain_items("targets"))).cast("bigint").alias("members"))


@query("bind_columns", "J15", """
SELECT s_suppkey, s_acctbal, n, top FROM supplier JOIN (SELECT l_suppkey, count(*) AS n, max(l_quantity) AS top FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey""")
def bind_columns(t) -> DataFrame:
    measures = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"), F.max("l_quantity").alias("top"))
    return J.bind_columns(t.supplier.select("s_suppkey", "s_acctbal"), measures, "s_suppkey")


@query("pair_cosine", "J12 X10", """
SELECT a.vec_id, b.vec_id AS other_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) + 0.0 AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def given_pair_cosine(t) -> DataFrame:
    asked = t.embeddings.select("vec_id", (F.col("vec_id") + 1).alias("other_id"))
    other = t.embeddings.withColumnRenamed("vec_id", "other_id")
    scored = pair_cosine(asked, t.embeddings, other, "vec_id", "other_id", "embedding", "embedding")
    return scored.withColumn("similarity", r6("similarity"))


@query("id_sets", "U2 U3 U1", """
SELECT id, id IN (SELECT s_nationkey FROM supplier) AND id IN (SELECT c_nationkey FROM customer) AS shared FROM (
  SELECT c_nationkey AS id FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT p_size FROM part)""")
def id_sets(t) -> DataFrame:
    every = U.id_union([(t.customer, "c_nationkey"), (t.supplier, "s_nationkey"), (t.part.select(F.array("p_size").alias("sizes")), "sizes")])
    both = U.id_intersection((t.customer, "c_nationkey"), (t.supplier, "s_nationkey")).withColumn("shared", F.lit(True))
    return J.left_join_or(every, both, "id", {"shared": False})


@query("distinct_rows", "O8 U1", """
SELECT l_returnflag AS flag, l_linestatus AS status FROM lineitem UNION SELECT o_orderstatus, NULL FROM orders""")
def distinct_rows(t) -> DataFrame:
    a = t.lineitem.select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    return U.distinct_rows(a, t.orders.select(F.col("o_orderstatus").alias("flag")))
