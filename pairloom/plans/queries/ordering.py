"""Sorts, top-k, positions, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...operators import ordering as O
from ..registry import query


@query("sort_head", "O1 O2 O3", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey LIMIT 10""")
def sort_head(t) -> DataFrame:
    return t.orders.orderBy("o_orderstatus", F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_custkey", "o_totalprice").limit(10)


@query("topk_group", "O4", """
SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 3""")
def topk_group(t) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    return O.top_k(rows, ["o_custkey"], 3, F.desc("o_totalprice"), "o_orderkey", rank="rank")


@query("nested_top", "O5", """
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest(['q', 'd', 't', 'p']) AS name, unnest([l_quantity / 50, l_discount * 10, l_tax * 10, l_extendedprice / 100000]) AS score,
  unnest([1, 2, 3, 4]) AS pos, rid FROM (SELECT *, row_number() OVER () AS rid FROM lineitem)),
k AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, pos) AS place FROM r)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, string_agg(name, '' ORDER BY place) AS best FROM k WHERE place <= 2 GROUP BY rid, 1, 2, 3, 4""")
def nested_top(t) -> DataFrame:
    item = lambda n, c: F.struct(F.lit(n).alias("name"), c.alias("score"))
    items = F.array(
        item("q", F.col("l_quantity") / 50), item("d", F.col("l_discount") * 10), item("t", F.col("l_tax") * 10), item("p", F.col("l_extendedprice") / 100000)
    )
    best = O.top_items(items, 2, "score")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(F.transform(best, lambda x: x["name"]), "").alias("best")
    )


@query("row_index", "O6", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_index FROM orders")
def row_index(t) -> DataFrame:
    return O.row_index(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").select("o_orderkey", "row_index")


LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


@query("keep_first", "O7", """
SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""")
def keep_first(t) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", *LINE_ORDER)
    return O.keep_first(rows, ["l_orderkey", "l_linenumber"], *LINE_ORDER)


@query("time_split", "O9 O6", """
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN i < floor(n * 0.85::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM r""")
def time_split(t) -> DataFrame:
    return O.time_split(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").select("o_orderkey", "part")


@query("stratified_split", "O10", """
WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || ':42'), doc_id) - 1 AS i, count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT doc_id, quality, CASE WHEN i < floor(n * 0.85::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM r""")
def stratified_split(t) -> DataFrame:
    return O.stratified_split(t.labels.select("doc_id", "quality"), "quality", "doc_id").select("doc_id", "quality", "part")


@query("quantile_value", "O11", """
SELECT o_orderdate FROM (SELECT o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) WHERE i = floor(n * 0.9::DOUBLE)""")
def quantile_value(t) -> DataFrame:
    return O.value_at(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", 0.9, "o_orderdate", "o_orderkey")


@query("stratified_folds", "O12", """
WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT doc_id, quality, CAST(i * 5 // n AS INTEGER) AS fold FROM r""")
def stratified_folds(t) -> DataFrame:
    return O.stratified_folds(t.labels.select("doc_id", "quality"), "quality", 5, "doc_id")


@query("running_totals", "O6 V3", """
SELECT o_orderkey, CAST(sum(o_custkey) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM orders""")
def running_totals(t) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_orderdate", "o_custkey")
    return O.running_totals(rows, ["o_orderdate", "o_orderkey"], {"total": "o_custkey"}).select("o_orderkey", "total")
