"""Tables derived from the standard ones that several queries start from, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...session import dealt

#: Rows of the tables of pairs, lines and orders that one task groups, sorts or joins.
ROWS_A_TASK = 1 << 18


def r6(c: Column | str) -> Column:
    """Rounded for comparison; adding 0.0 turns -0.0 into 0.0."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def pairs(t) -> DataFrame:
    """Distinct (part, supplier) pairs."""
    return dealt(t.lineitem.select("l_partkey", "l_suppkey"), ROWS_A_TASK, "l_partkey", "l_suppkey").distinct()


PAIRS = "pairs AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)"


def part_nations(t) -> DataFrame:
    """Per part the ascending set of the nations of its suppliers (at most one entry per nation)."""
    sides = pairs(t).join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    found = sides.select("l_partkey", "s_nationkey").distinct()
    return found.groupBy("l_partkey").agg(F.array_sort(F.collect_list("s_nationkey")).alias("part_nations"))


PART_NATIONS = """part_nations AS (
  SELECT l_partkey, s_nationkey AS nation FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""


def supplier_nations(t) -> DataFrame:
    """Per supplier the ascending set of the nations of the customers it served."""
    buyers = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    nations = buyers.join(t.customer.select("c_custkey", "c_nationkey"), "c_custkey").select("l_orderkey", "c_nationkey")
    served = t.lineitem.select("l_suppkey", "l_orderkey").join(nations, "l_orderkey").select("l_suppkey", "c_nationkey").distinct()
    return served.groupBy("l_suppkey").agg(F.array_sort(F.collect_list("c_nationkey")).alias("supplier_nations"))


SUPPLIER_NATIONS = """supplier_nations AS (
  SELECT l_suppkey, c_nationkey AS nation FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def date_text(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")
