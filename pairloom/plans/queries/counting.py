"""Aggregations and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import arrays as A
from ...functions import dates as D
from ...operators import aggregates as G
from ..registry import query
from .common import PART_NATIONS, part_nations, r6


@query("value_counts", "A3", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def value_counts(t) -> DataFrame:
    return G.value_counts(t.orders, "o_orderpriority")


@query("group_sizes", "A2", """
SELECT CASE WHEN c_nationkey <> 3 THEN c_nationkey END AS nation, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2""")
def group_sizes(t) -> DataFrame:
    return G.group_sizes(t.customer.withColumn("nation", F.when(F.col("c_nationkey") != 3, F.col("c_nationkey"))), "nation", "c_mktsegment")


@query("group_min", "A1", """
SELECT l_partkey, supp, min(l_shipdate) AS l_shipdate FROM (SELECT l_partkey, CASE WHEN l_quantity > 5 THEN l_suppkey END AS supp, l_shipdate FROM lineitem)
WHERE supp IS NOT NULL GROUP BY 1, 2""")
def group_min(t) -> DataFrame:
    rows = t.lineitem.select("l_partkey", F.when(F.col("l_quantity") > 5, F.col("l_suppkey")).alias("supp"), "l_shipdate")
    return G.group_min(rows, ["l_partkey", "supp"], "l_shipdate")


STATUS = {"F": "failed", "O": "open", "P": "pending"}


@query("yearly_stability", "A2 A4 A5 W1 E10 B12", """
WITH y AS (SELECT CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN NULL ELSE CAST(year(o_orderdate) AS INTEGER) END AS year, o_orderstatus AS s FROM orders),
c AS (SELECT year, count(*) FILTER (s = 'F') AS failed, count(*) FILTER (s = 'O') AS open, count(*) FILTER (s = 'P') AS pending FROM y GROUP BY 1),
p AS (SELECT *, failed + open + pending AS total FROM c)
SELECT year, failed, open, pending, round(failed / total, 6) AS failed_share, round(open / total, 6) AS open_share, round(pending / total, 6) AS pending_share,
  round(avg(failed) OVER w, 6) AS failed_mean, round(avg(open) OVER w, 6) AS open_mean, round(avg(pending) OVER w, 6) AS pending_mean,
  round(avg(failed / total) OVER w, 6) AS failed_share_mean, round(avg(open / total) OVER w, 6) AS open_share_mean, round(avg(pending / total) OVER w, 6) AS pending_share_mean
FROM p WINDOW w AS (ORDER BY year ASC NULLS LAST ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def yearly_stability(t) -> DataFrame:
    hidden = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")
    dated = t.orders.select("o_orderstatus", F.when(hidden, "9999").otherwise(F.date_format("o_orderdate", "yyyy-MM")).alias("d"))
    made = G.yearly_stability(dated, D.date_year("d"), "o_orderstatus", list(STATUS), list(STATUS.values()))
    return made.select("year", *STATUS.values(), *[r6(c).alias(c) for c in made.columns if c != "year" and c not in STATUS.values()])


@query("missing_date_labels", "B12 A3", """
SELECT coalesce(CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderstatus END, 'Missing') AS label, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1""")
def missing_date_labels(t) -> DataFrame:
    dated = t.orders.select(
        F.when(F.col("o_orderstatus") == "F", "2001").otherwise("9999").alias("d"),
        F.coalesce(F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderstatus")), F.lit("Missing")).alias("label"),
    )
    return G.value_counts(dated.filter(D.date_year("d").isNull()), "label")


@query("distinct_profile", "A6", """
SELECT 'c_custkey' AS "column", count(DISTINCT c_custkey) AS n_distinct FROM customer UNION ALL SELECT 'c_nationkey', count(DISTINCT c_nationkey) FROM customer
UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment) FROM customer UNION ALL SELECT 'c_acctbal', count(DISTINCT c_acctbal) FROM customer""")
def distinct_profile(t) -> DataFrame:
    return G.distinct_counts(t.customer, ["c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal"])


@query("duplicate_count", "A7", "SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS BIGINT) AS duplicates FROM lineitem")
def duplicate_count(t) -> DataFrame:
    return G.duplicate_count(t.lineitem, "l_orderkey", "l_linenumber")


@query("null_profile", "A8", """
SELECT count(*) FILTER (c_acctbal < 0) AS balance, CAST(0 AS BIGINT) AS c_custkey, count(*) FILTER (c_mktsegment = 'BUILDING') AS segment FROM customer""")
def null_profile(t) -> DataFrame:
    holed = t.customer.select(
        "c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment")
    )
    return G.null_counts(holed)


@query("missing_indicators", "A8 X17 A17", """
WITH h AS (SELECT CASE WHEN c_acctbal < 0 OR c_nationkey > 20 THEN 1.0 ELSE 0.0 END AS m, CAST(c_nationkey AS DOUBLE) AS nation, c_acctbal AS balance FROM customer)
SELECT 'hidden_is_missing' AS feature, 'nation' AS other, round(corr(m, nation), 6) AS r FROM h UNION ALL SELECT 'hidden_is_missing', 'balance', round(corr(m, balance), 6) FROM h""")
def missing_indicators(t) -> DataFrame:
    hidden = F.when((F.col("c_acctbal") >= 0) & (F.col("c_nationkey") <= 20), F.col("c_acctbal"))
    rows = t.customer.select(hidden.alias("hidden"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    found = G.missingness_correlations(rows, ["hidden"], ["nation", "balance"])
    return found.withColumn("r", r6("r"))


CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("corr_matrix", "A17", " UNION ALL ".join(
    f"SELECT '{a}' AS feature, '{b}' AS other, round(corr({a}, {b}), 6) + 0.0 AS r FROM lineitem" for a in CORR for b in CORR))
def corr_matrix(t) -> DataFrame:
    return G.correlations(t.lineitem, CORR, CORR).withColumn("r", r6("r"))


WIDE = [f"e{i}" for i in range(64)]


@query("corr_wide", "A17 P10", """
WITH w AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
SELECT 'e' || a.i AS feature, 'e' || b.i AS other, round(corr(a.x, b.x), 6) + 0.0 AS r FROM w a JOIN w b USING (vec_id) GROUP BY a.i, b.i""")
def corr_wide(t) -> DataFrame:
    wide = t.embeddings.select(*[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(WIDE)])
    return G.correlations(wide, WIDE, WIDE).withColumn("r", r6("r"))


@query("class_weights", "A18", """
SELECT quality, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight, round((SELECT count(*) FILTER (quality = 0) / count(*) FILTER (quality = 1) FROM labels), 6) AS ratio
FROM (SELECT quality, count(*) AS n FROM labels GROUP BY 1)""")
def class_weights(t) -> DataFrame:
    ratio = G.class_ratio(t.labels, "quality")
    return G.class_weights(t.labels, "quality").select("quality", "n", r6("weight").alias("weight")).withColumn("ratio", F.round(ratio.scalar(), 6))


@query("set_sizes", "A19", f"""
WITH {PART_NATIONS}, s AS (SELECT p_partkey, count(nation) AS size FROM part LEFT JOIN part_nations ON p_partkey = l_partkey GROUP BY 1)
SELECT count(*) AS entities, median(size) AS median_size FROM s""")
def set_sizes(t) -> DataFrame:
    return G.size_summary(t.part.select(F.col("p_partkey").alias("l_partkey")).join(part_nations(t), "l_partkey", "left"), "part_nations")


FEATURES = ["l_quantity", "l_extendedprice", "l_discount"]


@query("feature_distribution", "A20", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, l_returnflag, count({f}) AS n, round(avg({f}), 5) AS mean, round(stddev_samp({f}), 5) AS deviation, min({f}) + 0.0 AS low, max({f}) + 0.0 AS high, "
    f"quantile_disc({f}, 0.25) + 0.0 AS q1, quantile_disc({f}, 0.5) + 0.0 AS q2, quantile_disc({f}, 0.75) + 0.0 AS q3 FROM lineitem GROUP BY l_returnflag" for f in FEATURES))
def feature_distribution(t) -> DataFrame:
    made = G.feature_summary(t.lineitem, FEATURES, "l_returnflag", accuracy=10_000_000)
    return made.select(
        "feature", "l_returnflag", "n", F.round("mean", 5).alias("mean"), F.round("deviation", 5).alias("deviation"),
        (F.col("low") + 0.0).alias("low"), (F.col("high") + 0.0).alias("high"), *[(F.get("quartiles", F.lit(i)) + 0.0).alias(f"q{i + 1}") for i in range(3)],
    )


@query("array_statistics", "A12 A16", """
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, [l_discount + 0.0, l_tax + 0.0, l_quantity / 50, l_discount * 5 + 0.0] AS v, ['PHASE' || l_linenumber, 'NA', 'EARLY_PHASE1'] AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(list_median(v), 6) AS median, list_min(v) AS lowest, len(list_filter(v, lambda x: x < 0.05)) / 4 AS below,
  len(list_filter(v, lambda x: x > 0.2)) / 4 AS above, l_linenumber AS phase FROM p""")
def array_statistics(t) -> DataFrame:
    v = F.array(F.col("l_discount") + 0.0, F.col("l_tax") + 0.0, F.col("l_quantity") / 50, F.col("l_discount") * 5 + 0.0)
    codes = F.array(F.concat(F.lit("PHASE"), "l_linenumber"), F.lit("NA"), F.lit("EARLY_PHASE1"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", v.alias("v"), codes.alias("c"))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(A.median_of("v"), 6).alias("median"), A.smallest("v").alias("lowest"),
        A.share_of("v", lambda x: x < 0.05).alias("below"), A.share_of("v", lambda x: x > 0.2).alias("above"), A.highest_code("c").alias("phase"),
    )


@query("key_popularity", "A14 B9 J8", """
SELECT c_custkey, coalesce(n, 0) AS nb_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def key_popularity(t) -> DataFrame:
    from ...operators.trials import popularity

    facts = t.orders.select(F.col("o_custkey").alias("c_custkey"))
    return popularity(t.customer.select("c_custkey"), "c_custkey", facts, "nb_orders")


@query("shared_tokens", "A19 U3 U2", """
WITH a AS (SELECT DISTINCT s_nationkey AS n FROM supplier WHERE s_acctbal > 5000), b AS (SELECT DISTINCT c_nationkey AS n FROM customer WHERE c_acctbal > 9000)
SELECT (SELECT count(*) FROM a) AS left_tokens, (SELECT count(*) FROM b) AS right_tokens, (SELECT count(*) FROM (SELECT n FROM a INTERSECT SELECT n FROM b)) AS shared,
  (SELECT count(*) FROM (SELECT n FROM a UNION SELECT n FROM b)) AS every""")
def shared_tokens(t) -> DataFrame:
    a = t.supplier.filter(F.col("s_acctbal") > 5000).select(F.col("s_nationkey").alias("n"), F.lit(1).alias("l"), F.lit(0).alias("r"))
    b = t.customer.filter(F.col("c_acctbal") > 9000).select(F.col("c_nationkey").alias("n"), F.lit(0).alias("l"), F.lit(1).alias("r"))
    sides = a.union(b).groupBy("n").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return sides.agg(
        F.sum("l").alias("left_tokens"), F.sum("r").alias("right_tokens"), F.sum(F.col("l") * F.col("r")).alias("shared"), F.count("*").alias("every")
    )
