"""Physical plans: no nested-loop joins, limits below the shuffle, columns pruned, filters pushed to the scan."""

import re

import pytest
from pyspark.sql import functions as F

from pairloom.plans.registry import Tables, load_all

FOLDER = "/root/testdata/sf0.001"
QUERIES = load_all()

LAZY = [
    "set_similarity_topk", "star_join", "array_map_lookup", "array_keep_members", "last_wins_lookup", "prefix_descendants", "root_members", "hierarchy_features",
    "map_attach", "pair_cosine", "membership", "overlap_members", "score_outliers", "page_link_join", "pair_evidence", "pair_label", "first_date_fallback",
    "drug_flatten", "condensed_pairs", "metapath_support", "similarity_edges", "edges_labelled", "edges_attributed", "collapsed_edges", "keep_first", "topk_group",
]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
@pytest.mark.parametrize("name", LAZY)
def test_no_nested_loops_or_unpartitioned_windows(spark, name, broadcast):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        text = plan(QUERIES[name].run(Tables(spark, FOLDER)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "SinglePartition" not in text
    assert "PythonUDF" not in text and "ArrowEvalPython" not in text
    if broadcast == "-1":
        assert "BroadcastHashJoin" not in text


@pytest.mark.parametrize("name", ["set_similarity_topk", "similarity_edges", "keep_first", "topk_group"])
def test_limit_is_applied_before_the_shuffle(spark, name):
    text = plan(QUERIES[name].run(Tables(spark, FOLDER)))
    assert re.search(r"WindowGroupLimit .*Partial", text)


def test_scan_reads_only_what_is_needed(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    text = plan(QUERIES["nested_range"].run(Tables(spark, FOLDER)))
    assert "GreaterThanOrEqual(line.amounts.l_quantity,30.0)" in text and "LessThanOrEqual(line.amounts.l_extendedprice,30000.0)" in text
    read = re.search(r"ReadSchema: (.*)", text)[1]
    assert "struct<l_quantity:double,l_extendedprice:double>" in read and "l_shipdate" not in read and "l_discount" not in read
    assert "p_name" not in plan(QUERIES["pair_evidence"].run(Tables(spark, FOLDER)))


def test_hot_join_key_is_split(spark):
    from pyspark.sql import functions as F

    from pairloom.operators.joins import star_join
    from pairloom.session import configure

    configure(spark)
    lowered = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    for k, v in lowered.items():
        spark.conf.set(k, v)
    try:
        key = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1000)
        many = spark.range(0, 400_000, 1, 8).select(key.alias("k"), F.md5(F.col("id").cast("string")).alias("v"))
        one = spark.range(1000).select(F.col("id").alias("k"), F.lit("x").alias("w"))
        counted = star_join(many, (one, "k")).groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("v"))
        assert counted.agg(F.sum("n")).collect()[0][0] == 400_000
        counted.collect()
        assert "skew=true" in counted._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in lowered:
            spark.conf.unset(k)


def test_tasks_grow_with_rows(spark, monkeypatch):
    """What one task groups, sorts or unfolds is bounded by rows, as small rows pass any bound in bytes."""
    from types import SimpleNamespace

    from pairloom.plans.queries import common, featuring, joining
    from pairloom.session import dealt

    assert [dealt(spark.range(n), 30, "id").rdd.getNumPartitions() for n in (0, 60, 100)] == [2, 2, 4]
    monkeypatch.setattr(common, "ROWS_A_TASK", 100)
    monkeypatch.setattr(joining, "ROWS_A_TASK", 100)
    monkeypatch.setattr(featuring, "STRUCTURES_A_TASK", 100)
    monkeypatch.setattr(featuring, "DOCUMENTS_A_TASK", 100)
    rows = spark.range(450).select(
        (F.col("id") % 7).alias("l_partkey"), (F.col("id") % 5).alias("l_suppkey"), F.lit(2.0).alias("l_quantity"), F.col("id").alias("doc_id"), F.lit("a b a").alias("text"),
        (F.col("id") % 7).alias("p_partkey"), F.lit("x").alias("p_name"), F.lit("y").alias("p_type"), F.lit("z").alias("p_brand"), F.lit(1).alias("p_size"),
        (F.col("id") % 5).alias("s_suppkey"), F.lit(3).alias("s_nationkey"))
    t = SimpleNamespace(lineitem=rows, documents=rows, part=rows.where("id < 7"), supplier=rows.where("id < 5"))
    found = joining.star_join(t)
    assert plan(found).count("REPARTITION_BY_NUM") == 2 and re.search(r"hashpartitioning\(l_partkey#\d+L, l_suppkey#\d+L, 5\)", plan(found))
    assert found.count() == 35 and found.agg(F.sum("n"), F.sum("quantity")).first() == (450, 900.0)
    tokens = featuring.token_counts(t)
    assert "SortAggregate" not in plan(tokens) and plan(tokens).count("Exchange") == 1
    assert {tuple(r)[1:] for r in tokens.collect()} == {("a", 2), ("b", 1)} and tokens.count() == 900
    assert featuring.structures(SimpleNamespace(part=rows)).rdd.getNumPartitions() == 5


def test_links_are_dealt_to_the_given_tasks(spark):
    from pairloom.operators import trials as R

    links = spark.range(40).select((F.col("id") % 4).alias("pair"), F.col("id").alias("child"))
    children = spark.range(40).selectExpr("id AS child", "'success' AS success", "2 AS phase", "'2001' AS first_date", "'2002' AS last_date")
    made = R.pair_evidence(links, ["pair"], "child", children, tasks=7)
    assert re.search(r"hashpartitioning\(child#\d+L, 7\), REPARTITION_BY_NUM", plan(made))
    assert sorted((r["pair"], r["evidence"][0]["n"]) for r in made.collect()) == [(i, 10) for i in range(4)]
