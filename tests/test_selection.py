"""Rows at positions of an order against sorted lists, and the plans of the splits that rest on them."""

import datetime as dt
import random
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pairloom.operators import ordering, selection


def narrow(monkeypatch):
    """Count in eight buckets or fewer down to four rows, so that every range is narrowed many times."""
    monkeypatch.setattr(selection, "BUCKET_BITS", 3)
    monkeypatch.setattr(selection, "FEW_ROWS", 4)


def spark_order(v):
    """Sort key of a cell in Spark's order: null, then numbers with NaN last, or texts by bytes."""
    if v is None:
        return (0,)
    if isinstance(v, float):
        return (1, v != v, 0.0 if v != v else v)
    return (1, v.encode() if isinstance(v, str) else v)


DRAW = random.Random(4)
COLUMNS = {
    "long": ("long", lambda: DRAW.choice([None, 0, -1, 1, 2**63 - 1, -(2**63), DRAW.randint(-(10**6), 10**6), DRAW.randint(-(2**62), 2**62)])),
    "int": ("int", lambda: DRAW.randint(0, 6)),
    "double": ("double", lambda: DRAW.choice([None, float("nan"), float("inf"), float("-inf"), 0.0, 1e308, -1e308, 5e-324, 1e-300, DRAW.gauss(0, 1), DRAW.gauss(0, 1e9)])),
    "string": ("string", lambda: DRAW.choice([None, "", "a", "ab", "é", "\U0001f600", "common prefix " * 3 + str(DRAW.randint(0, 999)), chr(DRAW.randint(32, 3000)) * DRAW.randint(0, 9)])),
    "date": ("date", lambda: DRAW.choice([None, dt.date(1969, 12, 31), dt.date(2000, 1, 1) + dt.timedelta(DRAW.randint(0, 9000))])),
    "time": ("timestamp", lambda: dt.datetime(1960, 1, 1) + dt.timedelta(microseconds=DRAW.randint(0, 10**15))),
    "decimal": ("decimal(12,2)", lambda: DRAW.choice([None, Decimal(DRAW.randint(-(10**6), 10**6)) / 100])),
    "flag": ("boolean", lambda: DRAW.choice([None, True, False])),
}


@pytest.mark.parametrize("name", COLUMNS)
def test_positions(spark, name, monkeypatch):
    if name in ("long", "double", "string"):
        narrow(monkeypatch)
    kind, draw = COLUMNS[name]
    data = [(DRAW.choice(["x", "x", "y", None]), draw(), i) for i in range(300)]
    df = spark.createDataFrame(data, f"g string, v {kind}, id int").repartition(5)
    groups = defaultdict(list)
    for g, v, i in data:
        groups[g].append((spark_order(v), i))
    wanted = [(g, s, p) for g, rows in groups.items() for s, p in enumerate([0, 1, len(rows) // 2, len(rows) // 2, len(rows) - 1, len(rows), -1])]
    found = selection.rows_at(df, "g", spark.createDataFrame(wanted, "g string, slot int, position long"), ["v", "id"], ["id"])
    got = {(r["g"], r["slot"]): r["id"] for r in found.collect()}
    assert got == {(g, s): sorted(groups[g])[p][1] for g, s, p in wanted if 0 <= p < len(groups[g])}
    assert all(r["key"]["key1"] == r["id"] for r in found.collect())


def test_equal_keys_and_no_rows(spark):
    df = spark.createDataFrame([(7, i) for i in range(600)] + [(8, 0)], "v int, keep int")
    assert {(r["slot"], r["key"]["key0"]) for r in selection.rows_at(df, None, [0, 599, 600, 601], ["v"]).collect()} == {(0, 7), (1, 7), (2, 8)}
    assert selection.rows_at(df.limit(0), None, [0], ["v"]).count() == 0
    with pytest.raises(TypeError):
        selection.rows_at(df.withColumn("a", F.array("v")), None, [0], ["a"])


def test_splits_sort_and_write_nothing_of_the_table(spark, monkeypatch):
    written = []
    monkeypatch.setattr(selection, "cut_lineage", lambda df: written.append(rows := df.collect()) or spark.createDataFrame(rows, df.schema))
    monkeypatch.setattr(ordering, "cut_lineage", lambda df: pytest.fail("a copy of the table"))
    df = spark.range(0, 20000, 1, 6).selectExpr("id", "id * 7919 % 20011 AS day", "id % 3 = 0 AS hit")
    parts = ordering.time_split(df, "day", "id")
    folds = ordering.stratified_folds(df, "hit", 5, "day", "id")
    split = ordering.stratified_split(df, "hit", "id")
    assert "rangepartitioning" not in parts._jdf.queryExecution().executedPlan().toString() and "Exchange" not in parts._jdf.queryExecution().executedPlan().toString()
    assert parts.where("part = 'train'").count() == 17000 and parts.where("part = 'train'").agg(F.max("day")).first()[0] <= parts.where("part = 'test'").agg(F.min("day")).first()[0]
    value = ordering.value_at(df, "day", 0.5, "day", "id")
    assert value.first()[0] == sorted(i * 7919 % 20011 for i in range(20000))[10000]
    for made in (folds, split, value):
        assert "rangepartitioning" not in made._jdf.queryExecution().executedPlan().toString()
    assert {r["count"] for r in folds.groupBy("hit", "fold").count().collect()} == {2666, 2667, 1333, 1334}
    assert max(map(len, written)) <= 8 and len(written) > 4


def test_many_classes_and_small_ones(spark, monkeypatch):
    narrow(monkeypatch)
    df = spark.range(500).selectExpr("id", "CASE WHEN id < 60 THEN id WHEN id < 65 THEN NULL ELSE -1 END AS c")
    folds = ordering.stratified_folds(df, "c", 4, "id")
    groups = defaultdict(list)
    for r in folds.collect():
        groups[r["c"]].append((r["id"], r["fold"]))
    assert sum(map(len, groups.values())) == 500
    for rows in groups.values():
        assert [f for _, f in sorted(rows)] == [k * 4 // len(rows) for k in range(len(rows))]
    assert {r["fold"] for r in ordering.stratified_folds(df, "c", 1, "id").collect()} == {0}
    split = ordering.stratified_split(df, "c", "id", 0.5).groupBy("c", "part").count().collect()
    assert {(r["c"], r["part"]): r["count"] for r in split}[None, "train"] == 2 and sum(r["count"] for r in split) == 500
