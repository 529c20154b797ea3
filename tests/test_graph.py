"""Graph operators on a hand-made graph."""

import pytest
from pyspark.sql import functions as F

from pairloom.operators import graph as N
from pairloom.session import cut_lineage


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(
        [("d", "d1", "in", "p", "p1"), ("d", "d1", "in", "p", "p2"), ("d", "d2", "in", "p", "p2"), ("s", "s1", "in", "p", "p2")],
        "src_kind string, src string, kind string, dst_kind string, dst string",
    )


@pytest.fixture(scope="module")
def features(spark):
    return spark.createDataFrame(
        [("d", "d1", [1.0, 2.0]), ("d", "d2", [3.0, 4.0]), ("s", "s1", [5.0]), ("p", "p1", [1.0]), ("p", "p2", [1.0])], "kind string, id string, features array<double>"
    )


@pytest.mark.parametrize("width", [2, 40])
def test_hop_adds_type_means(edges, features, width):
    got = {(r["kind"], r["id"]): r["features"][:2] for r in N.hop(edges, features, width).collect()}
    assert got == {("p", "p1"): [1.0, 2.0], ("p", "p2"): [2.0 + 5.0, 3.0]}


def test_propagate_keeps_isolated_nodes(edges, features):
    got = {r["id"]: r["features"] for r in N.propagate(edges, features, 2, hops=2).collect()}
    assert got["s1"] == [5.0, 0.0, 0.0, 0.0, 0.0, 0.0] and got["p1"][:4] == [1.0, 0.0, 1.0, 2.0]


def test_reverse_support_collapse(spark, edges):
    turned = N.with_reverse(edges)
    assert turned.count() == 8 and turned.filter("src = 'p1'").first()["kind"] == "rev_in"
    pairs = spark.createDataFrame([("d1", "d2"), ("d1", "s1"), ("d2", "x")], "a string, b string")
    got = {(r["a"], r["b"]): r["paths"] for r in N.metapath_support(pairs, "a", "b", edges, edges).collect()}
    assert got == {("d1", "d2"): 1, ("d1", "s1"): 1, ("d2", "x"): 0}
    twice = edges.withColumn("w", F.lit(1)).union(edges.select("src_kind", "src", F.lit("late").alias("kind"), "dst_kind", "dst", F.lit(2)))
    kept = N.collapse(twice, "w", "w").collect()
    assert len(kept) == 4 and {(r["kind"], r["w"]) for r in kept} == {("late", 2)}


def test_nodes_edges_summary(spark):
    left = spark.createDataFrame([("b", ["x", "y"], 2), ("a", ["x"], 1)], "id string, toks array<string>, f int")
    tables = {"d": N.nodes(left, "d", "id", ["f"]), "p": N.token_nodes("p", (left, "toks"))}
    nodes = tables["d"].unionByName(tables["p"])
    assert {(r["kind"], r["id"], r["idx"], r["features"][0]) for r in nodes.collect()} == {("d", "a", 0, 1.0), ("d", "b", 1, 2.0), ("p", "x", 0, 1.0), ("p", "y", 1, 1.0)}
    made = N.list_edges(left, "d", "id", "toks", "in", "p")
    assert {(r["src_idx"], r["dst_idx"]) for r in N.indexed_edges(made, tables).collect()} == {(0, 0), (1, 0), (1, 1)}
    report = {(r["part"], r["name"]): (r["n"], r["median_degree"]) for r in N.graph_summary(nodes, made).collect()}
    assert report == {("node", "d"): (2, None), ("node", "p"): (2, None), ("edge", "d-in-p"): (3, 1.5)}


def test_map_edges(spark):
    df = spark.createDataFrame([("d1", {"INHIBITOR": ["u1", "u2"], "": ["u3"]}), ("d2", None)], "id string, m map<string,array<string>>")
    got = {(r["dst"], r["action"]) for r in N.map_edges(df, "d", "id", "m", "targets", "t", "action").collect()}
    assert got == {("u1", "INHIBITOR"), ("u2", "INHIBITOR"), ("u3", "")}


@pytest.mark.parametrize("width", [2, 40])
def test_null_elements_do_not_count(spark, edges, width):
    holes = spark.createDataFrame([("d", "d1", [1.0, None]), ("d", "d2", [3.0, 4.0]), ("s", "s1", [None, None])], "kind string, id string, features array<double>")
    got = {r["id"]: r["features"][:2] for r in N.hop(edges, holes, width).collect()}
    assert got == {"p1": [1.0, 0.0], "p2": [2.0, 4.0]}


def test_collapse_breaks_ties(spark):
    rows = spark.createDataFrame([("a", "1", "z", "b", "2", 5, 9), ("a", "1", "y", "b", "2", 5, 1)], "src_kind string, src string, kind string, dst_kind string, dst string, at int, w int")
    assert [(r["kind"], r["w"]) for r in N.collapse(rows, "at", "w").collect()] == [("y", 1)]


@pytest.mark.parametrize("light", [0, 2, 4096])
def test_metapaths_of_light_and_heavy_entities(spark, monkeypatch, light):
    monkeypatch.setattr(N, "LIGHT", light)
    left = {"a": "xyz", "b": "x", "c": "", "d": "wxyz"}
    right = {"p": "xy", "q": "zwv", "r": "", "s": "vwxyz"}

    def edges(sides):
        return spark.createDataFrame([(e, t) for e, ts in sides.items() for t in ts * 2], "src string, dst string")

    pairs = [(a, p) for a in left for p in right] + [("a", "p"), ("nobody", "p")]
    got = N.metapath_support(spark.createDataFrame(pairs, "l string, r string"), "l", "r", edges(left), edges(right)).collect()
    assert sorted(map(tuple, got)) == sorted((a, p, len(set(left.get(a, "")) & set(right[p]))) for a, p in pairs)


def test_sums_of_vectors_stay_plain_numbers(spark, edges, features):
    """Sums of vectors as objects would leave the hash table after 128 groups a task and sort all messages."""
    plan = N.hop(edges, features, 2)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "ObjectHashAggregate" not in plan


def test_cells_of_light_entities_meet_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(N, "cut_lineage", lambda df: written.append(df) or cut_lineage(df))
    edges = spark.createDataFrame([("a", "x"), ("a", "y"), ("p", "y"), ("p", "x")], "src string, dst string")
    pairs = spark.createDataFrame([("a", "p"), ("a", "p"), ("a", "q"), (None, "p")], "l string, r string")
    got = N.metapath_support(pairs, "l", "r", edges, edges)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (*written, got)]
    assert len(written) == 1 and [p.count("array_intersect") > 0 for p in plans] == [True, False]
    assert sorted(map(tuple, got.collect()), key=str) == [("a", "p", 2), ("a", "p", 2), ("a", "q", 0), (None, "p", 0)]
