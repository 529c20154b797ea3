"""Features and projections against numpy on small data."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from pairloom.operators import features as X
from pairloom.operators import similarity as S
from pairloom.session import cut_lineage


def rng(seed=0):
    return np.random.default_rng(seed)


def vector_table(spark, x, ids=None):
    rows = [(int(i), [float(v) for v in row]) for i, row in zip(ids if ids is not None else range(len(x)), x)]
    return spark.createDataFrame(rows, "id bigint, v array<double>").repartition(3)


def with_features(spark, x):
    return vector_table(spark, x).withColumn("features", array_to_vector("v"))


def column(df, name):
    return np.array([r[name] for r in df.orderBy("id").select(name).collect()])


def brute(a, b, k, metric, same):
    if metric == "cosine":
        d = 1 - (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
    else:
        d = np.linalg.norm(a[:, None] - b[None], ord=1 if metric == "manhattan" else 2, axis=2)
    d = np.round(d, 6)
    out = []
    for i in range(len(a)):
        order = sorted((d[i, j], j) for j in range(len(b)) if not (same and i == j))[:k]
        out += [(i, j, round(float(v), 6), r + 1) for r, (v, j) in enumerate(order)]
    return out


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "manhattan"])
@pytest.mark.parametrize("pivots, block", [(None, 2048), (1, 13), (9, 16)])
def test_nearest_is_exact(spark, metric, pivots, block):
    centres = rng(1).normal(size=(6, 5)) * 4
    x = centres[rng(2).integers(0, 6, 150)] + rng(3).normal(size=(150, 5)) * 0.3
    x[40:100] = x[40]  # copies: ties, and one cell that holds a large share of the points
    df = vector_table(spark, x)
    got = S.nearest(df, df.withColumnRenamed("id", "other"), "id", "other", "v", "v", 4, metric, exclude_same=True, pivots=pivots, block=block)
    rows = sorted((r["id"], r["other"], round(r["distance"], 6), r["rank"]) for r in got.collect())
    want = sorted(brute(x, x, 4, metric, True))
    assert [(r[0], r[3]) for r in rows] == [(r[0], r[3]) for r in want] or sorted(r[:2] for r in rows) == sorted(w[:2] for w in want)
    assert sorted(r[:2] for r in rows) == sorted(w[:2] for w in want)


def test_nearest_skips_far_rings(spark):
    """On clustered vectors both rounds together compare a small share of all pairs, and no group holds more than two blocks."""
    centres = rng(1).normal(size=(20, 8)) * 10
    x = centres[rng(2).integers(0, 20, 600)] + rng(3).normal(size=(600, 8)) * 0.1
    q = S._vectors(vector_table(spark, x), "id", "v", "euclidean", "l")
    placed, rings = S._placed(S._vectors(vector_table(spark, x), "id", "v", "euclidean", "r"), 20, "euclidean", 6)
    assert rings.count.sum() == 600 == placed.count() and len(rings.count) > 100
    kth = {i: d for i, _, d, r in brute(x, x, 3, "euclidean", False) if r == 3}
    reach = q.join(spark.createDataFrame(list(kth.items()), "lid long, reach double"), "lid")
    rows = [*S._routed(q, rings, 3, False).collect(), *S._routed(reach, rings, 3, True).collect()]
    share = sum(int(rings.count[r["ring"]]) for r in rows) / 600**2
    assert share < 0.15, share


def test_approximations_spare_most_full_distances(spark):
    """Vectors spread evenly over 64 dimensions: rings rule out nothing, approximations most pairs; and nothing of the result is lost."""
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    for metric in ("euclidean", "cosine", "manhattan"):
        q, p = (S._vectors(table, "vec_id", "embedding", metric, side) for side in "lr")
        pairs = S._candidates(q, p, 5, metric, True, 6, 4, 128)
        n = table.count()
        assert pairs.count() < 0.05 * n * n and pairs.distinct().count() == pairs.count()


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "manhattan"])
def test_nearest_sends_few_copies_of_a_point(spark, metric, monkeypatch):
    """Many parts of the queries: points and queries of the second round are shuffled a few times each, and few pairs are written."""
    from pyspark.sql.classic.dataframe import DataFrame

    written, sent, dealt = [], [], DataFrame.repartitionById

    def counted(df):
        stored = cut_lineage(df)
        if "lower" in stored.columns:
            written.append(stored.count())
        return stored

    monkeypatch.setattr(S, "cut_lineage", counted)
    monkeypatch.setattr(S, "LEAST", 10)
    monkeypatch.setattr(DataFrame, "repartitionById", lambda df, n, by: sent.append(df.count()) or dealt(df, n, by))
    x = rng(7).uniform(-1, 1, size=(600, 16))
    df = vector_table(spark, x)
    got = S.nearest(df, df.withColumnRenamed("id", "other"), "id", "other", "v", "v", 3, metric, exclude_same=True)
    assert sorted((r["id"], r["other"]) for r in got.collect()) == sorted(r[:2] for r in brute(x, x, 3, metric, True))
    assert len(x) < sum(sent) <= 20 * len(x), sent
    assert 3 * len(x) <= sum(written) < 6 * len(x), written


@pytest.mark.parametrize("metric", ["cosine", "manhattan"])
def test_nearest_with_zeros_copies_and_far_values(spark, metric):
    x = np.concatenate([np.zeros((5, 3)), rng(1).normal(size=(40, 3)), np.full((3, 3), 1e6), [[1e-9, 0, 0]] * 4, np.repeat(rng(2).normal(size=(1, 3)), 30, 0)])
    if metric == "cosine":
        a = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        d = np.round(1 - a @ a.T, 6)
    else:
        d = np.round(np.abs(x[:, None] - x[None]).sum(2), 6)
    want = sorted((i, j) for i in range(len(x)) for _, j in sorted((d[i, j], j) for j in range(len(x)) if j != i)[:4])
    df = vector_table(spark, x)
    got = S.nearest(df, df.withColumnRenamed("id", "other"), "id", "other", "v", "v", 4, metric, exclude_same=True, pivots=3, block=11)
    assert sorted((r["id"], r["other"]) for r in got.collect()) == want


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "manhattan"])
def test_nearest_sends_few_copies_of_a_query(spark, metric, monkeypatch):
    """Evenly spread vectors in many rings, of which every query has to look into nearly all: vectors are written a few times each, not once a ring; parts and
    slabs of all sizes find the same."""
    x = rng(5).normal(size=(400, 12))
    written = []

    def counted(df):
        stored = cut_lineage(df)
        if "lvec" in stored.columns:
            written.append(stored.count())
        return stored

    monkeypatch.setattr(S, "cut_lineage", counted)
    monkeypatch.setattr(S, "LEAST", 90, raising=False)
    monkeypatch.setattr(S, "PARTS", 3, raising=False)
    monkeypatch.setattr(S, "SLAB", 150, raising=False)
    df = vector_table(spark, x)
    got = S.nearest(df, df.withColumnRenamed("id", "other"), "id", "other", "v", "v", 4, metric, exclude_same=True, pivots=9, block=16)
    assert sorted((r["id"], r["other"]) for r in got.collect()) == sorted(r[:2] for r in brute(x, x, 4, metric, True))
    assert sum(written) < 10 * len(x), written


def test_nearest_with_few_or_no_points(spark):
    df = vector_table(spark, rng(1).normal(size=(3, 2)))
    other = df.withColumnRenamed("id", "other")
    assert S.nearest(df, other, "id", "other", "v", "v", 10).count() == 9
    assert S.nearest(df, other.limit(0), "id", "other", "v", "v", 10).count() == 0
    assert S.nearest(df.limit(0), other, "id", "other", "v", "v", 10).count() == 0


def test_vote_of_neighbours(spark):
    near = spark.createDataFrame(
        [(1, 10, 1.0), (1, 11, 2.0), (1, 12, 4.0), (2, 10, 0.0), (2, 11, 0.1), (2, 12, 0.1), (3, 10, 1.0), (3, 11, 1.0)], "q int, id int, distance double"
    )
    labels = spark.createDataFrame([(10, 1), (11, 0), (12, 0)], "id int, y int")

    def votes(weights):
        got = S.vote_of_neighbours(near, labels, "q", "id", "y", weights).collect()
        return {r["q"]: (r["prediction"], round(r["probability"], 6)) for r in got}

    assert votes("uniform") == {1: (0, 0.333333), 2: (0, 0.333333), 3: (0, 0.5)}
    assert votes("distance") == {1: (1, 0.571429), 2: (1, 1.0), 3: (0, 0.5)}


def test_tfidf_and_svd(spark):
    docs = spark.createDataFrame([(1, "R-1 R-2 R-2"), (2, "R-2"), (3, "")], "id int, text string")
    weights = X.tfidf(X.token_counts(docs, "id", "text"), "id", 2)
    got = {(r["id"], r["term"]): round(r["weight"], 6) for r in weights.collect()}
    assert got == {(1, "r-1"): 0.574962, (1, "r-2"): 0.81818, (2, "r-2"): 1.0}

    x = rng(4).random((30, 8)) * (rng(5).random((30, 8)) < 0.6)
    x[:, 0] += 0.1
    cells = [(i, f"t{j}", float(x[i, j])) for i in range(30) for j in range(8) if x[i, j]]
    long = spark.createDataFrame(cells, "id int, term string, weight double").repartition(3)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    for extra, rounds, near in ((8, 3, 1e-6), (2, 40, 1e-4)):  # the whole space at once, and a part of it
        scores, sigma, right = X.truncated_svd(long, "id", "term", 4, rounds=rounds, extra=extra)
        assert sigma == pytest.approx(s[:4])
        assert np.abs(column(scores, "latent")) == pytest.approx(np.abs(u[:, :4] * s[:4]), abs=near)
        assert np.abs(np.array([r["v"] for r in right.orderBy("term").collect()])) == pytest.approx(np.abs(vt[:4].T), abs=near)
    none = X.truncated_svd(long.limit(0), "id", "term", 4)
    assert none[0].count() == 0 and len(none[1]) == 0


def test_standardize_and_pca(spark):
    x = rng(6).normal(size=(40, 6)) @ rng(7).normal(size=(6, 6)) + 5
    df = X.standardized(with_features(spark, x))
    z = (x - x.mean(0)) / x.std(0)
    assert column(df.withColumn("a", vector_to_array("scaled")), "a") == pytest.approx(z)
    scored, ratios, loadings = X.principal_components(with_features(spark, x), 3)
    c = x - x.mean(0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    assert ratios == pytest.approx((s**2 / (s**2).sum())[:3])
    assert np.abs(column(scored, "components")) == pytest.approx(np.abs(c @ vt[:3].T))
    assert np.abs(loadings) == pytest.approx(np.abs(vt[:3].T * s[:3] / np.sqrt(39)))
    assert X.strong_loadings(np.array([[0.6, 0.0], [0.1, 0.1]]), ["a", "b"]) == ["a"]


def test_discriminant(spark):
    x = rng(8).normal(size=(60, 4))
    y = np.arange(60) % 2
    x[y == 1] += [1.0, -0.5, 0.0, 2.0]
    df = with_features(spark, x).withColumn("y", (F.col("id") % 2).cast("int"))
    got, axis = X.discriminant_axis(df, "features", "y")
    m0, m1 = x[y == 0].mean(0), x[y == 1].mean(0)
    sw = ((x[y == 0] - m0).T @ (x[y == 0] - m0) + (x[y == 1] - m1).T @ (x[y == 1] - m1)) / 58
    w = np.linalg.solve(sw, m1 - m0)
    w /= np.sqrt(w @ sw @ w)
    assert axis == pytest.approx(w)
    assert column(got, "discriminant") == pytest.approx((x - x.mean(0)) @ w)


def test_pls(spark):
    x = rng(9).normal(size=(50, 5)) * [1, 2, 3, 4, 5]
    y = x @ [0.5, 0.1, 0.0, -0.2, 0.3] + rng(10).normal(size=50)
    rows = [(i, [float(v) for v in x[i]], float(y[i])) for i in range(50)]
    df = spark.createDataFrame(rows, "id int, v array<double>, y double").repartition(3).withColumn("features", array_to_vector("v"))
    got, _ = X.pls_axes(df, "features", "y", 2)
    z, t = (x - x.mean(0)) / x.std(0, ddof=1), (y - y.mean()) / y.std(ddof=1)
    for i in range(2):  # textbook deflation
        w = z.T @ t
        w /= np.linalg.norm(w)
        s = z @ w
        assert column(got, f"pls_{i}") == pytest.approx(s)
        p = z.T @ s / (s @ s)
        z, t = z - np.outer(s, p), t - s * (t @ s) / (s @ s)


def test_hot_columns(spark):
    df = spark.createDataFrame([(1, "achiral"), (2, "mixture"), (3, "single_enantiomer"), (4, None)], "id int, chirality string")
    wide = X.one_hot(df, "chirality", ["mixture", "achiral", "single_enantiomer"])
    assert wide.columns == ["id", "chirality__mixture", "chirality__single_enantiomer", "chirality__nan"]
    assert sorted(tuple(r) for r in wide.collect()) == [(1, 0, 0, 0), (2, 1, 0, 0), (3, 0, 1, 0), (4, 0, 0, 1)]
    sets = spark.createDataFrame([(1, ["b", "a"]), (2, []), (3, None)], "id int, cats array<string>")
    multi = X.multi_hot(sets, "cats", ["a", "b"])
    assert multi.columns == ["id", "cat_a", "cat_b"]
    assert sorted(tuple(r) for r in multi.collect()) == [(1, 1, 1), (2, 0, 0), (3, 0, 0)]


def test_hot_rows_of_many_classes(spark):
    many = spark.range(5000).select("id", F.format_string("c%05d", "id").alias("c"))
    rows, index = X.one_hot_rows(many.union(spark.createDataFrame([(5000, None)], "id long, c string")), "id", "c")
    assert index.count() == 5000 and rows.where("id = index").count() == 5000 and rows.where("index IS NULL").count() == 1
    sets = many.select("id", F.array("c", F.lit("c00007"), "c").alias("cs")).union(spark.createDataFrame([(5000, None)], "id long, cs array<string>"))
    got = {r["id"]: r["indices"] for r in X.multi_hot_rows(sets, "id", "cs")[0].collect()}
    assert got[3] == [3, 7] and got[4999] == [7, 4999] and got[5000] == [] and len(got) == 5001


def test_text_vectors_and_fingerprints(spark):
    df = spark.createDataFrame([(1, "Asthma"), (2, "asthma"), (3, "gout")], "id int, text string")
    v = column(X.text_vectors(df, "text"), "vector")
    assert v[0] == pytest.approx(v[1]) and np.linalg.norm(v[2]) == pytest.approx(1.0)
    own = X.text_vectors(df, "text", encoder=lambda texts: np.array([[len(t), t.count("a")] for t in texts]))
    assert column(own, "vector").tolist() == [[6, 2], [6, 2], [4, 0]]
    bits = X.fingerprints(df, "text", bits=64).select(vector_to_array("fingerprint").alias("f")).collect()
    assert set(np.unique([r["f"] for r in bits])) <= {0.0, 1.0}


def test_trigrams_are_counted_in_batches(spark, monkeypatch):
    """Not by a list of texts a character; texts of all lengths, letters and batches count the same."""
    monkeypatch.setattr(X, "AT_ONCE", (3, 40), raising=False)
    texts = [None, "", "a", "ab", "abc", "ABCabc", "Grüße, ß ñ \u4e2d\u6587 abc abc", "x" * 50, " \n\t\x00 end", "\u0130stanbul"] * 3
    df = spark.createDataFrame([*enumerate(texts)], "id int, t string")
    made = X.text_vectors(df, "t").withColumn("low", F.lower("t"))
    for r in made.collect():
        low, want = r["low"] or "", np.zeros(256)
        for a, b, c in zip(low, low[1:], low[2:]):
            want[(ord(a) * 961 + ord(b) * 31 + ord(c)) % 256] += 1
        assert np.allclose(r["vector"], want / max(np.linalg.norm(want), 1), rtol=1e-14), low
    assert "ArrowEvalPython" in made._jdf.queryExecution().executedPlan().toString()


def test_pair_cosine(spark):
    x = rng(11).normal(size=(6, 3))
    pairs = spark.createDataFrame([(0, 1), (2, 2), (5, 3)], "l bigint, r bigint")
    table = vector_table(spark, x)
    got = X.pair_cosine(pairs, table.withColumnRenamed("id", "l"), table.withColumnRenamed("id", "r"), "l", "r", "v", "v")
    for r in got.collect():
        a, b = x[r["l"]], x[r["r"]]
        assert r["similarity"] == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b))


def test_svd_iterates_and_keeps_small_values(spark, monkeypatch):
    """More columns than vectors in the iteration, and values from 1 down to 1e-10 of the first: all are found."""
    rounds = []
    kept = X._orthonormal
    monkeypatch.setattr(X, "_orthonormal", lambda v, k: rounds.append(k) or kept(v, k))
    u, _ = np.linalg.qr(rng(1).normal(size=(60, 30)))
    v, _ = np.linalg.qr(rng(2).normal(size=(30, 30)))
    s = np.array([10.0 ** (-2.5 * i) for i in range(5)] + [0.0] * 25)
    x = u * s @ v.T
    long = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(60) for j in range(30)], "id int, term int, weight double")
    _, sigma, _ = X.truncated_svd(long, "id", "term", 5, extra=3)
    assert sigma == pytest.approx(s[:5], rel=1e-4)

    s = 0.7 ** np.arange(30)
    x = u * s @ v.T
    long = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(60) for j in range(30)], "id int, term int, weight double")
    rounds.clear()
    scores, sigma, right = X.truncated_svd(long, "id", "term", 3, extra=5)
    assert len(rounds) >= 4 and sigma == pytest.approx(s[:3], rel=1e-12)
    assert np.abs(column(scores, "latent")) == pytest.approx(np.abs(u[:, :3] * s[:3]), abs=1e-6)


def test_triangle_of_a_tree(spark, monkeypatch):
    monkeypatch.setattr(X, "FAN_IN", 2)
    x = rng(3).normal(size=(50, 4)) * [1, 1e-4, 1e-8, 1e-12]
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(9)
    assert np.linalg.svd(X._triangle(df, 4))[1] == pytest.approx(np.linalg.svd(x)[1], rel=1e-3)
    assert X._triangle(df.limit(0), 4).shape == (0, 4) and X._triangle(df.limit(2), 4).shape[0] == 2
    assert X.standardized(with_features(spark, x).limit(0)).count() == 0


class Slow:
    """An encoder that leaves a mark in a folder whenever it is built, and another for every text it is given."""

    def __init__(self, folder):
        import os
        import uuid

        self.folder = folder
        open(f"{folder}/built-{os.getpid()}-{uuid.uuid4().hex}", "w").close()

    def __call__(self, texts):
        import uuid

        for t in texts:
            open(f"{self.folder}/text-{t}-{uuid.uuid4().hex}", "w").close()
        return np.array([[len(t), t.count("a")] for t in texts], float)


def test_encoder_is_built_once_a_worker(spark, tmp_path):
    import os

    folder = str(tmp_path)
    cls = Slow

    def factory():
        return cls(folder)

    df = spark.createDataFrame([(i, [None, "", "Banana", "banana", "kiwi"][i % 5]) for i in range(200)], "id int, t string").repartition(16)
    got = {r["id"]: r["vector"] for r in X.text_vectors(df, "t", factory).collect()}
    assert got == {i: [[0, 0], [0, 0], [6, 3], [6, 3], [4, 0]][i % 5] for i in range(200)}
    marks = os.listdir(folder)
    built = [m.split("-")[1] for m in marks if m.startswith("built")]
    assert len(built) == len(set(built)) and built
    assert sorted(m.split("-")[1] for m in marks if m.startswith("text")) == ["", "banana", "kiwi"]
    with pytest.raises(Exception, match="the encoder made 1 rows"):
        X.text_vectors(df, "t", lambda: lambda texts: np.zeros((1, 2))).collect()


def test_weighted_sums_stay_plain_numbers(spark):
    """Sums of vectors as objects would leave the hash table after 128 rows a task and sort all entries."""
    entries = spark.createDataFrame([(1, "a", 2.0), (1, "b", 3.0), (2, "a", 1.0)], "row int, term string, weight double")
    vectors = spark.createDataFrame([("a", [1.0, 0.5]), ("b", [2.0, -1.0])], "term string, v array<double>")
    found = X._weighted_sums(entries, "row", "term", vectors, 2)
    assert {r["row"]: r["v"] for r in found.collect()} == {1: [8.0, -2.0], 2: [1.0, 0.5]}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "ObjectHashAggregate" not in plan


@pytest.mark.parametrize("metric, kind", [("euclidean", "spread"), ("euclidean", "far"), ("euclidean", "odd"), ("manhattan", "spread"), ("manhattan", "far"), ("manhattan", "odd"), ("cosine", "spread")])
def test_sweep_measures_few_pairs_and_loses_none(metric, kind, monkeypatch):
    """Bounds by short numbers and by steps: for vectors far from 0, next to each other, or with outliers."""
    draw = np.random.default_rng(11)
    points = draw.normal(size=(3000, 13))
    if kind == "far":
        points = points * 1e-3 + 5e4
    if kind == "odd":
        points[::500] *= 1e18
    if metric == "cosine":
        points /= np.linalg.norm(points, axis=1)[:, None]
        points[7] = 0.0
    queries, k = np.concatenate([points[:201], points[:1] + 0.5 if metric != "cosine" else (points[:1] + points[1:2]) / np.linalg.norm(points[0] + points[1])]), 4
    whole = np.stack([np.abs(points - q).sum(1) if metric == "manhattan" else np.sqrt(((points - q) ** 2).sum(1)) for q in queries])
    if metric == "cosine":
        whole[:, 7] = whole[7] = S.RIGHT_ANGLE
    sample = points[draw.permutation(3000)[:300]]
    centres, ring = sample[:2], np.arange(3000) // 100
    away = S.distances(points, centres[:1], metric)[:, 0]
    rings = S.Rings(centres, np.zeros(30, int), np.full(30, 100), away.reshape(30, 100).min(1) - 1e-6, away.reshape(30, 100).max(1) + 1e-6, metric, 6)
    rings.sieve = (S.Stairs if metric == "manhattan" else S.Sieve)(sample)
    measured, apart = [0], S._apart
    monkeypatch.setattr(S, "_apart", lambda a, b, m: measured.__setitem__(0, measured[0] + len(a)) or apart(a, b, m))
    part = S._Part(rings, k, metric, True, 64)
    lists = lambda v: pa.array([list(map(float, r)) for r in v], pa.list_(pa.float64()))
    ids = np.append(np.arange(201), 9999)
    part.ask(pa.RecordBatch.from_arrays([pa.array(ids), lists(queries), pa.array(np.sort(whole[:, :256], 1)[:, k] * (1 + 1e-6) + 1e-6)], names=["lid", "lvec", "reach"]))
    for r in range(30):
        part.look(r, pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(ring == r)), lists(points[ring == r])], names=["rid", "rvec"]))
    found = [t for b in part.found() for t in zip(b.column("lid").to_pylist(), b.column("rid").to_pylist(), b.column("lower").to_pylist(), b.column("upper").to_pylist())]
    best = {}
    for left, right, low, high in found:
        row = 201 if left == 9999 else left
        assert left != right and low <= whole[row, right] * (1 + 1e-9) + 1e-9 and whole[row, right] <= high * (1 + 1e-9) + 1e-9
        best.setdefault(left, set()).add(right)
    for row, left in enumerate(ids):
        others = [j for j in np.argsort(whole[row], kind="stable") if j != left]
        if not (metric == "cosine" and left == 7):
            assert set(others[:k]) <= best[left]
    if kind != "odd":
        assert measured[0] < 0.25 * whole.size
