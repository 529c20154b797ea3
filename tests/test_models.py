"""Classifiers and their evaluation on a small separable table."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from pairloom.operators import evaluate as V
from pairloom.operators import models as M
from pairloom.operators.ordering import stratified_folds

NAMES = ["a", "b", "noise"]


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(120, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.2 * r.normal(size=120) > 0.4).astype(float)
    rows = [(i, *map(float, x[i]), float(y[i])) for i in range(120)]
    rows[5] = (5, None, *rows[5][2:])
    df = spark.createDataFrame(rows, "id bigint, a double, b double, noise double, y double").coalesce(1)
    return stratified_folds(df, "y", 3, "id").coalesce(1).persist()


@pytest.fixture(scope="module")
def model(table):
    return Pipeline(stages=[*M.preprocessing(NAMES), *M.classifier("logreg", {"C": 1.0}, 120, "y", "class_weight")]).fit(table)


def test_class_weights_come_from_the_training_rows(spark, table):
    fitted = M.BalancedWeight("y").fit(table.where("id < 60"))
    totals = {r["y"]: r["s"] for r in fitted.transform(table.where("id < 60")).groupBy("y").agg(F.sum("class_weight").alias("s")).collect()}
    assert totals[0.0] == pytest.approx(30) and totals[1.0] == pytest.approx(30)
    other = {r["y"]: r["class_weight"] for r in fitted.transform(table).select("y", "class_weight").distinct().collect()}
    assert len(other) == 2 and fitted.transform(table.drop("y")).select("class_weight").distinct().first()[0] == 1.0


def test_grids_have_the_published_sizes():
    sizes = {name: len(M.combinations(grid)) for name, grid in M.GRIDS.items()}
    assert sizes == {"knn": 16, "logreg": 25, "svm_linear": 4, "svm_poly": 18, "svm_rbf": 6, "rf": 36, "gb": 24, "xgb": 96}


@pytest.mark.parametrize("width", [2, 5, 50])
@pytest.mark.parametrize("kernel", ["poly", "rbf"])
def test_kernel_features_use_all_columns(spark, kernel, width):
    x = np.random.default_rng(width).normal(size=(30, width))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(30)], "id int, v array<double>").withColumn("features", array_to_vector("v"))
    fitted = M.KernelFeatures("features", "k", kernel, degree=2, width="auto", size=20_000).fit(df)
    z = np.array([r["k"] for r in fitted.transform(df).orderBy("id").select(vector_to_array("k").alias("k")).collect()])
    inner = x @ x.T
    want = (inner / width) ** 2 if kernel == "poly" else np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / width)
    assert np.abs(z @ z.T - want).max() < 0.1 * max(want.max(), 1)
    assert M.KernelFeatures("features", "k", kernel, width="scale").fit(df).getOrDefault("gamma") == pytest.approx(1 / (width * x.var()))


@pytest.mark.parametrize("name, grid", [
    ("logreg", {"C": [0.1, 10]}), ("svm_linear", {"C": [1], "max_iter": [10]}), ("svm_poly", {"C": [1], "degree": [3], "max_iter": [30]}),
    ("svm_rbf", {"C": [1], "gamma": ["auto"], "max_iter": [10]}), ("rf", {"n_estimators": [5], "max_depth": [4], "min_samples_split": [5]}), ("gb", {"n_estimators": [3], "max_depth": [3]}),
    ("xgb", {"n_estimators": [3], "max_depth": [3], "colsample_bytree": [0.8], "gamma": [0.1]}),
])
def test_grid_search(table, name, grid):
    found = M.grid_search(table, name, NAMES, "y", "fold", grid)
    assert len(found.rows) == len(M.combinations(grid)) and max(r["mean_score"] for r in found.rows) > 0.7
    scored = M.score_table(found.best, table, ["id", "y"])
    assert V.scores(scored, "y", "prediction").first()["f1"] > 0.7


def test_knn_search_and_summary(spark, table, tmp_path):
    found = M.knn_search(table, "id", ["a", "b"], "y", "fold", {"n_neighbors": [3, 9], "weights": ["uniform", "distance"], "p": [1, 2]})
    assert len(found.rows) == 8 and max(r["mean_score"] for r in found.rows) > 0.7
    scored = M.score_table(found.best, table.unionByName(table), ["id", "y"])
    assert scored.count() == 240 and V.scores(scored, "y", "prediction").first()["f1"] > 0.7
    M.save_model(found.best, str(tmp_path / "nearest"))
    again = M.score_table(M.load_model(str(tmp_path / "nearest"), spark), table, ["id"])
    assert sorted(again.collect()) == sorted(M.score_table(found.best, table, ["id"]).collect())
    other = M.Search("rf", [{"model": "rf", "params": {"max_depth": 3}, "mean_score": 0.1, "std_score": 0.0}])
    assert [r["model"] for r in M.summary(spark, [other, found]).collect()] == ["knn", "rf"]


def test_save_and_load(table, model, tmp_path):
    M.save_model(model, str(tmp_path / "m"))
    again = M.load_model(str(tmp_path / "m"))
    columns = ["id", "prediction", "score"]
    assert sorted(M.score_table(again, table, ["id"]).select(columns).collect()) == sorted(M.score_table(model, table, ["id"]).select(columns).collect())


def test_curves(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0)], "s double, y int")
    got = V.ranking_metrics(df, "s", "y").first()
    assert got["roc_auc"] == pytest.approx(0.875) and got["average_precision"] == pytest.approx(0.833333, abs=1e-6) and got["positive_rate"] == 0.5
    perfect = spark.createDataFrame([(0.9, 1), (0.1, 0)], "s double, y int")
    assert V.ranking_metrics(perfect, "s", "y").first()["roc_auc"] == 1.0
    assert [(r["fpr"], r["tpr"]) for r in V.roc_curve(df, "s", "y").orderBy(F.desc("threshold")).collect()] == [(0.0, 0.5), (0.5, 1.0), (1.0, 1.0)]


def test_scores_without_positives(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, z int")
    assert tuple(V.scores(df, "y", "z").first()) == (1.0, 0.0, 0.0, 0.0)
    assert sum(r["n"] for r in V.confusion(df, "y", "z").collect()) == 2


def test_case_correlations_drop_features_without_value(spark):
    df = spark.createDataFrame([(1, 1, 0.1, 2.0), (0, 1, 0.9, 2.0), (0, 0, 0.4, 2.0)], "y int, z int, f double, flat double")
    got = V.case_correlations(V.case_table(df, "y", "z"), ["f", "flat"]).collect()
    assert [r["feature"] for r in got] == ["f"] and got[0]["FN"] is None


def test_permutation_importance(table, model):
    got = {r["feature"]: r["importance"] for r in V.permutation_importance(model, table, NAMES, "y", "id", repeats=4).collect()}
    assert got["a"] > got["b"] > abs(got["noise"]) - 0.05
    again = {r["feature"]: r["importance"] for r in V.permutation_importance(model, table.repartition(3), NAMES, "y", "id", repeats=4).collect()}
    assert again == pytest.approx(got)


def test_partial_dependence(spark, table, model):
    grid = V.dependence_grid(table, "a", points=12)
    assert len(grid) == 12 and grid == sorted(grid)
    curve = [r["score"] for r in V.partial_dependence(model, table, "a", grid).collect()]
    assert curve == sorted(curve)
    each = V.partial_dependence(model, table, "a", grid[:2], "id")
    assert each.count() == 240
    assert each.filter(F.col("value") == grid[0]).agg(F.avg("score")).first()[0] == pytest.approx(curve[0])
    assert V.partial_dependence_2d(model, table, ("a", "b"), (grid[:2], [0.0, 1.0, 2.0])).count() == 6
    assert V.dependence_grid(spark.createDataFrame([(1.0,), (0.0,), (1.0,), (None,)], "v double"), "v") == [0.0, 1.0]


def test_model_importance(spark, table, model):
    assert V.model_importance(spark, model, NAMES).first()["feature"] == "a"
    forest = Pipeline(stages=[*M.preprocessing(NAMES), *M.classifier("rf", {"n_estimators": 5, "max_depth": 3}, 120, "y", None)]).fit(table)
    assert V.model_importance(spark, forest, NAMES).first()["feature"] == "a"


def test_most_frequent_is_fitted(spark):
    df = spark.createDataFrame([("x", 1), ("x", None), (None, 1), ("y", 2)], "c string, n int")
    fitted = M.MostFrequent(["c", "n"]).fit(df)
    assert sorted(map(tuple, fitted.transform(df).collect())) == [("x", 1), ("x", 1), ("x", 1), ("y", 2)]
    other = spark.createDataFrame([(None, None), ("z", 7), ("z", 7)], "c string, n int")
    assert sorted(map(tuple, fitted.transform(other).collect())) == [("x", 1), ("z", 7), ("z", 7)]


@pytest.mark.parametrize("kernel, degree", [("rbf", 3), ("poly", 2), ("poly", 3), ("poly", 4)])
def test_landmark_features(spark, tmp_path, kernel, degree):
    """Exact when all rows are landmarks, near it with some of them; copies of a row are one landmark; saved and loaded."""
    import numpy as np
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = np.random.default_rng(4).normal(size=(60, 3))
    x[50:] = x[0]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, a array<double>").select("id", array_to_vector("a").alias("x")).repartition(3)

    def products(model):
        rows = model.transform(df).select("id", vector_to_array("k").alias("k")).orderBy("id").collect()
        made = np.array([r["k"] for r in rows])
        return made @ made.T

    all_ = M.KernelFeatures("x", "k", kernel, degree, "scale").fit(df)
    gamma = 1 / (3 * x.var())
    exact = M.kernel_matrix(x, x, kernel, gamma, degree)
    assert all_.getOrDefault("rows") == 50 and products(all_) == pytest.approx(exact, abs=1e-6)
    some = M.KernelFeatures("x", "k", kernel, degree, "auto", size=35).fit(df)
    exact = M.kernel_matrix(x, x, kernel, 1 / 3, degree)
    assert some.getOrDefault("rows") == 35 and np.abs(products(some) - exact).mean() < 0.05 * np.abs(exact).mean()
    M.save_model(some, str(tmp_path / "k"))
    assert products(M.LandmarkFeatures.load(str(tmp_path / "k"))) == pytest.approx(products(some))
