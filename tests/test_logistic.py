"""Logistic models fitted side by side: against Spark's, at the optimum, and as many passes for a grid as for one model."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from pairloom.operators import logistic as L
from pairloom.operators import models as M

NAMES = ["a", "b", "c", "d", "flat"]
CHOICES = [(0.01, 0.0), (0.01, 0.5), (0.0005, 0.25), (0.02, 1.0), (0.0001, 0.9)]


@pytest.fixture(scope="module")
def table(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(300, 4)) * [1, 5, 30, 0.01] + [0, 3, 100, 7]
    x[:, 3] += x[:, 1] * 0.01
    y = (x[:, 0] + 0.1 * x[:, 1] + 0.5 * draw.normal(size=300) > 0.9).astype(float)
    rows = [(i, *map(float, r), 2.0, float(t), i % 3) for i, (r, t) in enumerate(zip(x, y))]
    rows[5] = (5, None, float("nan"), *rows[5][3:])
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, flat double, y double, fold int").repartition(3).persist()


def spark_model(table, reg, share, fold, weighted=True):
    stages = [*M.preprocessing(NAMES), *M.classifier("logreg", {"C": 1 / (300 * reg), "l1_ratio": share}, 300, "y", "class_weight" if weighted else None)]
    stages[-1].setTol(1e-12).setMaxIter(5000)
    return Pipeline(stages=stages).fit(table.where(F.col("fold") != fold).coalesce(1))


@pytest.mark.parametrize("weighted", [True, False])
def test_the_same_models_as_those_of_spark(table, weighted):
    scalings, points = L.fitted_by_fold(table, NAMES, "y", "fold", CHOICES, weighted)
    f1 = L.scores_by_fold(table, NAMES, "y", "fold", CHOICES, weighted)
    assert len(points) == 15 and f1.shape == (5, 3)
    for i, (reg, share) in enumerate(CHOICES if weighted else CHOICES[:2]):
        fold = i % 3
        model = spark_model(table, reg, share, fold, weighted)
        held = table.where(F.col("fold") == fold)
        rows = model.transform(held).select(*NAMES, F.col("rawPrediction"), "prediction", "y").collect()
        x = np.array([[np.nan if r[c] is None else r[c] for c in NAMES] for r in rows])
        margins = scalings[fold].scaled(x) @ points[i, fold][:-1] + points[i, fold][-1]
        assert margins == pytest.approx(np.array([r["rawPrediction"][1] for r in rows]), abs=2e-4 * (1 + np.abs(margins).max()))
        assert f1[i, fold] == pytest.approx(M.f1_evaluator("y").evaluate(model.transform(held)))


def test_fits_end_at_the_optimum(table):
    """No slope is left along a coordinate, but up to the L1 part where it is 0."""
    scalings, points = L.fitted_by_fold(table, NAMES, "y", "fold", CHOICES)
    found = L._passed(L._cells(table, NAMES, "y", "fold"), scalings, points, len(NAMES))
    for (i, f), (_, grad, _) in found.items():
        reg, share = CHOICES[i]
        x, slope = points[i, f][:-1], grad[:-1] + reg * (1 - share) * points[i, f][:-1]
        assert grad[-1] == pytest.approx(0, abs=1e-9) and x[4] == pytest.approx(0, abs=1e-9)
        assert slope[x != 0] == pytest.approx(-reg * share * np.sign(x[x != 0]), abs=1e-9)
        assert (np.abs(slope[x == 0]) <= reg * share + 1e-9).all()


def test_a_whole_grid_takes_as_many_passes_as_its_longest_model(table, monkeypatch):
    passes = []
    passed = L._passed
    monkeypatch.setattr(L, "_passed", lambda *a: passes.append(1) or passed(*a))
    monkeypatch.setattr(M, "search_pipelines", None)
    found = M.grid_search(table, "logreg", NAMES, "y", "fold")
    assert len(found.rows) == 25 and len(passes) <= 20
    assert found.best_params == max(found.rows, key=lambda r: r["mean_score"])["params"]
    assert M.score_table(found.best, table, ["id", "y"]).count() == 300


def test_other_labels_and_poor_folds_go_one_by_one(spark, table):
    three = table.withColumn("y", F.when(F.col("id") < 40, 2.0).otherwise(F.col("y")))
    assert L.scores_by_fold(three, NAMES, "y", "fold", CHOICES) is None
    assert L.scores_by_fold(table.withColumn("y", F.when(F.col("fold") > 0, F.col("y")).otherwise(0.0)), NAMES, "y", "fold", CHOICES) is None
    assert L.scores_by_fold(table.withColumn("a", F.lit(None).cast("double")), NAMES, "y", "fold", CHOICES) is None
    found = M.grid_search(three, "logreg", ["a", "b"], "y", "fold", {"C": [1]})
    assert len(found.rows) == 1
