"""Boosted trees against a plain version that sorts rows node by node, nested models, and models grown side by side."""

import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel

from pairloom.operators import boosting as B
from pairloom.operators import models as M


def data(n=240, seed=5):
    draw = np.random.default_rng(seed)
    x = np.round(4 * draw.normal(size=(n, 3))) / 4  # fewer values than bins
    y = ((x[:, 0] + 0.5 * x[:, 1] ** 2 + draw.normal(size=n) * 0.4) > 0.3).astype(int)
    return x, y


def table(spark, x, y):
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], int(t), i % 3) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y int, fold int").repartition(4)


def plain(x, y, how, rounds):
    """Log odds after some trees; every split tries all values of all features."""
    margin = np.zeros(len(x))

    def grow(rows, depth, g, h, out, value):
        out[rows] = value
        if depth == how.depth:
            return
        best = None
        for f in range(x.shape[1]):
            for cut in sorted(set(x[:, f]))[:-1]:
                left = rows[x[rows, f] <= cut]
                right = rows[x[rows, f] > cut]
                hl, hr = h[left].sum(), h[right].sum()
                if hl < how.least_weight or hr < how.least_weight:
                    continue
                gain = (g[left].sum() ** 2 / (hl + how.penalty) + g[right].sum() ** 2 / (hr + how.penalty) - g[rows].sum() ** 2 / (h[rows].sum() + how.penalty)) / 2 - how.gamma
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = gain, left, right
        if best:
            for part in best[1:]:
                grow(part, depth + 1, g, h, out, -how.rate * g[part].sum() / (h[part].sum() + how.penalty))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        w = np.where(y == 1, how.positive_weight, 1.0)
        g, h = w * (p - y), w * p * (1 - p)
        out = np.zeros(len(x))
        grow(np.arange(len(x)), 0, g, h, out, -how.rate * g.sum() / (h.sum() + how.penalty))
        margin += out
    return margin


def margins(model, df):
    return np.array([r["margin"] for r in model.transform(df).orderBy("id").collect()])


@pytest.fixture(scope="module")
def grown(spark):
    """A dozen trees, so that sums are written in between; different models, and folds held out, side by side."""
    x, y = data()
    df = table(spark, x, y).persist()
    choices = [
        B.Choice(trees=10, depth=3, rate=0.3, positive_weight=1.0), B.Choice(trees=4, depth=2, rate=0.5, gamma=0.5, positive_weight=2.0),
        B.Choice(trees=5, depth=3, rate=0.3, positive_weight=1.0), B.Choice(trees=6, depth=3, rate=0.3, rows=0.7, columns=0.6), B.Choice(trees=3, depth=2, held=1),
    ]
    return x, y, df, choices, B.grow(df, "id", ["a", "b", "c"], "y", choices, "fold")


def test_like_the_plain_one(grown):
    x, y, df, choices, models = grown
    for how, model in list(zip(choices, models))[:2]:
        assert margins(model, df) == pytest.approx(plain(x, y, how, how.trees), abs=1e-6)


def test_fewer_trees_are_the_beginning_of_more(grown):
    _, _, df, _, models = grown
    assert margins(models[0].stage(5), df) == pytest.approx(margins(models[2], df))


def test_held_out_rows_and_draws(spark, grown):
    x, y, df, choices, models = grown
    part = np.arange(len(y)) % 3 != 1
    weight = (y[part] == 0).sum() / (y[part] == 1).sum()
    how = B.Choice(trees=3, depth=2, positive_weight=weight)
    rows = plain(x[part], y[part], how, 3)
    assert margins(models[4], df)[part] == pytest.approx(rows, abs=1e-6)
    alone = B.grow(df.repartition(7), "id", ["a", "b", "c"], "y", [choices[3]], "fold")[0]
    assert margins(alone, df) == pytest.approx(margins(models[3], df))
    assert all(len({f for f in t.feature if f >= 0}) <= 2 for t in models[3].parts()[1])


def test_missing_values_and_odd_tables(spark, tmp_path):
    x, y = data(60)
    x[::5, 0] = np.nan
    filled = x.copy()
    filled[::5, 0] = np.nanmean(x[:, 0])
    df = table(spark, x, y)
    how = B.Choice(trees=2, depth=2, rate=1.0, positive_weight=1.0)
    model = B.grow(df, "id", ["a", "b", "c"], "y", [how])[0]
    bins = B.Binning(model.parts()[0].edges, {}, {})
    # A mean between two values goes with the upper one.
    rounded = np.where(np.isnan(x), np.array(bins.edges[0])[bins.bins(filled)[0, 0]], filled)
    assert margins(model, df) == pytest.approx(plain(rounded, y, how, 2), abs=1e-6)
    M.save_model(PipelineModel([model.stage(1)]), str(tmp_path / "m"))
    again = M.load_model(str(tmp_path / "m"))
    assert margins(again, df) == pytest.approx(margins(model.stage(1), df))
    one = B.grow(df.where("y = 1"), "id", ["a", "b", "c"], "y", [how])[0]
    assert all(math.isfinite(v) for v in margins(one, df))
    assert set(margins(B.grow(df.limit(0), "id", ["a", "b", "c"], "y", [how])[0], df)) == {0.0}


def test_search_scores_stages(spark, grown):
    _, _, df, _, _ = grown
    grid = {"n_estimators": [2, 6], "max_depth": [2], "learning_rate": [0.3], "gamma": [0, 0.1]}
    rows, best, params = B.staged_search(df, "id", ["a", "b", "c"], "y", "fold", grid)
    assert len(rows) == 4 and max(r["mean_score"] for r in rows) > 0.75 and params in [r["params"] for r in rows]
    short, _, _ = B.staged_search(df, "id", ["a", "b", "c"], "y", "fold", grid | {"n_estimators": [2]})
    assert [r["mean_score"] for r in short] == pytest.approx([r["mean_score"] for r in rows if r["params"]["n_estimators"] == 2])
