"""The learner on a table it can separate, its sums against a plain version, and accuracy on held-out rows."""

import math

import numpy as np
import pyarrow as pa

from pairloom.llm import quality, words
from pairloom.llm.queries import QUERIES

from .cases import FOLDER, ODD_TEXTS, documents, empty


def test_scores_are_sparse_dot_products():
    texts = words.texts_of(pa.array(ODD_TEXTS))
    weights = np.random.default_rng(1).normal(size=quality.DIMENSIONS).astype(np.float32)
    got = quality.Classifier(weights, 0.25).score(texts)
    for i, text in enumerate(ODD_TEXTS):
        one = quality.features(words.texts_of(pa.array([text], pa.string())))
        logit = 0.25 + sum(float(weights[index].astype(float).mean()) for _, index in one if len(index))
        assert math.isclose(got[i], 1 / (1 + math.exp(-logit)), rel_tol=1e-6, abs_tol=1e-9)


def test_learner_ignores_noise_and_finds_the_signal():
    rows = [(np.array([k % 2, 10 + k % 7]), np.array([1.0, 1.0]), k % 2) for k in range(400)]
    w = quality.learn(rows, quality.Training()).weights
    assert w[1] > 1 > -1 > w[0] and np.abs(w[10:17]).max() < 0.5 and (w[17:] == 0).all()


def test_held_out_rows(spark):
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = QUERIES["op3_quality_classifier"](spark, FOLDER).collect()
    held = [(r["predicted"], marks[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in marks]
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert sum(a == b for a, b in held) >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_odd_tables(spark):
    docs = documents(spark)
    marks = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(3, None), (999, 1), (4, 1)], "doc_id long, label int")
    classifier = quality.fit(docs, marks, quality.Training(per_class=4))
    assert quality.scored(docs, classifier).where("score BETWEEN 0 AND 1").count() == docs.count()
    assert quality.scored(empty(spark), classifier).count() == 0
    for few in (marks.limit(0), marks.where("label = 1")):
        constant = quality.fit(docs, few)
        assert quality.scored(docs, constant).select("score").distinct().count() == 1


def test_sample_is_bounded_by_rows(spark, monkeypatch):
    """Four ids hold all rows; what the learner gets is as many rows a class as were asked for."""
    docs = spark.range(2000).selectExpr("id % 4 AS doc_id", "concat('text number ', id) AS text")
    marks = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "doc_id long, label int")
    got = []
    monkeypatch.setattr(quality, "learn", lambda rows, how: got.append(rows) or quality.Classifier(quality.np.zeros(quality.DIMENSIONS, quality.np.float32), 0.0))
    quality.fit(docs, marks, quality.Training(per_class=7))
    assert sorted(label for _, _, label in got[0]) == [0] * 7 + [1] * 7


def plain_learn(rows, how):
    """The same learner, a coordinate at a time, in dictionaries."""
    z, n = {}, {}

    def weight(j):
        if abs(z.get(j, 0.0)) <= how.l1:
            return 0.0
        return ((how.l1 if z[j] > 0 else -how.l1) - z[j]) / ((how.beta + n[j] ** 0.5) / how.alpha + how.l2)

    for _ in range(how.epochs):
        for index, value, label in rows:
            cells = [*zip(map(int, index), map(float, value)), (quality.DIMENSIONS, 1.0)]
            w = {j: weight(j) for j, _ in cells}
            p = 1 / (1 + 2.718281828459045 ** -sum(w[j] * x for j, x in cells))
            for j, x in cells:
                g = (p - label) * x
                z[j] = z.get(j, 0.0) + g - ((n.get(j, 0.0) + g * g) ** 0.5 - n.get(j, 0.0) ** 0.5) / how.alpha * w[j]
                n[j] = n.get(j, 0.0) + g * g
    return {j: weight(j) for j in z}


def test_learner_is_the_plain_one():
    draw = quality.np.random.default_rng(3)
    rows = [(draw.choice(50, 8, replace=False), draw.random(8), int(draw.random() < 0.4)) for _ in range(200)]
    how = quality.Training()
    got, want = quality.learn(rows, how), plain_learn(rows, how)
    assert abs(got.bias - want.pop(quality.DIMENSIONS)) < 1e-9
    assert all(abs(got.weights[j] - w) < 1e-6 for j, w in want.items()) and (got.weights != 0).sum() == sum(w != 0 for w in want.values())
