"""Logistic models with elastic net, any number of them fitted side by side.

A fit goes by Newton steps on the loss, each to the lowest point of the second-order model of the loss plus the penalty (Lee, Sun and Saunders,
"Proximal Newton-type methods for minimizing composite functions", 2014). A step needs the sums of the losses and their first and second derivatives over
the rows at one point. One pass over the table yields them for all models at once, so a whole grid with all its folds costs as many passes as its
longest model alone, which are about ten. What is minimized is what Spark's ``LogisticRegression`` minimizes, after the same preprocessing; a fit ends
at the optimum, not within a tolerance of it.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS, TOLERANCE = 100, 1e-12  # most steps of a fit, and what a step must gain, relative to what is minimized
SWEEPS = 1000  # of a step over the coordinates
CELLS = 1 << 20  # products of columns that a task holds at once
ZERO = 1e-12  # margins below are 0 but for rounding, and then the class is 0

#: Points to look at; loss, gradient and second derivatives there; the last point.
Fit = Generator[np.ndarray, tuple[float, np.ndarray, np.ndarray], np.ndarray]


def lowest(x: np.ndarray, grad: np.ndarray, curve: np.ndarray, l1: np.ndarray) -> np.ndarray:
    """Where ``grad (z - x) + (z - x) curve (z - x) / 2 + sum(l1 abs(z))`` is lowest: sweeps over the coordinates find which of them are 0, the others solve a linear system."""
    z, free = x.copy(), l1 == 0
    steep = np.maximum(np.diag(curve), 1e-12 * max(np.trace(curve), 1e-300))
    for _ in range(SWEEPS):
        for j in range(len(z)):
            at = steep[j] * z[j] - (grad[j] + curve[j] @ (z - x))
            z[j] = np.sign(at) * max(abs(at) - l1[j], 0.0) / steep[j]
        used, side, y = np.flatnonzero(free | (z != 0)), np.where(free, 0.0, np.sign(z)), np.zeros_like(z)
        y[used] = np.linalg.lstsq(curve[np.ix_(used, used)], (curve @ x - grad - l1 * side)[used], rcond=1e-14)[0]
        slope, none = grad + curve @ (y - x), ~free & (y == 0)
        if (free | (np.sign(y) == side)).all() and (np.abs(slope[none]) <= l1[none] * (1 + 1e-9) + 1e-14).all():
            return y
    return z


def minimized(x: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> Fit:
    """A fit of a loss plus ``sum(l1 abs(x)) + sum(l2 x^2) / 2``, as a generator that is sent the loss and its derivatives at every point it yields."""

    def whole(x: np.ndarray, loss: float) -> float:
        return loss + 0.5 * float((l2 * x * x).sum()) + float(np.abs(l1 * x).sum())

    loss, grad, curve = yield x
    total = whole(x, loss)
    for _ in range(STEPS):
        slope = grad + l2 * x
        way = lowest(x, slope, curve + np.diag(l2), l1) - x
        gain = float(slope @ way + (l1 * (np.abs(x + way) - np.abs(x))).sum())
        if -gain <= TOLERANCE * abs(total):
            return x + way
        part = 1.0
        while True:
            new = x + part * way
            loss, new_grad, new_curve = yield new
            if whole(new, loss) <= total + 1e-4 * part * gain:
                break
            part /= 2
            if part < 1e-10:
                return x
        x, grad, curve, total = new, new_grad, new_curve, whole(new, loss)
    return x


@dataclass
class Scaling:
    """What a fit does to rows first: missing values become ``fill``, columns are moved by ``middle`` and stretched by ``factor``; weights of the classes 0 and 1,
    the sum of all weights, and the log odds that the fit starts from."""

    fill: np.ndarray
    middle: np.ndarray
    factor: np.ndarray
    weights: tuple[float, float]
    weight: float
    odds: float

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (np.where(np.isnan(x), self.fill, x) - self.middle) * self.factor


def _scalings(train: DataFrame, columns: Sequence[str], label: str, fold: str, weighted: bool) -> dict[int, Scaling] | None:
    """By held-out fold what the other rows say: mean imputation, standardization by the sample deviation, balanced weights, and the deviation of the weighted
    rows that penalties are measured in. None where a fold lacks a class or labels are not 0 and 1.

    The driver gets a few numbers a fold, class and column.
    """
    cells = [F.col(c).cast("double") for c in columns]
    known = [F.when(~F.isnan(v), v) for v in cells]
    found = train.groupBy(F.col(fold).alias("f"), F.col(label).cast("double").alias("y")).agg(
        F.count("*").alias("n"), *[f(v).alias(f"{k}{i}") for i, v in enumerate(known) for k, f in (("k", F.count), ("m", F.avg), ("v", F.var_pop))]
    ).collect()
    folds = {r["f"] for r in found}
    if None in folds or {(r["f"], r["y"]) for r in found} != {(f, y) for f in range(len(folds)) for y in (0.0, 1.0)} or len(folds) < 2:
        return None
    out = {}
    for held in folds:
        part = [r for r in found if r["f"] != held]
        n, y = np.array([r["n"] for r in part], float), np.array([r["y"] for r in part])
        k, m, v = (np.array([[r[f"{c}{i}"] or 0.0 for i in range(len(columns))] for r in part], float) for c in "kmv")
        if not k.sum(0).all() or not np.isfinite(m).all():
            return None
        mean = (k * m).sum(0) / k.sum(0)
        spread = np.sqrt((k * (v + (m - mean) ** 2)).sum(0) / max(n.sum() - 1, 1))
        stretch = np.divide(1.0, spread, out=np.zeros_like(spread), where=spread > 0)
        sizes = [n[y == c].sum() for c in (0, 1)]
        weights = tuple(n.sum() / (2 * s) if weighted else 1.0 for s in sizes)
        w = np.where(y == 1, weights[1], weights[0])[:, None]
        total, squares = float((w[:, 0] * n).sum()), float((w[:, 0] ** 2 * n).sum())
        z = (m - mean) * stretch  # by group; missing values are at 0
        centre = (w * k * z).sum(0) / total
        away = (w * (k * (v * stretch**2 + (z - centre) ** 2) + (n[:, None] - k) * centre**2)).sum(0)
        again = np.sqrt(away / (total - squares / total))
        used = (stretch > 0) & (again > 0)
        factor = np.divide(stretch, again, out=np.zeros_like(spread), where=used)
        middle = mean + np.divide(centre, stretch, out=np.zeros_like(spread), where=used)
        out[held] = Scaling(mean, middle, factor, weights, total, float(np.log(sizes[1] * weights[1] / (sizes[0] * weights[0]))))
    return out


def fitted_by_fold(
    train: DataFrame, columns: Sequence[str], label: str, fold: str, choices: Sequence[tuple[float, float]], weighted: bool = True,
) -> tuple[dict[int, Scaling], dict[tuple[int, int], np.ndarray]] | None:
    """One model a choice (strength, share of L1) and fold it is not fitted on: (scalings, points by choice and fold); coefficients of the scaled columns come
    first, the intercept last. None where ``_scalings`` has none.

    The driver gets as many numbers a model as there are pairs of columns.
    """
    scalings, p = _scalings(train, columns, label, fold, weighted), len(columns)
    if scalings is None:
        return None
    rows, penalized = _cells(train, columns, label, fold), np.append(np.ones(p), 0.0)
    fits = {
        (i, f): minimized(np.append(np.zeros(p), s.odds), reg * share * penalized, reg * (1 - share) * penalized)
        for i, (reg, share) in enumerate(choices) for f, s in scalings.items()
    }
    points, ended = {j: next(fit) for j, fit in fits.items()}, {}
    while points:
        for j, found in _passed(rows, scalings, points, p).items():
            try:
                points[j] = fits[j].send(found)
            except StopIteration as end:
                ended[j] = end.value
                del points[j]
    return scalings, ended


def _cells(train: DataFrame, columns: Sequence[str], label: str, fold: str) -> DataFrame:
    return train.select(F.col(label).cast("double").alias("y"), F.col(fold).cast("int").alias("fold"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])


def _slices(batches: Iterator[pa.RecordBatch], p: int, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(columns, label, fold) of some rows at a time; a missing value is NaN."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            y, own, *x = [part.column(name).to_numpy(zero_copy_only=False) for name in ("y", "fold", *[f"x{i}" for i in range(p)])]
            yield np.stack(x, 1).astype(float), y, own


def _summed(rows: DataFrame, partial) -> dict[int, np.ndarray]:
    """By fold the sums over all tasks of what ``partial`` makes of the rows of a task, which is an array a fold."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = partial(batches)
        yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int32()), pa.array([t.ravel() for t in total.values()], pa.list_(pa.float64()))], names=["fold", "sums"])

    found = rows.mapInArrow(sums, "fold int, sums array<double>").groupBy("fold").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
    return {r["fold"]: np.array(r["sums"]) for r in found.collect()}  # one row per fold


def _passed(
    rows: DataFrame, scalings: Mapping[int, Scaling], points: Mapping[tuple[int, int], np.ndarray], p: int,
) -> dict[tuple[int, int], tuple[float, np.ndarray, np.ndarray]]:
    """A pass over the rows: per model the loss and its first and second derivatives, as means over the weights."""
    asked = {f: [j for j in points if j[1] == f] for f in sorted({j[1] for j in points})}
    at = {f: np.stack([points[j] for j in names]) for f, names in asked.items()}
    a, b = np.triu_indices(p + 1)

    def partial(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        total = {f: np.zeros((len(x), p + 2 + len(a))) for f, x in at.items()}
        for x, y, own in _slices(batches, p, max(64, CELLS // len(a))):
            for f, theta in at.items():
                used, how = own != f, scalings[f]
                u = np.append(how.scaled(x[used]), np.ones((int(used.sum()), 1)), 1)
                margin, positive = u @ theta.T, y[used][:, None] == 1
                weight = np.where(positive, how.weights[1], how.weights[0])
                chance = np.exp(-np.logaddexp(0.0, -margin))
                total[f][:, 0] += (weight * np.logaddexp(0.0, np.where(positive, -margin, margin))).sum(0)
                total[f][:, 1 : p + 2] += (weight * (chance - positive)).T @ u
                total[f][:, p + 2 :] += (weight * chance * (1 - chance)).T @ (u[:, a] * u[:, b])
        return total

    out = {}
    for f, summed in _summed(rows, partial).items():
        for j, sums in zip(asked[f], summed.reshape(len(asked[f]), -1) / scalings[f].weight):
            curve = np.zeros((p + 1, p + 1))
            curve[a, b] = curve[b, a] = sums[p + 2 :]
            out[j] = float(sums[0]), sums[1 : p + 2], curve
    return out


def scores_by_fold(
    train: DataFrame, columns: Sequence[str], label: str, fold: str, choices: Sequence[tuple[float, float]], weighted: bool = True,
) -> np.ndarray | None:
    """F1 of class 1 of each choice (strength, share of L1) on each fold, by models that are fitted on the other folds. None where ``_scalings`` has none."""
    fits = fitted_by_fold(train, columns, label, fold, choices, weighted)
    if fits is None:
        return None
    scalings, points = fits
    p, n = len(columns), len(choices)
    at = {f: np.stack([points[i, f] for i in range(n)]) for f in scalings}

    def judge(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        total = {f: np.zeros((n, 3)) for f in at}
        for x, y, own in _slices(batches, p, max(64, CELLS // n)):
            for f, theta in at.items():
                mine = own == f
                says, good = scalings[f].scaled(x[mine]) @ theta[:, :p].T + theta[:, p] > ZERO, y[mine][:, None] == 1
                total[f] += np.stack([(says & good).sum(0), says.sum(0), np.full(n, good.sum())], 1)
        return total

    out = np.zeros((n, len(at)))
    for f, summed in _summed(_cells(train, columns, label, fold), judge).items():
        for i, (hits, said, good) in enumerate(summed.reshape(n, 3)):
            precision, recall = hits / said if said else 0.0, hits / good
            out[i, f] = 2 * precision * recall / (precision + recall) if hits else 0.0
    return out
