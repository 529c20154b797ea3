"""Boosted trees with second-order gains, any number of models grown side by side.

Features are cut into bins once. A level of a tree needs, for every open node, feature and bin, the sums of first and second derivatives of the
loss over the rows there (Chen and Guestrin, "XGBoost: a scalable tree boosting system", 2016). One pass over the table
yields them for all models at once, one small array per model, node and task, so a whole grid with all its folds costs as many passes as its
deepest and longest model alone. A model with fewer trees is the beginning of the one with more: it is scored, not fitted.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from itertools import product

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import Param, Params, TypeConverters
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

BINS = 64
#: Trees that are added before the sums of all trees are written to the rows again.
TREES_KEPT = 2
NO_FOLD = -1


@dataclass(frozen=True)
class Choice:
    """How one model is grown. ``gamma`` is the least gain of a split, ``penalty`` is added to second derivatives, a part of a split needs ``least_weight``
    of them, positives weigh ``positive_weight`` (None: the ratio of the classes). Rows of the fold ``held`` are left out."""

    trees: int = 100
    depth: int = 3
    rate: float = 0.1
    rows: float = 1.0
    columns: float = 1.0
    gamma: float = 0.0
    penalty: float = 1.0
    least_weight: float = 1.0
    positive_weight: float | None = None
    held: int = NO_FOLD
    seed: int = 42


@dataclass
class Tree:
    """Nodes in arrays: rows with bin <= ``cut`` of ``feature`` go to ``left``, others to the next node; feature -1 is a leaf of value ``value``."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every row of binned features."""
        feature, cut, left = np.array(self.feature), np.array(self.cut), np.array(self.left)
        at = np.zeros(len(bins), np.int64)
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                return at
            here = at[inner]
            at[inner] = left[here] + (bins[inner, feature[here]] > cut[here])

    def values(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]

    def split(self, node: int, feature: int, cut: int, values: tuple[float, float]) -> list[int]:
        first = len(self.feature)
        self.feature[node], self.cut[node], self.left[node] = feature, cut, first
        for v in values:
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(0)
            self.value.append(v)
        return [first, first + 1]


def _mixed(key: np.ndarray, turn: int) -> np.ndarray:
    """A number from 0 to 1 by key and turn."""
    with np.errstate(over="ignore"):
        h = key.astype(np.uint64) + np.uint64((turn * 0x9E3779B97F4A7C15) % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return (h >> np.uint64(11)) / float(1 << 53)


def _best_split(g: np.ndarray, h: np.ndarray, how: Choice, allowed: np.ndarray) -> tuple[int, int, float, float] | None:
    """(feature, cut, value left, value right) of the largest gain over (feature, bin) sums; ties go to the first. None if none is worth it."""
    left_g, left_h = np.cumsum(g, 1)[:, :-1], np.cumsum(h, 1)[:, :-1]
    all_g, all_h = g[0].sum(), h[0].sum()
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = (left_g**2 / (left_h + how.penalty) + right_g**2 / (right_h + how.penalty) - all_g**2 / (all_h + how.penalty)) / 2 - how.gamma
    fits = (left_h >= how.least_weight) & (right_h >= how.least_weight) & allowed[:, None]
    gain = np.where(fits, gain, -np.inf)
    at = int(np.argmax(np.round(gain, 9)))
    f, b = divmod(at, gain.shape[1])
    if not gain[f, b] > 1e-9:
        return None
    value = lambda sg, sh: float(-how.rate * sg / (sh + how.penalty))
    return f, b, value(left_g[f, b], left_h[f, b]), value(right_g[f, b], right_h[f, b])


@dataclass
class Binning:
    """Cut points of every feature, and by held-out fold the bin of the mean that stands for a missing value."""

    edges: list[list[float]]
    missing: dict[int, list[int]]
    means: dict[int, list[float]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Bin of every value, -1 where it is missing."""
        out = np.stack([np.searchsorted(np.array(e), x[:, i], "left") for i, e in enumerate(self.edges)], 1).astype(np.int16)
        out[np.isnan(x)] = -1
        return out


def _binning(train: DataFrame, columns: Sequence[str], fold: str | None) -> Binning:
    quantiles = [(i + 1) / BINS for i in range(BINS - 1)]
    row = train.agg(*[F.percentile_approx(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), quantiles, 10_000).alias(c) for c in columns]).first()
    edges = [sorted(set(row[c] or [])) for c in columns]
    held = F.lit(NO_FOLD) if fold is None else F.col(fold).cast("int")
    sums = train.groupBy(held.alias("f")).agg(*[f(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("s", F.sum), ("n", F.count))]).collect()
    means = {}
    for f in {NO_FOLD, *(r["f"] for r in sums)}:
        part = [r for r in sums if r["f"] != f or f == NO_FOLD]
        means[f] = [sum(r[f"s{i}"] or 0.0 for r in part) / max(sum(r[f"n{i}"] for r in part), 1) for i in range(len(columns))]
    missing = {f: [int(np.searchsorted(np.array(e), m, "left")) for e, m in zip(edges, values)] for f, values in means.items()}
    return Binning(edges, missing, means)


def grow(train: DataFrame, row_id: str | None, columns: Sequence[str], label: str, choices: Sequence[Choice], fold: str | None = None) -> list[BoostedModel]:
    """Fit all ``choices`` side by side. Rows without a label are left out. The row id decides which trees a row is drawn for; without one
    the values of the columns do, so that equal rows are drawn together.

    The driver gets, per level of a tree, two numbers a model, open node, feature and bin.
    """
    binning = _binning(train, columns, fold)
    sizes = train.groupBy((F.lit(NO_FOLD) if fold is None else F.col(fold).cast("int")).alias("f")).agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) == 0).cast("long")).alias("n")).collect()

    def ratio(held: int) -> float:
        part = [r for r in sizes if r["f"] != held or held == NO_FOLD]
        return sum(r["n"] or 0 for r in part) / max(sum(r["p"] or 0 for r in part), 1)

    choices = [c if c.positive_weight is not None else replace(c, positive_weight=ratio(c.held)) for c in choices]
    p, width = len(columns), BINS
    forests: list[list[Tree]] = [[] for _ in choices]

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[[f"_x{i}" for i in range(p)]].to_numpy(float)
            yield pd.DataFrame({"key": batch["key"], "y": batch["y"], "fold": batch["fold"], "bins": list(binning.bins(x)), "margins": [np.zeros(len(choices))] * len(batch)})

    kind = "key long, y double, fold int, bins array<short>, margins array<double>"
    source = train.where(F.col(label).isNotNull()).select(
        (F.xxhash64(row_id) if row_id else F.xxhash64(*columns)).alias("key"), F.col(label).cast("double").alias("y"), (F.lit(NO_FOLD - 1) if fold is None else F.col(fold).cast("int")).alias("fold"),
        *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    rows = cut_lineage(source.mapInPandas(binned, kind))  # zeros, so hardly larger than its parts were
    kept_from = 0  # trees up to here are in the margins

    def filled(batch: pd.DataFrame) -> dict[int, np.ndarray]:
        bins = np.stack(batch["bins"].to_numpy())
        return {f: np.where(bins < 0, np.array(m, np.int16), bins) for f, m in binning.missing.items()}

    def margins(batch: pd.DataFrame, bins: dict[int, np.ndarray], grown: list[list[Tree]]) -> np.ndarray:
        out = np.stack(batch["margins"].to_numpy()).astype(float)
        for j, (how, trees) in enumerate(zip(choices, grown)):
            for tree in trees:
                out[:, j] += tree.values(bins[how.held])
        return out

    def sums_of(turn: int, open_: dict[int, dict[int, int]], start: int):
        """A pass over the rows: per model and open node the sums by feature and bin."""
        done = [trees[start:turn] for trees in forests]
        current = {j: forests[j][turn] for j in open_}

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = {j: np.zeros((2, len(nodes), p, width)) for j, nodes in open_.items()}
            for batch in batches:
                if batch.empty:
                    continue
                bins = filled(batch)
                m, y, key, own = margins(batch, bins, done), batch["y"].to_numpy(), batch["key"].to_numpy(), batch["fold"].to_numpy()
                for j, nodes in open_.items():
                    how = choices[j]
                    place = np.full(len(current[j].feature), -1)
                    place[list(nodes)] = list(nodes.values())
                    at = place[current[j].nodes(bins[how.held])]
                    used = (at >= 0) & (own != how.held)
                    if how.rows < 1:
                        used &= _mixed(key, how.seed * 100_003 + turn) < how.rows
                    chance = 1 / (1 + np.exp(-np.clip(m[used, j], -500, 500)))
                    weight = np.where(y[used] == 1, how.positive_weight, 1.0)
                    g, h = weight * (chance - y[used]), weight * chance * (1 - chance)
                    for f in range(p):
                        cell = at[used] * width + bins[how.held][used, f]
                        for s, v in enumerate((g, h)):
                            total[j][s, :, f] += np.bincount(cell, v, len(nodes) * width).reshape(len(nodes), width)
            yield pd.DataFrame([(j, n, total[j][:, i].ravel()) for j, nodes in open_.items() for n, i in nodes.items()], columns=["model", "node", "sums"])

        found = rows.mapInPandas(partial, "model int, node int, sums array<double>")
        summed = found.groupBy("model", "node").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
        return [(r["model"], r["node"], np.array(r["sums"]).reshape(2, p, width)) for r in summed.collect()]

    for turn in range(max((c.trees for c in choices), default=0)):
        live = [j for j, c in enumerate(choices) if turn < c.trees]
        for j in live:
            forests[j].append(Tree())
        allowed = {}
        for j in live:
            drawn = np.random.default_rng([choices[j].seed, turn]).permutation(p)[: max(1, round(choices[j].columns * p))]
            allowed[j] = np.isin(np.arange(p), drawn)
        open_ = {j: {0: 0} for j in live}
        level = 0
        while open_:
            further: dict[int, list[int]] = {}
            for j, node, (g, h) in sums_of(turn, open_, kept_from):
                tree, how = forests[j][turn], choices[j]
                if node == 0 and level == 0:
                    tree.value[0] = float(-how.rate * g[0].sum() / (h[0].sum() + how.penalty))
                split = _best_split(g, h, how, allowed[j])
                if split:
                    made = tree.split(node, split[0], split[1], split[2:])
                    if level + 1 < how.depth:
                        further.setdefault(j, []).extend(made)
            open_ = {j: {n: i for i, n in enumerate(sorted(nodes))} for j, nodes in further.items()}
            level += 1
        if turn + 1 - kept_from >= TREES_KEPT:
            grown = [trees[kept_from:] for trees in forests]

            def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    if not batch.empty:
                        yield batch.assign(margins=list(margins(batch, filled(batch), grown)))

            rows, kept_from = cut_lineage(rows.mapInPandas(added, kind)), turn + 1
    stored = lambda trees: [[t.feature, t.cut, t.left, t.value] for t in trees]
    return [
        BoostedModel(columns=list(columns), body=json.dumps({"edges": binning.edges, "missing": binning.missing[c.held], "trees": stored(trees)}))
        for c, trees in zip(choices, forests)
    ]


class BoostedModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``margin`` (log odds), ``probability`` of class 1 and ``prediction``; a missing value counts as the mean of the training rows."""

    columns = Param(Params._dummy(), "columns", "feature columns", TypeConverters.toListString)
    body = Param(Params._dummy(), "body", "cut points, bins of missing values and trees", TypeConverters.toString)
    first = Param(Params._dummy(), "first", "how many of the trees count, 0 for all", TypeConverters.toInt)

    @keyword_only
    def __init__(self, columns=None, body=None, first=0):
        super().__init__()
        self._setDefault(first=0)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def stage(self, trees: int) -> BoostedModel:
        """The model after its first ``trees`` trees, the same as one fitted with no more."""
        return BoostedModel(columns=self.getOrDefault("columns"), body=self.getOrDefault("body"), first=trees)

    def parts(self) -> tuple[Binning, list[Tree]]:
        kept = json.loads(self.getOrDefault("body"))
        trees = [Tree(*t) for t in kept["trees"]]
        return Binning(kept["edges"], {NO_FOLD: kept["missing"]}, {}), trees[: self.getOrDefault("first") or None]

    def importances(self) -> dict[str, int]:
        """How often the trees split on each column."""
        names, (_, trees) = self.getOrDefault("columns"), self.parts()
        return {c: sum(t.feature.count(i) for t in trees) for i, c in enumerate(names)}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        binning, trees = self.parts()

        @F.pandas_udf("double")
        def margin(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=float)
            bins = binning.bins(np.stack([np.array([np.nan if v is None else v for v in row], float) for row in x]))
            bins = np.where(bins < 0, np.array(binning.missing[NO_FOLD], np.int16), bins)
            return pd.Series(sum((t.values(bins) for t in trees), np.zeros(len(bins))))

        cells = F.array(*[F.col(c).cast("double") for c in self.getOrDefault("columns")])
        odds = dataset.withColumn("margin", margin(cells))
        chance = odds.withColumn("probability", 1 / (1 + F.exp(-F.col("margin"))))
        return chance.withColumn("prediction", (F.col("probability") >= 0.5).cast("double"))


def staged_search(train: DataFrame, row_id: str | None, columns: Sequence[str], label: str, fold: str, grid: Mapping[str, Sequence], seed: int = 42):
    """Cross-validated search over a grid of boosted trees, scored by F1 of class 1: (rows of scores, refitted best model, its parameters).

    All folds of all choices grow side by side. Choices that differ in ``n_estimators`` only are one model, scored after as many trees.
    """
    from .evaluate import scores

    names = {"max_depth": "depth", "learning_rate": "rate", "subsample": "rows", "colsample_bytree": "columns", "gamma": "gamma"}
    stages = sorted(grid.get("n_estimators", [100]))
    rest = {k: v for k, v in grid.items() if k != "n_estimators"}
    tried = [dict(zip(rest, values)) for values in product(*rest.values())]
    folds = train.agg(F.max(fold)).first()[0] + 1
    choice = lambda params, **more: Choice(seed=seed, **{names[k]: v for k, v in params.items()}, **more)
    choices = [choice(params, trees=stages[-1], held=f) for params in tried for f in range(folds)]
    models = grow(train, row_id, columns, label, choices, fold)

    parts = [(i, *model.parts()) for i, model in enumerate(models)]
    held = [c.held for c in choices]
    p, marks = len(columns), np.array(stages)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, own = batch[[f"_x{i}" for i in range(p)]].to_numpy(float), batch["fold"].to_numpy()
            for i, binning, trees in parts:
                mine = np.flatnonzero(own == held[i])
                if not len(mine):
                    continue
                bins = binning.bins(x[mine])
                bins = np.where(bins < 0, np.array(binning.missing[NO_FOLD], np.int16), bins)
                sums = np.cumsum([t.values(bins) for t in trees], axis=0)
                for n in marks:
                    yield pd.DataFrame({"model": i, "stage": int(n), "y": batch["y"].to_numpy()[mine], "prediction": (sums[n - 1] >= 0).astype(int)})

    source = train.where(F.col(label).isNotNull()).select(F.col(label).cast("int").alias("y"), F.col(fold).cast("int").alias("fold"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    judged = source.mapInPandas(judge, "model int, stage int, y int, prediction int")
    found = {(r["model"], r["stage"]): r["f1"] for r in scores(judged, "y", "prediction", "model", "stage").collect()}  # one row per model and stage
    rows = []
    for k, params in enumerate(tried):
        for n in stages:
            own = [found.get((k * folds + f, n), 0.0) for f in range(folds)]
            rows.append({"model": "xgb", "params": {"n_estimators": n} | params, "mean_score": float(np.mean(own)), "std_score": float(np.std(own))})
    best = max(rows, key=lambda r: r["mean_score"])["params"]
    final = grow(train, row_id, columns, label, [choice({k: v for k, v in best.items() if k != "n_estimators"}, trees=best["n_estimators"])])[0]
    return rows, final, best
