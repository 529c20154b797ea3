"""Binary classifiers on Spark ML: preprocessing, class weights, parameter grids, cross-validated search."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed, Param, Params, TypeConverters
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import CrossValidator
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .aggregates import class_weights
from .boosting import staged_search
from .logistic import scores_by_fold
from .sets import stacked
from .similarity import nearest, vote_of_neighbours

# The parameter grids that are searched, by model. "None" depth means as deep as Spark allows (30).
GRIDS: dict[str, dict[str, list]] = {
    "knn": {"n_neighbors": [5, 10, 20, 30], "weights": ["uniform", "distance"], "p": [1, 2]},
    "logreg": {"C": [0.01, 0.1, 1, 10, 100], "l1_ratio": [0, 0.25, 0.5, 0.75, 1]},
    "svm_linear": {"C": [0.01, 0.1, 1, 10]},
    "svm_poly": {"C": [0.1, 1, 10], "degree": [2, 3, 4], "gamma": ["scale", "auto"]},
    "svm_rbf": {"C": [0.1, 1, 10], "gamma": ["scale", "auto"]},
    "rf": {"n_estimators": [100, 300, 500], "max_depth": [None, 10, 20], "min_samples_split": [2, 5], "min_samples_leaf": [1, 2]},
    "gb": {"n_estimators": [100, 300], "max_depth": [3, 5], "learning_rate": [0.01, 0.05, 0.1], "subsample": [0.8, 1.0]},
    "xgb": {
        "n_estimators": [100, 300], "max_depth": [3, 5], "learning_rate": [0.01, 0.05, 0.1], "subsample": [0.8, 1.0],
        "colsample_bytree": [0.8, 1.0], "gamma": [0, 0.1],
    },
}

# Names shown in reports.
FULL_NAMES = {
    "knn": "k-Nearest Neighbors", "logreg": "Logistic Regression", "svm_linear": "Support Vector Machine",
    "svm_poly": "Support Vector Machine", "svm_rbf": "Support Vector Machine", "rf": "Random Forest",
    "gb": "Gradient Boost", "xgb": "XGBoost",
}

DEEPEST = 30


class KernelFeatures(Estimator, HasInputCol, HasOutputCol, HasSeed):
    """Features of a vector column on which a linear model acts like one with a kernel, RBF or polynomial (Williams and Seeger, "Using the
    Nystroem method to speed up kernel machines", 2000).

    ``size`` rows serve as landmarks, those whose hashes are lowest, so equal rows are one. A row's features are its kernel values with
    the landmarks times the inverse root of the landmarks' own kernel matrix: their products are the kernel's best
    approximation from the landmarks, and the kernel itself between landmarks. ``width`` is "auto" (1 / dimensions) or "scale" (1 / (dimensions
    * variance of all values)), as fitted on the training rows.
    """

    def __init__(self, inputCol: str, outputCol: str, kernel: str, degree: int = 3, width: str = "scale", size: int = 256, seed: int = 42):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, seed=seed)
        self.kernel, self.degree, self.width, self.size = kernel, degree, width, size

    def _fit(self, dataset: DataFrame) -> LandmarkFeatures:
        vectors = dataset.select(F.col(self.getInputCol()).alias("x"))
        s = vectors.select(Summarizer.metrics("mean", "variance", "count").summary(F.col("x")).alias("s")).first()["s"]
        mean, variance, n = s["mean"].toArray(), s["variance"].toArray(), s["count"]
        spread = float(np.mean(variance * (n - 1) / max(n, 1) + mean**2) - np.mean(mean) ** 2)
        gamma = 1.0 / len(mean) if self.width == "auto" or spread <= 0 else 1.0 / (len(mean) * spread)
        cells = vectors.select(vector_to_array("x").alias("v")).groupBy(F.xxhash64("v", F.lit(self.getSeed())).alias("h")).agg(F.min("v").alias("v"))
        chosen = np.array([r["v"] for r in cells.orderBy("h").limit(self.size).collect()])
        values, axes = np.linalg.eigh(kernel_matrix(chosen, chosen, self.kernel, gamma, self.degree))
        used = values > values.max() * 1e-13
        root = axes[:, used] / np.sqrt(values[used])
        return LandmarkFeatures(
            inputCol=self.getInputCol(), outputCol=self.getOutputCol(), kernel=self.kernel, degree=self.degree, gamma=gamma,
            landmarks=chosen.ravel().tolist(), root=root.ravel().tolist(), rows=len(chosen),
        )


def kernel_matrix(a: np.ndarray, b: np.ndarray, kernel: str, gamma: float, degree: int) -> np.ndarray:
    """exp(-gamma |x - y|^2) or (gamma x.y)^degree for all rows x of a and y of b."""
    products = a @ b.T
    if kernel == "poly":
        return (gamma * products) ** degree
    squared = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * products
    return np.exp(-gamma * np.maximum(squared, 0.0))


class LandmarkFeatures(Model, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Kernel values with ``rows`` landmarks, times the inverse root of their own kernel matrix."""

    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    degree = Param(Params._dummy(), "degree", "degree of the polynomial kernel", TypeConverters.toInt)
    kernel = Param(Params._dummy(), "kernel", "rbf or poly", TypeConverters.toString)
    rows = Param(Params._dummy(), "rows", "number of landmarks", TypeConverters.toInt)
    landmarks = Param(Params._dummy(), "landmarks", "their vectors, one after the other", TypeConverters.toListFloat)
    root = Param(Params._dummy(), "root", "inverse root of their kernel matrix, row by row", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, kernel="rbf", degree=3, gamma=1.0, landmarks=None, root=None, rows=0):
        super().__init__()
        self._setDefault(kernel="rbf", degree=3, gamma=1.0, landmarks=[], root=[], rows=0)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rows, gamma, degree, kernel = (self.getOrDefault(p) for p in ("rows", "gamma", "degree", "kernel"))
        landmarks, root = (np.array(self.getOrDefault(p)).reshape(rows, -1) for p in ("landmarks", "root"))

        @F.pandas_udf("array<double>")
        def mapped(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype=object)
            return pd.Series(list(kernel_matrix(np.stack(vectors.to_numpy()), landmarks, kernel, gamma, degree) @ root))

        return dataset.withColumn(self.getOutputCol(), array_to_vector(mapped(vector_to_array(self.getInputCol()))))


class MostFrequent(Estimator):
    """Most-frequent imputation of text columns; of several values the smallest. Fitted on the training rows in one pass."""

    def __init__(self, columns: Sequence[str]):
        super().__init__()
        self.columns = list(columns)

    def _fit(self, dataset: DataFrame) -> FilledText:
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in self.columns])).alias("x")
        counted = dataset.select(cells).select("x.*").where("v IS NOT NULL").groupBy("c", "v").agg(F.count("*").alias("n"))
        best = counted.groupBy("c").agg(F.min_by("v", F.struct(-F.col("n"), "v")).alias("v")).collect()  # one row per column
        return FilledText(columns=[r["c"] for r in best], fills=[r["v"] for r in best])


class FilledText(Model, DefaultParamsReadable, DefaultParamsWritable):
    columns = Param(Params._dummy(), "columns", "columns to fill", TypeConverters.toListString)
    fills = Param(Params._dummy(), "fills", "value of each column", TypeConverters.toListString)

    @keyword_only
    def __init__(self, columns=None, fills=None):
        super().__init__()
        self._setDefault(columns=[], fills=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        pairs = zip(self.getOrDefault("columns"), self.getOrDefault("fills"))
        return dataset.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(dataset.schema[c].dataType)) for c, v in pairs})


class BalancedWeight(Estimator):
    """Adds the balanced weight of each row's class, with classes counted on the rows the pipeline is fitted on."""

    def __init__(self, label: str, out: str = "class_weight"):
        super().__init__()
        self.label, self.out = label, out

    def _fit(self, dataset: DataFrame) -> ClassWeights:
        rows = class_weights(dataset, self.label).collect()  # one row per class
        return ClassWeights(label=self.label, out=self.out, classes=[float(r[self.label]) for r in rows], weights=[float(r["weight"]) for r in rows])


class ClassWeights(Model, DefaultParamsReadable, DefaultParamsWritable):
    label = Param(Params._dummy(), "label", "label column", TypeConverters.toString)
    out = Param(Params._dummy(), "out", "weight column", TypeConverters.toString)
    classes = Param(Params._dummy(), "classes", "labels", TypeConverters.toListFloat)
    weights = Param(Params._dummy(), "weights", "weight of each label", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, label=None, out=None, classes=None, weights=None):
        super().__init__()
        self._setDefault(classes=[], weights=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        label, weight = self.getOrDefault("label"), F.lit(1.0)  # rows without a known label count once
        if label in dataset.columns:
            for c, w in zip(self.getOrDefault("classes"), self.getOrDefault("weights")):
                weight = F.when(F.col(label).cast("double") == c, w).otherwise(weight)
        return dataset.withColumn(self.getOrDefault("out"), weight)


def preprocessing(columns: Sequence[str], out: str = "features", text: Sequence[str] = ()) -> list:
    """Mean imputation and standardization of numeric columns and most-frequent imputation of ``text`` columns, fitted
    with the model on training rows only."""
    filled = [f"{c}__filled" for c in columns]
    return [
        *([MostFrequent(text)] if text else []),
        Imputer(strategy="mean", inputCols=list(columns), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="_assembled"),
        StandardScaler(inputCol="_assembled", outputCol=out, withMean=True, withStd=True),
    ]


def penalty(params: Mapping[str, object], rows: int) -> tuple[float, float]:
    """Strength per row, and the share of L1 in it."""
    return 1.0 / (float(params.get("C", 1.0)) * max(rows, 1)), float(params.get("l1_ratio", 0))


def classifier(name: str, params: Mapping[str, object], rows: int, label: str, weight: str | None, seed: int = 42) -> list:
    """Pipeline stages of one model with one choice of parameters, on the column ``features``.

    The strength ``C`` of a penalized model is turned into Spark's per-row ``regParam`` with the number of rows. Spark's trees
    have no least size of a node to be split; a node of fewer than ``min_samples_split`` rows is kept whole by asking for half as
    many in each part, which is a little stricter. With ``weight`` a first stage adds balanced class weights under that name.
    """
    p = dict(params)
    common = {"labelCol": label, "featuresCol": "features"}
    first = []
    if weight and name != "gb":
        common["weightCol"] = weight
        first = [BalancedWeight(label, weight)]
    reg, l1_ratio = penalty(p, rows)
    svc = {"regParam": reg, "maxIter": int(p.get("max_iter", 100)), "tol": 1e-3}
    if name == "logreg":
        return [*first, LogisticRegression(**common, regParam=reg, elasticNetParam=l1_ratio, maxIter=500, tol=1e-4)]
    if name == "svm_linear":
        return [*first, LinearSVC(**common, **svc)]
    if name in ("svm_poly", "svm_rbf"):
        mapped = KernelFeatures("features", "_kernel", "poly" if name == "svm_poly" else "rbf", int(p.get("degree", 3)), str(p.get("gamma", "scale")), seed=seed)
        # Not scaled to equal spread: directions that the kernel hardly has would count as much as the others.
        return [*first, mapped, LinearSVC(**{**common, "featuresCol": "_kernel"}, standardization=False, **svc)]
    if name == "rf":
        least = max(int(p.get("min_samples_leaf", 1)), -(-int(p.get("min_samples_split", 2)) // 2))
        return [*first, RandomForestClassifier(
            **common, numTrees=int(p.get("n_estimators", 300)), maxDepth=int(p.get("max_depth") or DEEPEST),
            minInstancesPerNode=least, seed=seed,
        )]
    if name == "gb":
        return [GBTClassifier(
            **common, maxIter=int(p.get("n_estimators", 300)), maxDepth=int(p.get("max_depth", 3)),
            stepSize=float(p.get("learning_rate", 0.05)), subsamplingRate=float(p.get("subsample", 1.0)), seed=seed,
        )]
    raise ValueError(f"unknown model {name!r}")


@dataclass
class Search:
    """Result of a grid search: every tried combination with its score, and the refitted winner."""

    model: str
    rows: list[dict] = field(default_factory=list)
    best: Model | None = None
    best_params: dict | None = None


def combinations(grid: Mapping[str, Sequence]) -> list[dict]:
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def f1_evaluator(label: str) -> MulticlassClassificationEvaluator:
    return MulticlassClassificationEvaluator(labelCol=label, metricName="fMeasureByLabel", metricLabel=1.0, predictionCol="prediction")


class _Choice(Estimator):
    """One fully set pipeline per entry of the grid, so that any mix of models fits one cross-validator."""

    choice = Param(Params._dummy(), "choice", "index of the pipeline", TypeConverters.toInt)

    def __init__(self, pipelines: Sequence[Pipeline]):
        super().__init__()
        self.pipelines = list(pipelines)
        self._setDefault(choice=0)

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        return self.pipelines[self.getOrDefault("choice")].fit(dataset)


def grid_search(
    train: DataFrame, name: str, columns: Sequence[str], label: str, fold: str, grid: Mapping[str, Sequence] | None = None,
    weight: str | None = "class_weight", parallelism: int = 4, seed: int = 42,
) -> Search:
    """Cross-validated search on given folds, scored by F1 of class 1; the best choice is refitted on all of ``train``.

    The trees of ``xgb`` grow side by side for all choices and folds (see ``boosting``), and the fits of ``logreg`` go side by side (see ``logistic``) where labels are
    0 and 1 and every fold has both; the other models are fitted one by one.
    """
    if name == "xgb":
        rows, best, params = staged_search(train, None, columns, label, fold, GRIDS[name] if grid is None else grid, seed)
        return Search(name, rows, PipelineModel([best]), params)
    tried = combinations(GRIDS[name] if grid is None else grid)
    rows = train.count()
    pipelines = [Pipeline(stages=[*preprocessing(columns), *classifier(name, p, rows, label, weight, seed)]) for p in tried]
    if name == "logreg":
        f1 = scores_by_fold(train, columns, label, fold, [penalty(p, rows) for p in tried], weight is not None)
        if f1 is not None:
            scored = [{"model": name, "params": p, "mean_score": float(np.mean(own)), "std_score": float(np.std(own))} for p, own in zip(tried, f1)]
            winner = int(np.argmax(f1.mean(axis=1)))
            return Search(name, scored, pipelines[winner].fit(train), tried[winner])
    return search_pipelines(train, name, tried, pipelines, label, fold, parallelism)


def search_pipelines(train: DataFrame, name: str, tried: Sequence[dict], pipelines: Sequence[Pipeline], label: str, fold: str, parallelism: int = 4) -> Search:
    """Score one pipeline a choice on given folds by F1 of class 1, mean and population deviation over the folds; the first of the best is refitted on all rows."""
    chooser = _Choice(pipelines)
    folds = train.agg(F.max(fold)).first()[0] + 1
    search = CrossValidator(
        estimator=chooser, estimatorParamMaps=[{chooser.choice: i} for i in range(len(tried))], evaluator=f1_evaluator(label),
        numFolds=folds, foldCol=fold, parallelism=parallelism,
    ).fit(train)
    scored = [
        {"model": name, "params": p, "mean_score": float(m), "std_score": float(s)}
        for p, m, s in zip(tried, search.avgMetrics, search.stdMetrics)
    ]
    winner = int(np.argmax(search.avgMetrics))
    return Search(name, scored, search.bestModel, tried[winner])


class NearestModel(Model):
    """A fitted nearest-neighbour classifier: the training points, how columns are scaled, and how neighbours vote."""

    def __init__(self, points: DataFrame, columns: Sequence[str], label: str, stats: Mapping[str, Sequence[float]], k: int, weights: str, p: int):
        super().__init__()
        self.points, self.columns, self.label = points, list(columns), label
        self.stats, self.k, self.weights, self.p = {c: tuple(v) for c, v in stats.items()}, k, weights, p

    @classmethod
    def fit_on(cls, train: DataFrame, row_id: str, columns: Sequence[str], label: str, k: int = 5, weights: str = "uniform", p: int = 2) -> NearestModel:
        """Missing values get the column's mean; columns are scaled by their population deviation."""
        row = train.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
        stats = {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns}
        model = cls(train, columns, label, stats, k, weights, p)
        model.points = cut_lineage(train.select(F.col(row_id).alias("_point"), F.col(label).cast("int").alias(label), model.vector().alias("_v")))
        return model

    def vector(self) -> Column:
        return F.array(*[(F.coalesce(F.col(c).cast("double"), F.lit(m)) - m) / d for c, (m, d) in self.stats.items()])

    def neighbours(self, queries: DataFrame, k: int) -> DataFrame:
        """The ``k`` nearest training points of rows (_query, _v)."""
        return nearest(queries, self.points, "_query", "_point", "_v", "_v", k, metric="manhattan" if self.p == 1 else "euclidean")

    def votes(self, near: DataFrame) -> DataFrame:
        return vote_of_neighbours(near, self.points, "_query", "_point", self.label, self.weights)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Adds ``prediction`` and ``probability`` (of class 1); rows may repeat."""
        rows = cut_lineage(dataset.withColumn("_query", F.monotonically_increasing_id()))
        found = self.votes(self.neighbours(rows.select("_query", self.vector().alias("_v")), self.k))
        return rows.join(found.select("_query", "prediction", "probability"), "_query", "left").drop("_query")

    def store(self, path: str) -> None:
        spark = self.points.sparkSession
        self.points.write.mode("overwrite").parquet(f"{path}/points")
        kept = {"columns": self.columns, "label": self.label, "stats": self.stats, "k": self.k, "weights": self.weights, "p": self.p}
        spark.createDataFrame([(json.dumps(kept),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/nearest")

    @classmethod
    def read_from(cls, spark, path: str) -> NearestModel:
        kept = json.loads(spark.read.text(f"{path}/nearest").first()[0])
        return cls(spark.read.parquet(f"{path}/points"), kept["columns"], kept["label"], kept["stats"], kept["k"], kept["weights"], kept["p"])


def knn_search(
    train: DataFrame, row_id: str, columns: Sequence[str], label: str, fold: str, grid: Mapping[str, Sequence] | None = None,
) -> Search:
    """Grid search of the nearest-neighbour classifier: neighbours are found once per fold and metric for the largest k.

    The best choice is refitted on all of ``train``.
    """
    from .evaluate import scores

    grid = dict(GRIDS["knn"] if grid is None else grid)
    folds = train.agg(F.max(fold)).first()[0] + 1
    found: dict[tuple, list[float]] = {}
    for f in range(folds):
        held = train.filter(F.col(fold) == f)
        for p in grid.get("p", [2]):
            model = NearestModel.fit_on(train.filter(F.col(fold) != f), row_id, columns, label, max(grid["n_neighbors"]), p=p)
            queries = cut_lineage(held.select(F.col(row_id).alias("_query"), label, model.vector().alias("_v")))
            near = cut_lineage(model.neighbours(queries.select("_query", "_v"), model.k))
            votes = []
            for k, w in product(grid["n_neighbors"], grid.get("weights", ["uniform"])):
                model.weights = w
                votes.append(model.votes(near.filter(F.col("rank") <= k)).select(F.lit(k).alias("_k"), F.lit(w).alias("_w"), "_query", "prediction"))
            truth = queries.select("_query", label)
            for r in scores(stacked(*votes).join(truth, "_query"), label, "prediction", "_k", "_w").collect():  # one row per choice
                found.setdefault((r["_k"], r["_w"], p), []).append(r["f1"])
    rows = [
        {"model": "knn", "params": {"n_neighbors": k, "weights": w, "p": p}, "mean_score": float(np.mean(v)), "std_score": float(np.std(v))}
        for (k, w, p), v in sorted(found.items())
    ]
    best = max(rows, key=lambda r: r["mean_score"])["params"]
    return Search("knn", rows, NearestModel.fit_on(train, row_id, columns, label, best["n_neighbors"], best["weights"], best["p"]), best)


def summary(spark, searches: Sequence[Search]) -> DataFrame:
    """Best row of each model, best mean score first; parameters as one text."""
    best = [max(s.rows, key=lambda r: r["mean_score"]) for s in searches]
    rows = [
        (FULL_NAMES[r["model"]], r["model"], ",".join(f"{k} = {v}" for k, v in r["params"].items()), r["mean_score"], r["std_score"])
        for r in best
    ]
    schema = "full_name string, model string, params string, mean_score double, std_score double"
    return spark.createDataFrame(rows, schema).orderBy(F.desc("mean_score"), "model")


def save_model(model: Model, path: str) -> None:
    if isinstance(model, NearestModel):
        model.store(path)
    else:
        model.write().overwrite().save(path)


def load_model(path: str, spark: SparkSession | None = None) -> Model:
    """A saved pipeline or nearest-neighbour model."""
    spark = spark or SparkSession.active()
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/nearest")
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return NearestModel.read_from(spark, path)
    return PipelineModel.load(path)


def score_table(model: Transformer, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Predicted class and, where the model gives one, the probability of class 1 (a vector by class, or the number itself)."""
    scored = model.transform(df)
    kinds = dict(scored.dtypes)
    if kinds.get("probability") in ("double", "float"):
        chance = F.col("probability").cast("double")
    elif "probability" in kinds:
        chance = F.get(vector_to_array("probability"), F.lit(1))
    elif "rawPrediction" in kinds:
        chance = F.get(vector_to_array("rawPrediction"), F.lit(1))
    else:
        chance = F.lit(None).cast("double")
    return scored.select(*keep, F.col("prediction").cast("int").alias("prediction"), chance.alias("score"))
