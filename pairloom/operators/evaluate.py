"""Evaluation and interpretation of scored tables; curves and metrics are exact at any size."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.outcomes import case_tag
from .aggregates import correlations, feature_summary
from .ordering import row_index, running_totals, shuffle_key


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(label, predicted).agg(F.count("*").alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def _cells(label: str, predicted: str) -> dict[str, Column]:
    y, z = F.col(label).cast("int"), F.col(predicted).cast("int")
    return {
        "tp": F.count_if((y == 1) & (z == 1)), "fp": F.count_if((y == 0) & (z == 1)),
        "fn": F.count_if((y == 1) & (z == 0)), "tn": F.count_if((y == 0) & (z == 0)),
    }


def _metrics(counts: DataFrame, *keep: str) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        *keep, _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def scores(df: DataFrame, label: str, predicted: str, *by: str) -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1; a ratio without denominator is 0."""
    cells = [c.alias(n) for n, c in _cells(label, predicted).items()]
    return _metrics(df.groupBy(*by).agg(*cells), *by)


def threshold_counts(df: DataFrame, score: str, label: str) -> DataFrame:
    """Per distinct score, best first: its positives and negatives and the running true and false positives."""
    y = F.col(label).cast("int")
    per_score = df.groupBy(score).agg(F.count_if(y == 1).alias("positives"), F.count_if(y == 0).alias("negatives"))
    return running_totals(per_score, [F.desc(score)], {"tp": "positives", "fp": "negatives"})


def _with_totals(points: DataFrame) -> DataFrame:
    return points.withColumns({
        "all_pos": points.agg(F.sum("positives")).scalar(), "all_neg": points.agg(F.sum("negatives")).scalar(),
    })


def roc_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """True and false positive rate at every distinct score used as threshold."""
    t = _with_totals(threshold_counts(df, score, label))
    return t.select(
        F.col(score).alias("threshold"), (F.col("tp") / F.col("all_pos")).alias("tpr"), (F.col("fp") / F.col("all_neg")).alias("fpr")
    )


def precision_recall_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    t = _with_totals(threshold_counts(df, score, label))
    return t.select(
        F.col(score).alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        (F.col("tp") / F.col("all_pos")).alias("recall"),
    )


def ranking_metrics(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: ROC AUC (ties count half), average precision (step sum, not trapezoids) and the positive rate."""
    t = _with_totals(threshold_counts(df, score, label))
    pos, neg, tp, fp = (F.col(c) for c in ("positives", "negatives", "tp", "fp"))
    area = F.sum(neg * (tp - pos / 2.0))
    steps = F.sum(pos * (tp / (tp + fp)))
    all_pos, all_neg = F.max("all_pos"), F.max("all_neg")
    return t.agg(
        F.try_divide(area, all_pos.cast("double") * all_neg).alias("roc_auc"),
        F.try_divide(steps, all_pos).alias("average_precision"),
        F.try_divide(all_pos.cast("double"), all_pos + all_neg).alias("positive_rate"),
    )


def case_table(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Tag every scored row TP, TN, FP or FN, with 0/1 columns for each tag and for being right."""
    tagged = df.withColumn("case", case_tag(F.col(label).cast("int"), F.col(predicted).cast("int")))
    flags = {c: (F.col("case") == c).cast("int") for c in ("TP", "TN", "FP", "FN")}
    return tagged.withColumns({"correct": F.col("case").isin("TP", "TN").cast("int"), **flags})


CASE_FLAGS = ("correct", "TP", "TN", "FP", "FN")


def case_correlations(cases: DataFrame, features: Sequence[str]) -> DataFrame:
    """Correlation of each feature with being right and with each case; features without any value are left out."""
    long = correlations(cases, features, CASE_FLAGS)
    wide = long.groupBy("feature").agg(*[F.max(F.when(F.col("other") == c, F.col("r"))).alias(c) for c in CASE_FLAGS])
    return wide.dropna("all", subset=list(CASE_FLAGS))


def case_distributions(cases: DataFrame, features: Sequence[str]) -> DataFrame:
    return feature_summary(cases, features, "correct")


SHIFT_STEP = 104_729  # a large prime, so that the distances of successive repeats are spread over the table


def permutation_importance(
    model: Transformer, df: DataFrame, features: Sequence[str], label: str, row_id: str, repeats: int = 10, seed: int = 42
) -> DataFrame:
    """Mean and deviation of the drop in F1 when one feature's values are dealt out to other rows.

    Rows get a seeded random position once; each repeat hands every row the values of the row a certain distance
    further on, so permuting costs one equi-join instead of a sort per feature and repeat.
    """
    rows = row_index(df.select(row_id, label, *features), shuffle_key(row_id, seed), row_id, name="_i")
    n = rows.count()
    shifts = [1 + (r * SHIFT_STEP + seed) % max(n - 1, 1) for r in range(repeats)]
    rounds = F.explode(F.array(*[F.struct(F.lit(r).alias("repeat"), F.lit(s).alias("shift")) for r, s in enumerate(shifts)]))
    donors = rows.select(F.struct(*features).alias("_given"), "_i", rounds.alias("_r")).select(
        F.pmod(F.col("_i") + F.col("_r.shift"), F.lit(n)).alias("_i"), F.col("_r.repeat").alias("repeat"), "_given"
    )
    which = F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1)))
    dealt = rows.join(donors, "_i").withColumn("_which", which)
    swapped = dealt.select(
        label, "repeat", "_which",
        *[F.when(F.col("_which") == i, F.col(f"_given.{c}")).otherwise(F.col(c)).alias(c) for i, c in enumerate(features)],
    )
    base = scores(model.transform(rows), label, "prediction").select("f1").scalar()
    each = scores(model.transform(swapped), label, "prediction", "repeat", "_which").withColumn("_base", base)
    names = F.array(*[F.lit(c) for c in features])
    drops = each.select(F.get(names, F.col("_which")).alias("feature"), (F.col("_base") - F.col("f1")).alias("_d"))
    out = drops.groupBy("feature").agg(F.avg("_d").alias("importance"), F.stddev_pop("_d").alias("deviation"))
    return out.orderBy(F.desc("importance"), "feature")


def dependence_grid(df: DataFrame, feature: str, points: int = 100, low: float = 0.05, high: float = 0.95) -> list[float]:
    """Values to try for a feature: its distinct values if few, else evenly spaced between two percentiles."""
    distinct = df.select(F.col(feature).cast("double").alias("v")).dropna().distinct().limit(points).collect()
    if len(distinct) < points:
        return sorted(r["v"] for r in distinct)
    counts = df.select(F.col(feature).cast("double").alias("v")).dropna().groupBy("v").agg(F.count("*").alias("n"))
    a, b = counts.agg(F.percentile("v", [low, high], F.col("n"))).first()[0]
    return [float(v) for v in np.linspace(a, b, points)]


def _positive_chance(scored: DataFrame) -> Column:
    """Score of class 1: from a vector of a fitted model, or as a rule gives it."""
    name = "probability" if "probability" in scored.columns else "rawPrediction"
    if scored.schema[name].dataType.typeName() == "double":
        return F.col(name)
    return F.get(vector_to_array(name), F.lit(1))


def _literals(values: Sequence[float]) -> Column:
    return F.explode(F.array(*[F.lit(float(v)) for v in values]))


def partial_dependence(model: Transformer, df: DataFrame, feature: str, grid: Sequence[float], row_id: str | None = None) -> DataFrame:
    """Mean score when every row takes each grid value of one feature; with ``row_id``, the curve of every row instead."""
    scored = model.transform(df.withColumn(feature, _literals(grid)))
    values = scored.withColumn("score", _positive_chance(scored))
    if row_id:
        return values.select(row_id, F.col(feature).alias("value"), "score")
    return values.groupBy(F.col(feature).alias("value")).agg(F.avg("score").alias("score")).orderBy("value")


def partial_dependence_2d(model: Transformer, df: DataFrame, features: tuple[str, str], grids: tuple[Sequence[float], Sequence[float]]) -> DataFrame:
    a, b = features
    scored = model.transform(df.withColumn(a, _literals(grids[0])).withColumn(b, _literals(grids[1])))
    values = scored.withColumn("score", _positive_chance(scored))
    return values.groupBy(F.col(a).alias("value_a"), F.col(b).alias("value_b")).agg(F.avg("score").alias("score")).orderBy("value_a", "value_b")


def model_importance(spark, model: Transformer, features: Sequence[str]) -> DataFrame:
    """Importance the model itself gives to its inputs: tree importances, how often boosted trees split on it, or absolute coefficients."""
    last = model.stages[-1] if hasattr(model, "stages") else model
    if hasattr(last, "importances"):
        weights = np.array([last.importances()[f] for f in features], float)
    elif hasattr(last, "featureImportances"):
        weights = last.featureImportances.toArray()
    else:
        weights = np.abs(last.coefficients.toArray())
    return spark.createDataFrame([(f, float(w)) for f, w in zip(features, weights)], "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )
