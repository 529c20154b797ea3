"""Counts, profiles and statistics. All are one grouped pass with partial aggregation before the shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_min(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Smallest value per key; rows with a null key form no group."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.min(value).alias(value))


def group_sizes(df: DataFrame, *keys: str) -> DataFrame:
    """Rows per key; null keys are a group."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency of the non-null values, most frequent first."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), column)


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[object], names: Sequence[str] | None = None) -> DataFrame:
    """Counts of ``row`` by the given values of ``column``; empty cells are 0."""
    names = list(names or [str(v) for v in values])
    cells = [F.count_if(F.col(column) == F.lit(v)).alias(n) for v, n in zip(values, names)]
    return df.groupBy(row).agg(*cells)


def shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Divide the named columns of each row by their sum."""
    total = reduce(lambda a, b: a + b, [F.col(c) for c in columns])
    return df.withColumns({c: F.try_divide(F.col(c).cast("double"), total) for c in columns})


def duplicate_count(df: DataFrame, *keys: str) -> DataFrame:
    """Rows beyond the first of their key; nulls are equal to each other."""
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def null_counts(df: DataFrame) -> DataFrame:
    """One row: the number of nulls of every column."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def missing_indicators(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_is_missing": F.col(c).isNull().cast("int") for c in columns})


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: its number of distinct non-null values.

    Values are made distinct per column in one shuffle, so no single task sees all values of a column.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    values = df.select(pairs.alias("_p")).select("_p.*").filter(F.col("value").isNotNull()).distinct()
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    counted = values.groupBy("column").agg(F.count("*").alias("n_distinct"))
    return names.join(counted, "column", "left").fillna(0, ["n_distinct"])


def shape_report(tables: Mapping[str, DataFrame], label: tuple[str, str] | None = None) -> DataFrame:
    """Rows and columns of each table; ``label=(table, column)`` adds a row per value of one column with its count."""
    rows = [
        df.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("table"), F.lit(None).cast("string").alias("label"), "rows", F.lit(len(df.columns)).cast("bigint").alias("columns")
        )
        for name, df in tables.items()
    ]
    if label is not None:
        table, column = label
        counts = tables[table].groupBy(F.coalesce(F.col(column).cast("string"), F.lit("null")).alias("label")).agg(F.count("*").alias("rows"))
        rows.append(counts.select(F.lit(table).alias("table"), "label", "rows", F.lit(None).cast("bigint").alias("columns")))
    return reduce(lambda a, b: a.unionByName(b), rows)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight ``n / (classes * n_class)`` per class."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    classes = counts.agg(F.count("*")).scalar()
    return counts.select(label, "n", (total / (classes * F.col("n"))).alias("weight"))


def class_ratio(df: DataFrame, label: str) -> DataFrame:
    """Negatives per positive of a 0/1 label."""
    return df.agg(F.try_divide(F.count_if(F.col(label) == 0).cast("double"), F.count_if(F.col(label) == 1)).alias("ratio"))


def size_summary(df: DataFrame, array: str) -> DataFrame:
    """Count and median of the array sizes; sizes are counted first, so the median sees one row per size."""
    sizes = df.select(F.coalesce(F.size(array), F.lit(0)).alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("entities"), F.percentile("s", F.lit(0.5), F.col("n")).alias("median_size"))


def feature_summary(df: DataFrame, features: Sequence[str], by: str, accuracy: int = 10000) -> DataFrame:
    """Per feature and group: count, mean, deviation, range and approximate quartiles (what a violin plot draws)."""
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features]))
    long = df.select(F.col(by), stacked.alias("_s")).select(by, "_s.*")
    return long.groupBy("feature", by).agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev("value").alias("deviation"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.percentile_approx("value", [0.25, 0.5, 0.75], accuracy).alias("quartiles"),
    )


FEW_PAIRS = 32
MOMENTS = ("n", "sx", "sy", "sxx", "syy", "sxy")
CONSTANT = 1e-12  # a spread below this share of the sum of squares is rounding


def correlations(df: DataFrame, rows: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of each row feature with each column feature, over the rows where both are known.

    Null and NaN are unknown. A feature that is constant over the shared rows gives null. Up to FEW_PAIRS pairs are one
    aggregation on the JVM. For more, sums of products are matrix products inside each task, added up per pair, so the shuffle carries one
    small matrix per task; values are shifted by the column means first to keep the sums of squares accurate.
    """
    names = list(dict.fromkeys([*rows, *columns]))
    cast = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in names])
    asked = list(dict.fromkeys((r, c) for r in rows for c in columns))
    different = list(dict.fromkeys(tuple(sorted(pair)) for pair in asked))
    if len(different) <= FEW_PAIRS:
        def moments(i: int, a: str, b: str) -> list[Column]:
            x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
            sides = [f(v).alias(f"{k}{n}{i}") for n, v in (("x", x), ("y", y)) for k, f in (("v", F.var_pop), ("s", lambda z: F.avg(z * z)))]
            return [F.covar_pop(a, b).alias(f"c{i}"), *sides]

        found = cast.agg(*[m for i, (a, b) in enumerate(different) for m in moments(i, a, b)])
        number = {pair: i for i, pair in enumerate(different)}

        def cell(r: str, c: str) -> Column:
            i = number[tuple(sorted((r, c)))]
            varies = (F.col(f"vx{i}") > CONSTANT * F.col(f"sx{i}")) & (F.col(f"vy{i}") > CONSTANT * F.col(f"sy{i}"))
            value = F.lit(1.0) if r == c else F.try_divide(F.col(f"c{i}"), F.sqrt(F.col(f"vx{i}") * F.col(f"vy{i}")))
            return F.struct(F.lit(r).alias("feature"), F.lit(c).alias("other"), F.when(varies, value).alias("r"))

        return found.select(F.explode(F.array(*[cell(r, c) for r, c in asked])).alias("x")).select("x.*")
    means = cast.agg(*[F.avg(c).alias(c) for c in names]).first()
    shift = np.array([means[c] or 0.0 for c in names])
    at = {c: i for i, c in enumerate(names)}
    ri, ci = [at[r] for r in rows], [at[c] for c in columns]
    grid_r, grid_c = np.repeat(list(rows), len(columns)), np.tile(list(columns), len(rows))

    def partial_sums(batches):
        total = None
        for batch in batches:
            x = batch.to_numpy(dtype=float) - shift
            known = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            mr, mc, xr, xc = known[:, ri], known[:, ci], x[:, ri], x[:, ci]
            part = np.stack([mr.T @ mc, xr.T @ mc, mr.T @ xc, (xr * xr).T @ mc, mr.T @ (xc * xc), xr.T @ xc])
            total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"feature": grid_r, "other": grid_c, **{m: total[i].ravel() for i, m in enumerate(MOMENTS)}})

    schema = "feature string, other string, " + ", ".join(f"{m} double" for m in MOMENTS)
    sums = cast.mapInPandas(partial_sums, schema).groupBy("feature", "other").agg(*[F.sum(m).alias(m) for m in MOMENTS])
    n, sx, sy, sxx, syy, sxy = [F.col(m) for m in MOMENTS]
    spread_x, spread_y = n * sxx - sx * sx, n * syy - sy * sy
    varies = (spread_x > CONSTANT * n * sxx) & (spread_y > CONSTANT * n * syy)
    value = F.when(F.col("feature") == F.col("other"), 1.0).otherwise((n * sxy - sx * sy) / F.sqrt(spread_x * spread_y))
    return sums.select("feature", "other", F.when(varies, value).alias("r"))


def missingness_correlations(df: DataFrame, missing: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Correlation of "is missing" indicators with features."""
    flags = missing_indicators(df, missing)
    return correlations(flags, [f"{c}_is_missing" for c in missing], features).filter(F.col("r").isNotNull())


def yearly_stability(df: DataFrame, date_year: Column, flag: str, values: Sequence[object], names: Sequence[str], rows: int = 4):
    """Counts and shares of a flag per year with their trailing means; the null year comes last."""
    from .ordering import rolling_mean

    counts = crosstab(df.select(date_year.alias("year"), flag), "year", flag, values, names)
    total = reduce(lambda a, b: a + b, [F.col(n) for n in names])
    both = counts.withColumns({f"{n}_share": F.try_divide(F.col(n).cast("double"), total) for n in names})
    measured = [*names, *[f"{n}_share" for n in names]]
    rolled = rolling_mean(both.withColumns({f"{m}_mean": F.col(m) for m in measured}), "year", [f"{m}_mean" for m in measured], rows)
    return rolled


def vector_sums(df: DataFrame, keys: Sequence[str], elements: Sequence[Column], out: str) -> DataFrame:
    """Sums of vectors per group, given by their ``elements``, as one array.

    Every element is a sum of its own, so groups are kept in a hash table of plain numbers and added up before the shuffle, however many there are.
    """
    names = [f"_e{i}" for i in range(len(elements))]
    sums = df.groupBy(*keys).agg(*[F.coalesce(F.sum(e), F.lit(0.0)).alias(n) for n, e in zip(names, elements)])
    return sums.select(*keys, F.array(*names).cast("array<double>").alias(out))
