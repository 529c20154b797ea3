"""Joins and look-ups. Dictionaries and row loops become equi-joins; nothing is collected to the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more than 1/HOT_SHARE of the rows, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 64
SALTS = 64


def hot_rows(counts: DataFrame, n: str, *keys: str, share: int = HOT_SHARE) -> DataFrame:
    """Keys of a count table that hold more than ``1/share`` of the total: fewer than ``share`` rows by construction."""
    total = counts.agg(F.sum(n)).scalar()
    return counts.filter(F.col(n) * share > total).select(*keys)


def salted_join(
    many: DataFrame, one: DataFrame, on: str | Sequence[str], hot: DataFrame, spread: Sequence[str], how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Equi-join of a long table with a look-up table whose hot keys are known (see ``hot_rows``).

    Rows of a hot key are spread over ``salts`` partitions by a hash of the columns ``spread``, and only the
    look-up rows of those keys are repeated. The list of hot keys is bounded, so it is the one thing broadcast.
    Use it where key counts are at hand anyway. Other joins are written plainly and leave hot keys to the
    adaptive skew join, which ``session.configure`` switches on: finding hot keys by an extra pass would
    compute the long side twice.
    """
    keys = [on] if isinstance(on, str) else list(on)
    marked = F.broadcast(hot.select(*keys, F.lit(True).alias("_hot")))
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    left = many.join(marked, keys, "left").withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(F.lit(0))).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = one.join(marked, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def left_join_or(left: DataFrame, right: DataFrame, on: str | Sequence[str], defaults: Mapping[str, object]) -> DataFrame:
    """Left outer join; the columns of ``right`` named in ``defaults`` never stay null."""
    joined = left.join(right, on, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def star_join(facts: DataFrame, *sides: tuple[DataFrame, str | Sequence[str]]) -> DataFrame:
    """Inner-join a fact table with its dimensions in turn; broadcast or shuffle is chosen from their sizes."""
    out = facts
    for table, keys in sides:
        out = out.join(table, keys)
    return out


def bind_columns(a: DataFrame, b: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Put two tables of the same rows side by side, on the key both carry."""
    return a.join(b, key)


def map_elements(
    df: DataFrame, row_id: str, array: str, mapping: DataFrame, source: str, target: str, out: str
) -> DataFrame:
    """Replace every element of an id array by its mapped values (one or many), dropping unmapped ones.

    Order and duplicates of the array are kept; several values of one id come in ascending order. Rows that share an
    id are mapped apart: lists are regrouped by id and content, so only rows with equal lists share a result.
    """
    pairs = mapping.select(F.col(source).alias("_e"), F.col(target).alias("_v"))
    rows = df.select(F.col(row_id).alias("_id"), F.col(array).alias("_a")).distinct()
    elements = rows.select("_id", "_a", F.posexplode("_a").alias("_pos", "_e"))
    found = elements.join(pairs, "_e")
    lists = found.groupBy("_id", "_a").agg(F.array_sort(F.collect_list(F.struct("_pos", "_v"))).alias("_l"))
    mapped = lists.select("_id", "_a", F.transform("_l", lambda x: x["_v"]).alias(out))
    empty = F.array().cast(mapped.schema[out].dataType)
    same = F.col(row_id).eqNullSafe(F.col("_id")) & F.col(array).eqNullSafe(F.col("_a"))
    return df.join(mapped, same, "left").drop("_id", "_a").withColumn(out, F.coalesce(F.col(out), empty))


def keep_members(df: DataFrame, row_id: str, array: str, ids: DataFrame, id_column: str, out: str) -> DataFrame:
    """Keep the elements of an id array that occur in a reference table, in their order."""
    wanted = ids.select(F.col(id_column).alias("_k")).distinct()
    return map_elements(df, row_id, array, wanted, "_k", "_k", out)


def multi_map(df: DataFrame, key: str, value: str, out: str = "members") -> DataFrame:
    """Key to the ascending list of its distinct values."""
    return df.select(key, value).distinct().groupBy(key).agg(F.array_sort(F.collect_list(value)).alias(out))


def last_wins(df: DataFrame, key: str, value: str, order: Column | str) -> DataFrame:
    """One value per key: that of the last row in ``order`` (a dictionary that is overwritten); of equals the smallest value."""
    last = F.col(order) if isinstance(order, str) else order
    ties = df.select(key, value, last.alias("_o")).groupBy(key, "_o").agg(F.min(value).alias(value))
    return ties.groupBy(key).agg(F.max_by(value, "_o").alias(value))


def look_up(df: DataFrame, key: str, mapping: DataFrame, value: str, default: object) -> DataFrame:
    """Scalar look-up with a default for unknown keys."""
    return left_join_or(df, mapping.select(key, value), key, {value: default})


def attach_map(
    parents: DataFrame, children: DataFrame, parent: str, key: str, items: str, out: str, no_key: str = "", repeats: bool = True
) -> DataFrame:
    """Attach to each parent a map from a child attribute to the items of those children.

    Children are counted per (parent, key, item) before anything is gathered, so what is shuffled per parent
    is its distinct items. Items come in ascending order as (item, n), n being how often they occur, or as plain items with
    ``repeats`` off; ``repeated_items`` writes a counted list out. A missing key becomes ``no_key``; a parent without children gets null.
    """
    flat = children.select(parent, F.coalesce(F.col(key), F.lit(no_key)).alias("_k"), F.explode(items).alias("_i"))
    counted = flat.groupBy(parent, "_k", "_i").agg(F.count("*").cast("int").alias("_n"))
    listed = counted.groupBy(parent, "_k").agg(F.array_sort(F.collect_list(F.struct("_i", "_n"))).alias("_l"))
    shown = (lambda x: F.struct(x["_i"].alias("item"), x["_n"].alias("n"))) if repeats else (lambda x: x["_i"])
    entries = listed.select(parent, F.struct(F.col("_k").alias("key"), F.transform("_l", shown).alias("value")).alias("_s"))
    maps = entries.groupBy(parent).agg(F.map_from_entries(F.array_sort(F.collect_list("_s"))).alias(out))
    return parents.join(maps, parent, "left")


def repeated_items(counted: Column) -> Column:
    """A list of (item, n) written out, each item n times."""
    return F.flatten(F.transform(counted, lambda x: F.array_repeat(x["item"], x["n"])))


def plain_items(mapping: Column | str) -> Column:
    """A map of counted lists as a map of the items alone."""
    return F.transform_values(mapping, lambda _, counted: F.transform(counted, lambda x: x["item"]))
