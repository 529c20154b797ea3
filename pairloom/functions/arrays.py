"""Array, map and vector-array expressions; every one stays inside the row it is given."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, last_digit


def length_or_zero(values: Column | str) -> Column:
    return F.coalesce(F.size(_col(values)), F.lit(0))


def has_items(values: Column | str) -> Column:
    return F.coalesce(F.size(_col(values)) > 0, F.lit(False))


def _filled(values: Column) -> Column:
    """Null for null or empty arrays, so that statistics of nothing are null."""
    return F.when(F.size(values) > 0, values)


def middle_of(ordered: Column | str) -> Column:
    """Median of an array that is already in order, null for an empty one."""
    ordered = _col(ordered)
    n = F.size(ordered)
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2


def median_of(values: Column | str) -> Column:
    return middle_of(F.array_sort(_col(values)))


def share_of(values: Column | str, test: Callable[[Column], Column]) -> Column:
    """Fraction of the elements that pass ``test``."""
    values = _filled(_col(values))
    return F.size(F.filter(values, test)) / F.size(values)


def smallest(values: Column | str) -> Column:
    return F.array_min(_filled(_col(values)))


def highest_code(codes: Column | str, absent: str = "NA") -> Column:
    """Largest trailing digit of a list of codes; the ``absent`` code does not count."""
    return F.array_max(F.transform(F.filter(_col(codes), lambda x: x != absent), last_digit))


def nested_values(
    rows: Column | str, inner: Callable[[Column], Column], keep: Callable[[Column], Column], value: Callable[[Column], Column]
) -> Column:
    """Flatten arrays inside arrays: ``inner`` picks the nested array, ``keep`` filters it, ``value`` projects it."""
    picked = F.transform(
        F.filter(_col(rows), lambda r: inner(r).isNotNull()), lambda r: F.transform(F.filter(inner(r), keep), value)
    )
    return F.flatten(picked)


def last_reference(refs: Column | str, kind: str) -> Column:
    """Ids of the last reference of one kind, null when there is none."""
    found = F.try_element_at(F.filter(_col(refs), lambda r: r["ref_type"] == kind), F.lit(-1))
    return F.split(found["ref_id"], ",")


def all_references(refs: Column | str, kind: str) -> Column:
    """Ids of all references of one kind, in order."""
    mine = F.filter(_col(refs), lambda r: r["ref_type"] == kind)
    return F.flatten(F.transform(mine, lambda r: F.split(r["ref_id"], ",")))


def map_members(m: Column | str) -> Column:
    """Distinct members of all the lists of a map."""
    return F.array_distinct(F.flatten(F.map_values(_col(m))))


def shared_count(a: Column | str, b: Column | str) -> Column:
    return length_or_zero(F.array_intersect(_col(a), _col(b)))


def union_count(a: Column | str, b: Column | str) -> Column:
    return length_or_zero(F.array_union(_col(a), _col(b)))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """|a and b| / |a or b| of the distinct members; two empty sets give 0."""
    return F.coalesce(F.try_divide(shared_count(a, b).cast("double"), union_count(a, b)), F.lit(0.0))


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))



def distinct_prefixes(path: Column | str, separator: str = ".") -> Column:
    """Every ancestor path of a separated path, itself included."""
    parts = F.split(_col(path), "[" + separator + "]")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), separator))
