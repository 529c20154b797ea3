"""Partial ISO dates held as text, with the sentinels that stand for "no date".

``2004``, ``2004-05`` and ``2004-05-17`` compare correctly as strings, so minima, maxima and ranges work
on the text itself; parsing is only needed to get at the calendar year.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col

# Larger and smaller than any date text.
NO_FIRST = "9999"
NO_LAST = "0000"


def parsed_date(c: Column | str) -> Column:
    """Date of a partial ISO text, null where it does not parse."""
    c = _col(c)
    return F.coalesce(
        F.try_to_timestamp(c, F.lit("yyyy-MM-dd")),
        F.try_to_timestamp(c, F.lit("yyyy-MM")),
        F.try_to_timestamp(c, F.lit("yyyy")),
    ).cast("date")


def date_year(c: Column | str) -> Column:
    """Year of a partial date; the sentinel for "no first date" has none."""
    c = _col(c)
    return F.year(parsed_date(F.when(c != NO_FIRST, c)))


def year_text(year: Column | str) -> Column:
    """Numeric year to text, ``9999`` when missing."""
    return F.coalesce(_col(year).cast("int").cast("string"), F.lit(NO_FIRST))


def first_date_or(first: Column | str, fallback: Column | str) -> Column:
    """First date with a fallback text; when both are missing the date counts as the oldest."""
    first, fallback = _col(first), _col(fallback)
    chosen = F.when(first != NO_FIRST, first).otherwise(F.coalesce(fallback, F.lit(NO_FIRST)))
    return F.when(chosen == NO_FIRST, F.lit(NO_LAST)).otherwise(chosen)


def in_date_range(c: Column | str, low: str, high: str, keep_missing: bool = False) -> Column:
    """Strictly between two date texts; ``9999`` only passes when asked for."""
    c = _col(c)
    inside = (c > low) & (c < high)
    if keep_missing:
        inside = inside | (c == NO_FIRST)
    return F.coalesce(inside, F.lit(False))


def open_fields(status_json: Column | str) -> Column:
    """The fields of an open JSON object as text; nested objects stay JSON."""
    return F.from_json(_col(status_json), "map<string,string>")


def dates_among(fields: Column | str) -> Column:
    """All dates among open fields: those named like a date, plain or wrapped in ``{"date": ...}``."""
    dated = F.map_filter(_col(fields), lambda k, v: F.contains(F.lower(k), F.lit("date")))
    return F.array_compact(
        F.transform(
            F.map_values(dated),
            lambda v: F.when(F.startswith(v, F.lit("{")), F.get_json_object(v, "$.date")).otherwise(v),
        )
    )


def earliest_date(dates: Column | str) -> Column:
    return F.coalesce(F.array_min(_col(dates)), F.lit(NO_FIRST))


def latest_date(dates: Column | str) -> Column:
    return F.coalesce(F.array_max(_col(dates)), F.lit(NO_LAST))
