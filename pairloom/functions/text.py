"""String predicates, parsing and rendering."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def equals_ignore_case(c: Column | str, value: str) -> Column:
    return F.lower(_col(c)) == F.lit(value.lower())


def any_equals_ignore_case(values: Column | str, value: str) -> Column:
    """True when some element of an array equals ``value`` whatever its case."""
    return F.exists(_col(values), lambda x: F.lower(x) == F.lit(value.lower()))


def contains_ignore_case(c: Column | str, value: str) -> Column:
    return F.contains(F.lower(_col(c)), F.lit(value.lower()))


def ends_ignore_case(c: Column | str, value: str) -> Column:
    return F.endswith(F.lower(_col(c)), F.lit(value.lower()))


def has_prefix(c: Column | str, prefix: str) -> Column:
    return F.startswith(_col(c), F.lit(prefix))


def is_top_category(code: Column | str, prefix: str, max_length: int = 3) -> Column:
    """Codes of one branch that are short enough to be a top-level category."""
    return has_prefix(code, prefix) & (F.length(_col(code)) <= max_length)


def non_empty(c: Column | str) -> Column:
    """False for null and for the empty string."""
    return F.coalesce(F.length(_col(c)) > 0, F.lit(False))


def swap_text(c: Column | str, changes: Mapping[str, str]) -> Column:
    """Literal replacements, applied in the given order."""
    out = _col(c)
    for old, new in changes.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def last_part(c: Column | str, separator: str) -> Column:
    return F.substring_index(_col(c), separator, -1)


def first_part(c: Column | str, separator: str) -> Column:
    return F.substring_index(_col(c), separator, 1)


def last_word(c: Column | str) -> Column:
    return F.try_element_at(F.split(F.trim(_col(c)), r"\s+"), F.lit(-1))



def path_depth(c: Column | str) -> Column:
    return F.size(F.split(_col(c), r"\."))


def joined(tokens: Column | str, separator: str = " ") -> Column:
    return F.concat_ws(separator, _col(tokens))


def outcome_tag(outcome: Column | str, phase: Column | str) -> Column:
    """``success`` and 3 give ``success3``; a missing phase is spelled ``None``."""
    return F.concat(_col(outcome), F.coalesce(_col(phase).cast("string"), F.lit("None")))


def tag_phase(tag: Column | str) -> Column:
    """The phase digit of a tag, null for a tag without phase."""
    return F.right(_col(tag), F.lit(1)).try_cast("int")


def tag_outcome(tag: Column | str) -> Column:
    return F.regexp_replace(_col(tag), r"(None|\d)$", "")


def to_number(c: Column | str) -> Column:
    """Text to double, null where it is no number."""
    return _col(c).try_cast("double")


def p_value(c: Column | str, mode: str = "digits") -> Column:
    """Read a p-value text.

    ``digits`` keeps digits and dots only, so ``1E-5`` reads as 15.0 as the published labels do;
    ``scientific`` also understands exponents. Unreadable text is null.
    """
    if mode == "digits":
        return F.regexp_replace(_col(c), "[^0-9.]", "").try_cast("double")
    if mode == "scientific":
        return F.regexp_extract(_col(c), r"([0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)", 1).try_cast("double")
    raise ValueError(f"unknown mode {mode!r}")


def last_digit(c: Column | str) -> Column:
    return F.right(_col(c), F.lit(1)).try_cast("int")


def cropped(c: Column | str, width: int, mark: str = "...") -> Column:
    c = _col(c)
    return F.when(F.length(c) > width, F.concat(F.left(c, F.lit(width)), F.lit(mark))).otherwise(c)


def rendered_params(params: Column | str, separator: str = ",") -> Column:
    """A map as ``name = value`` items in key order."""
    items = F.array_sort(F.map_entries(_col(params)))
    return F.array_join(
        F.transform(items, lambda e: F.concat(e["key"], F.lit(" = "), e["value"].cast("string"))), separator
    )


def recoded(c: Column | str, codes: Mapping[object, object]) -> Column:
    """Look a code up in a short fixed table; unknown codes give null."""
    c = _col(c)
    out = None
    for code, label in codes.items():
        out = F.when(c == F.lit(code), F.lit(label)) if out is None else out.when(c == F.lit(code), F.lit(label))
    return out


def flag_number(c: Column | str) -> Column:
    """Yes/no letters to 1/0."""
    return recoded(F.lower(_col(c)), {"y": 1, "n": 0})


def present_flag(c: Column | str) -> Column:
    return _col(c).isNotNull().cast("int")



# Handedness codes of a molecule record; -1 and any other code mean "not known" (null).
CHIRALITY_NAMES = {2: "achiral", 1: "single_enantiomer", 0: "mixture"}
