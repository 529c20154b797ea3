"""Staged table builds: each stage reads stored tables, writes its own, and is reused on the next run."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import load_table, materialize


@dataclass(frozen=True)
class Stage:
    """A named table, the tables it is made from, and how."""

    name: str
    inputs: Sequence[str]
    build: Callable[..., DataFrame]


def run_stages(
    spark: SparkSession, folder: str, stages: Sequence[Stage], only: str | None = None, force: bool = False,
    given: Mapping[str, DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """Run all stages in order, or just ``only`` one from what is stored. ``force`` rebuilds what exists."""
    known: dict[str, DataFrame] = dict(given or {})

    def table(name: str) -> DataFrame:
        if name not in known:
            stored = load_table(spark, folder, name)
            if stored is None:
                raise LookupError(f"table {name!r} has not been built")
            known[name] = stored
        return known[name]

    for stage in stages:
        if only is None or stage.name == only:
            build = lambda s=stage: s.build(*[table(i) for i in s.inputs])
            known[stage.name] = materialize(spark, folder, stage.name, build, force)
    return known
