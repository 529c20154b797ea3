"""The registered queries, by theme. Left entity = part, right entity = supplier, pair = a part bought from a supplier,
child record = order."""

from __future__ import annotations

from importlib import import_module

THEMES = ["reading", "shaping", "joining", "counting", "ordering", "labelling", "featuring", "linking", "learning"]


def load() -> None:
    for theme in THEMES:
        import_module(f"{__name__}.{theme}")
