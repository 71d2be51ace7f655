"""Named queries over the test tables, each with its SQL check where SQL can express it."""

from __future__ import annotations

from importlib import import_module

from tarnkit.plans.registry import CHECKS, QUERIES, Query

_MODULES = ("preparation", "censored", "statistics", "prediction", "curves", "learning")


def all_queries() -> dict[str, Query]:
    for module in _MODULES:
        import_module(f"tarnkit.plans.{module}")
    return dict(QUERIES)


def all_checks() -> dict[str, str]:
    all_queries()
    return dict(CHECKS)
