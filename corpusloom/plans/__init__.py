"""Registered queries, one module per group, each with QUERIES and SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("hotkeys", "texts", "cleaning", "measures", "relations", "signals", "streams")


def _merged(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        for key, value in getattr(import_module(f"{__name__}.{name}"), what).items():
            if key in out:
                raise ValueError(f"two queries are named {key}")
            out[key] = value
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("SQL")
