"""Every registered query and its SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from faultgrain.plans import analysis, core, flows, learning, retrieval

_PARTS = (core, analysis, learning, retrieval, flows)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict = {}
    for part in _PARTS:
        twice = found.keys() & part.QUERIES.keys()
        if twice:
            raise ValueError(f"queries named twice: {sorted(twice)}")
        found |= part.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
