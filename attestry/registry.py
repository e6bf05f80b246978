"""All registered queries with their equivalent DuckDB statements."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules with ``QUERIES``: name -> (function, SQL or None).
MODULES = ("dashboard", "behaviour", "identity", "assurance", "detection", "fields", "risk", "records", "streams", "ledgers", "readings", "outcomes")


def _all() -> dict[str, tuple[Query, str | None]]:
    found: dict[str, tuple[Query, str | None]] = {}
    for name in MODULES:
        for key, pair in importlib.import_module(f"attestry.plans.{name}").QUERIES.items():
            if key in found:
                raise ValueError(f"two queries named {key}")
            found[key] = pair
    return found


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
