"""All queries of this subpackage by name."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import quillspan.plans as here

Query = Callable[[SparkSession, str], DataFrame]


def _plans() -> dict[str, tuple[Query, str | None]]:
    out: dict[str, tuple[Query, str | None]] = {}
    for module in pkgutil.iter_modules(here.__path__):
        if module.name.endswith("_plans"):
            out |= importlib.import_module(f"quillspan.plans.{module.name}").PLANS
    return out


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _plans().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _plans().items() if sql}
