"""Named queries over the supplied tables, each with the equivalent DuckDB SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.registry import QUERIES, SQL

FLAGSHIP = "facet_page"
MODULES = ("forecasting", "facets", "health", "changes", "texts", "reads", "streams", "documents", "paths", "lineage", "records", "scope", "evidence", "questions", "pages", "revisions", "timeline")


def _loaded() -> None:
    for m in MODULES:
        importlib.import_module(f"tidewell.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _loaded()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _loaded()
    return dict(SQL)
