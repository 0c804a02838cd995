"""Operators for training-data pipelines. Nothing else in the library imports this subpackage.

The modules are imported when their queries are asked for, so that a Python worker loads those of its operator alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import entry

    return entry.queries()


def oracle_sql() -> dict[str, str]:
    from . import entry

    return entry.oracle_sql()
