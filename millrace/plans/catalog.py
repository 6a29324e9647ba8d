"""All named queries of the core and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import formats, numeric, records, retrieval, texts, upkeep

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (texts, retrieval, upkeep, records, numeric, formats)


def queries() -> dict[str, Query]:
    return {f.__name__: f for module in MODULES for f in module.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
