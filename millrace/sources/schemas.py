"""Versions of stored tables: steps that lead from one to the next, and a file that names the version of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Step = Callable[[DataFrame], DataFrame]
VERSION_FILE = "_version"


def migrate(table: DataFrame, version: int, steps: list[Step]) -> DataFrame:
    """``table`` of ``version`` after the steps it lacks, in order; step ``n`` leads from version ``n`` to ``n + 1``.

    A version that this build doesn't know is refused.
    """
    if not 0 <= version <= len(steps):
        raise ValueError(f"version {version} is not supported (known are up to {len(steps)})")
    for step in steps[version:]:
        table = step(table)
    return table


def write_versioned(table: DataFrame, folder: str, version: int) -> None:
    table.write.mode("overwrite").parquet(f"{folder}/data")
    table.sparkSession.createDataFrame([(str(version),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{VERSION_FILE}")


def read_versioned(spark: SparkSession, folder: str, steps: list[Step]) -> DataFrame:
    """The table of a folder, brought to the newest version."""
    version = int(spark.read.text(f"{folder}/{VERSION_FILE}").first()[0])
    return migrate(spark.read.parquet(f"{folder}/data"), version, steps)
