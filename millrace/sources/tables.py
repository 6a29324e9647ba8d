"""Parquet tables of a dataset directory."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Table ``name`` of the dataset under ``root``; pushdown and pruning are left to the scan."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def table_exists(root: str, name: str) -> bool:
    return os.path.exists(f"{root}/{name}.parquet")
