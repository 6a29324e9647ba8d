"""Functions over id arrays as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from millrace.operators.prompting import FIRST_TEXT_ID


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    n = F.least(F.size(a), F.size(b))
    unlike = F.array_position(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(F.coalesce(unlike, F.lit(0)) > 0, unlike - 1).otherwise(n).cast("int")


def prefix_reuse(cached: Column, prompt: Column, chunk: int) -> Column:
    """``(reused, fed, chunks)`` of a prompt after a cached sequence: what is equal is kept, but at least one id is fed, ``chunk`` at a time."""
    same = common_prefix(cached, prompt)
    reused = F.when(same == F.size(prompt), F.greatest(same - 1, F.lit(0))).otherwise(same)
    fed = F.size(prompt) - reused
    return F.struct(reused.cast("int").alias("reused"), fed.cast("int").alias("fed"), F.ceil(fed / max(chunk, 1)).cast("int").alias("chunks"))


def is_control(token: Column) -> Column:
    return token < FIRST_TEXT_ID


def control_count(ids: Column) -> Column:
    """How many ids of an array are control ids."""
    return F.size(F.filter(ids, is_control))
