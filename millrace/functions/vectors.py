"""Vector functions as Catalyst expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """The vector at unit length; a zero vector unchanged."""
    size = norm(a)
    return F.when(size == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / size))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def all_finite(a: Column) -> Column:
    return F.forall(a, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))


def sign_bits(a: Column, start: int, count: int) -> Column:
    """Bits of ``count`` components from ``start`` (0-based), set where positive, the first one lowest."""
    part = F.slice(a, start + 1, count)
    return F.aggregate(
        F.transform(part, lambda x, i: F.when(x > 0, F.shiftleft(F.lit(1).cast("bigint"), 0) * F.pow(F.lit(2.0), i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))),
        F.lit(0).cast("bigint"),
        lambda s, v: s + v,
    )


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def int8(a: Column) -> Column:
    """Components scaled to -127..127."""
    return F.transform(a, lambda x: F.round(x.cast("double") * 127).cast("bigint"))


def int8_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("bigint"), lambda s, v: s + v)
