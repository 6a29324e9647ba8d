"""Hashes as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# FNV-1a, 64 bits. The prime is 2**40 + 435.
FNV_OFFSET, FNV_LOW = 14695981039346656037, 435
_HALF = 2**32


def fnv1a64_halves(text: Column) -> Column:
    """``(high, low)``: FNV-1a of the text's UTF-8 bytes as two 32-bit halves.

    A 64-bit product overflows a bigint, and ANSI mode refuses that; on halves
    no step does, since the prime is a shift by 40 plus a small factor.
    """
    hexed = F.hex(F.encode(text, "UTF-8"))
    spots = F.when(F.length(hexed) > 0, F.sequence(F.lit(1), F.length(hexed), F.lit(2))).otherwise(F.array().cast("array<int>"))
    codes = F.transform(spots, lambda at: F.conv(F.substr(hexed, at, F.lit(2)), 16, 10).cast("bigint"))
    start = F.struct(F.lit(FNV_OFFSET // _HALF).alias("high"), F.lit(FNV_OFFSET % _HALF).alias("low"))

    def step(h: Column, byte: Column) -> Column:
        low = h["low"].bitwiseXOR(byte)
        product = low * FNV_LOW
        high = h["high"] * FNV_LOW + F.shiftright(product, 32) + low * 256
        mask = F.lit(_HALF - 1)
        return F.struct(high.bitwiseAND(mask).alias("high"), product.bitwiseAND(mask).alias("low"))

    return F.when(text.isNotNull(), F.aggregate(codes, start, step))


def fnv1a64(text: Column) -> Column:
    """FNV-1a of the text's UTF-8 bytes as an unsigned DECIMAL(20,0)."""
    h = fnv1a64_halves(text)
    return (h["high"].cast("decimal(20,0)") * F.lit(str(_HALF)).cast("decimal(10,0)") + h["low"]).cast("decimal(20,0)")


def set_hash(values: Column) -> tuple[Column, Column]:
    """Order-free hash of a set of texts as an aggregate: XOR of FNV-1a, as its high and low 32 bits."""
    h = fnv1a64_halves(values)
    return F.bit_xor(h["high"]), F.bit_xor(h["low"])
