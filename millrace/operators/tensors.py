"""Quantised tensors, positional tables and small matrices as DataFrame operators."""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Bytes of an element by tensor type name.
WIDTHS = {"BOOL": 1, "U8": 1, "I8": 1, "U16": 2, "I16": 2, "F16": 2, "BF16": 2, "U32": 4, "I32": 4, "F32": 4, "U64": 8, "I64": 8, "F64": 8}


def nibbles(word: Column) -> Column:
    """The eight 4-bit values of a 32-bit word, lowest first."""
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: (F.floor(word / F.pow(F.lit(16.0), j)).cast("bigint") % 16).cast("int"))


def dequantize(words: Column, scales: Column, biases: Column, group_size: int) -> Column:
    """``scale * q + bias`` of every 4-bit value, a scale and bias per ``group_size`` values."""
    values = F.flatten(F.transform(words, nibbles))
    return F.transform(values, lambda q, i: F.get(scales, F.floor(i / group_size).cast("int")) * q + F.get(biases, F.floor(i / group_size).cast("int")))


def layout_error(packed: Column, groups: Column, bits: int, group_size: int) -> Column:
    """Why ``packed`` words and ``groups`` scales a row are refused, or null: wrong bits, no group size, a count beyond 63 bits, counts that don't fit."""
    columns = F.try_multiply(packed.cast("bigint"), F.lit(8).cast("bigint"))
    covered = F.try_multiply(groups.cast("bigint"), F.lit(group_size).cast("bigint"))
    return (
        F.when(F.lit(bits) != 4, "bits").when(F.lit(group_size) == 0, "group_size")
        .when(columns.isNull() | covered.isNull(), "overflow").when(columns != covered, "columns")
    )


def bf16_finite(bits: Column) -> Column:
    """Whether a bfloat16 bit pattern is finite: not all exponent bits are set."""
    return bits.bitwiseAND(F.lit(0x7F80)) != 0x7F80


def bf16_value(bits: Column) -> Column:
    """The number of a bfloat16 bit pattern, by sign, exponent and fraction."""
    sign = F.when(bits.bitwiseAND(F.lit(0x8000)) != 0, -1.0).otherwise(1.0)
    exponent = F.shiftright(bits.bitwiseAND(F.lit(0x7F80)), 7)
    part = bits.bitwiseAND(F.lit(0x7F)) / F.lit(128.0)
    special = F.when(part == 0, sign * F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    plain = sign * F.pow(F.lit(2.0), F.greatest(exponent, F.lit(1)) - 127) * (part + F.when(exponent > 0, 1.0).otherwise(0.0))
    return F.when(exponent == 255, special).otherwise(plain)


def scale_stats(rows: DataFrame, key: str, scales: str) -> DataFrame:
    """``(key, nonfinite, zero_scales, low, high)`` over finite scales, 0 where there are none."""
    spread = rows.select(key, F.explode(scales).alias("s"))
    finite = ~F.isnan("s") & (F.abs("s") < float("inf"))
    return spread.groupBy(key).agg(
        F.count_if(~finite).alias("nonfinite"), F.count_if(F.col("s") == 0).alias("zero_scales"),
        F.coalesce(F.min(F.when(finite, F.col("s"))), F.lit(0.0)).alias("low"), F.coalesce(F.max(F.when(finite, F.col("s"))), F.lit(0.0)).alias("high"),
    )


def yarn_frequencies(half: int, theta: float, factor: float, original: int, beta_fast: float = 32.0, beta_slow: float = 1.0) -> list[float]:
    """Rotary frequencies with interpolation by wavelength: unchanged where fast, divided by ``factor`` where slow."""

    def bound(rotations: float) -> float:
        return 2 * half * math.log(original / (rotations * 2 * math.pi)) / (2 * math.log(theta))

    low, high = max(math.floor(bound(beta_fast)), 0), min(math.ceil(bound(beta_slow)), 2 * half - 1)
    out = []
    for i in range(half):
        plain = theta ** (-i / half)
        ramp = min(max((i - low) / max(high - low, 1e-3), 0.0), 1.0)
        out.append(plain * (1 - ramp) + plain / factor * ramp)
    return out


def rotate(vector: Column, position: Column, theta: float = 10000.0) -> Column:
    """Rotary embedding of a vector whose halves are the two components of each plane."""
    half = F.size(vector) / 2

    def turned(i: Column) -> Column:
        plane = F.when(i < half, i).otherwise(i - half)
        angle = position * F.pow(F.lit(theta), -plane / half)
        a, b = F.get(vector, plane.cast("int")), F.get(vector, (plane + half).cast("int"))
        return F.when(i < half, a * F.cos(angle) - b * F.sin(angle)).otherwise(a * F.sin(angle) + b * F.cos(angle))

    return F.transform(F.sequence(F.lit(0), F.size(vector) - 1), turned)


def attention_scale(position: Column, original: int, beta: float = 0.1) -> Column:
    """1 below ``original`` positions, growing with the logarithm of how often they fit."""
    return 1 + beta * F.log(1 + F.floor(position / original))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, not once an element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def layer_norm(vector: Column, eps: float = 1e-12) -> Column:
    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    def scaled(centred: Column) -> Column:
        spread = F.sqrt(total(F.transform(centred, lambda x: x * x)) / F.size(centred) + eps)
        return _let(spread, lambda d: F.transform(centred, lambda x: x / d))

    return _let(_let(total(vector) / F.size(vector), lambda m: F.transform(vector, lambda x: x - m)), scaled)


def multiply(left: DataFrame, right: DataFrame, parts: int | None = None) -> DataFrame:
    """Product of matrices in long form ``(i, k, v)`` and ``(k, j, v)``: ``(i, j, v)`` of the pairs that share an index.

    Only entries that meet are multiplied, and their products are summed on the
    map side, so no task holds rows times columns, however many there are. An
    index with very many entries is split by AQE; ``parts`` fixes the number of
    pieces that the shared index is cut into.
    """
    a = left.select(F.col("i").cast("bigint").alias("i"), F.col("k").cast("bigint").alias("k"), F.col("v").cast("double").alias("x"))
    b = right.select(F.col("k").cast("bigint").alias("k"), F.col("j").cast("bigint").alias("j"), F.col("v").cast("double").alias("y"))
    if parts:
        a, b = a.repartition(parts, "k"), b.repartition(parts, "k")
    return a.join(b, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def gram(rows: DataFrame, vec: str) -> DataFrame:
    """``(i, j, v)``: the products of all pairs of components, summed over the vectors.

    Every partition of the scan sums its own small matrix; no vector is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            column = batch.column(0)
            if len(column):
                x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            n = len(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(n), n)), pa.array(np.tile(np.arange(n), n)), pa.array(total.ravel())], ["i", "j", "v"])

    return rows.where(F.col(vec).isNotNull()).select(vec).mapInArrow(run, "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def mean_vectors(rows: DataFrame, key: str, vec: str) -> DataFrame:
    """``(key, axis, mean)``: component means of the vectors of each key."""
    return rows.select(key, F.posexplode(vec).alias("axis", "x")).groupBy(key, "axis").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def parse_header(raw: bytes, size: int) -> list[tuple]:
    """Tensors of a safetensors header: ``(name, dtype, shape, start, end, error)``, one row with an error if it is malformed."""

    def bad(why: str) -> list[tuple]:
        return [("", "", [], 0, 0, why)]

    if size < 8 or len(raw) < 8:
        return bad("short")
    (length,) = struct.unpack("<Q", raw[:8])
    if length > size - 8 or length > len(raw) - 8:
        return bad("header_length")
    try:
        header = json.loads(raw[8 : 8 + length].decode("utf-8"))
    except (UnicodeDecodeError, ValueError):
        return bad("json")
    if not isinstance(header, dict):
        return bad("json")
    body, out = size - 8 - length, []
    for name in sorted(header):
        if name == "__metadata__":
            continue
        entry = header[name]
        error = None
        dtype, shape, spots = "", [], [0, 0]
        if not isinstance(entry, dict) or not {"dtype", "shape", "data_offsets"} <= entry.keys():
            error = "entry"
        else:
            dtype, shape, spots = entry["dtype"], entry["shape"], entry["data_offsets"]
            if dtype not in WIDTHS:
                error = "dtype"
            elif not isinstance(shape, list) or len(shape) > 16 or any(not isinstance(x, int) or x < 0 for x in shape):
                error = "shape"
            elif not isinstance(spots, list) or len(spots) != 2 or any(not isinstance(x, int) for x in spots) or not 0 <= spots[0] <= spots[1] <= body:
                error = "offsets"
            elif math.prod(shape) >= 1 << 63 or math.prod(shape) * WIDTHS[dtype] != spots[1] - spots[0]:
                error = "size"
        whole = error is None
        out.append((name, str(dtype), [int(x) for x in shape] if whole else [], spots[0] if whole else 0, spots[1] if whole else 0, error))
    return out


TENSOR_SCHEMA = "path string, name string, dtype string, shape array<bigint>, start bigint, end bigint, error string"


def tensor_catalog(files: DataFrame) -> DataFrame:
    """Tensors of files ``(path, content)`` as ``binaryFile`` reads them; a name in several files counts in the first by path."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(path, *row) for path, raw in zip(frame["path"], frame["content"]) for row in parse_header(raw, len(raw))]
            yield pd.DataFrame(rows, columns=["path", "name", "dtype", "shape", "start", "end", "error"])

    return files.select("path", "content").mapInPandas(run, TENSOR_SCHEMA)


def first_shard(catalog: DataFrame) -> DataFrame:
    rest = [c for c in catalog.columns if c not in ("name", "path")]
    return catalog.where(F.col("error").isNull()).groupBy("name").agg(F.min(F.struct("path", *rest)).alias("x")).select("name", "x.*")


def weight_bytes(catalog: DataFrame, prefix: str) -> DataFrame:
    """``(bytes, tensors)``: what the tensors take whose names start with ``prefix``."""
    mine = catalog.where(F.col("name").startswith(prefix))
    return mine.agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("bytes"), F.count("*").alias("tensors"))


# How little-endian elements of each type are read; bfloat16 is the upper half of a 32-bit float.
_READ = {"BOOL": "?", "U8": "u1", "I8": "i1", "U16": "<u2", "I16": "<i2", "F16": "<f2", "BF16": "<u2", "U32": "<u4", "I32": "<i4", "F32": "<f4", "U64": "<u8", "I64": "<i8", "F64": "<f8"}


def tensor_values(raw: bytes, dtype: str) -> np.ndarray:
    data = np.frombuffer(raw, dtype=_READ[dtype])
    if dtype == "BF16":
        data = (data.astype(np.uint32) << 16).view(np.float32)
    return data.astype(np.float64)


def read_tensors(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(name, path, shape, values, error)`` of each tensor in ``wanted (name, dtype, shape)`` from files ``(path, content)``.

    A null ``dtype`` or ``shape`` is not checked. Errors are missing, dtype and
    shape, in this order; of several files with a name the first by path counts.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                error, values = None, None
                if r.start is None or r.start != r.start:
                    error = "missing"
                elif r.dtype is not None and r.dtype != r.found:
                    error = "dtype"
                elif r.shape is not None and list(r.shape) != list(r.held):
                    error = "shape"
                else:
                    base = 8 + struct.unpack("<Q", r.content[:8])[0]
                    values = tensor_values(r.content[base + int(r.start) : base + int(r.end)], r.found)
                out.append((r.name, r.path, None if r.held is None else list(r.held), values, error))
            yield pd.DataFrame(out, columns=["name", "path", "shape", "values", "error"])

    known = first_shard(tensor_catalog(files)).select("name", "path", F.col("dtype").alias("found"), F.col("shape").alias("held"), "start", "end")
    rows = wanted.select("name", "dtype", "shape").join(known, "name", "left").join(files.select("path", "content"), "path", "left")
    return rows.select("name", "dtype", "shape", "path", "found", "held", "start", "end", "content").mapInPandas(run, "name string, path string, shape array<bigint>, values array<double>, error string")
