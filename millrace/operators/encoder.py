"""The blocks of a bidirectional text encoder over sequences of vectors, in double precision.

A sequence is one row; sequences are independent, and a batch of them is one
Arrow batch. Weights are of fixed size and go to every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def layer_norm(x: np.ndarray, scale: np.ndarray, shift: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    centred = x - x.mean(axis=-1, keepdims=True)
    return centred / np.sqrt((centred * centred).mean(axis=-1, keepdims=True) + eps) * scale + shift


def rotate(x: np.ndarray, base: float = 10000.0) -> np.ndarray:
    """Vectors ``(place, head, width)`` turned by their place; the halves of a vector are the components of its planes."""
    half = x.shape[-1] // 2
    angle = np.arange(len(x))[:, None] * base ** (-np.arange(half) / half)
    sin, cos = np.sin(angle)[:, None, :], np.cos(angle)[:, None, :]
    a, b = x[..., :half], x[..., half:]
    return np.concatenate([a * cos - b * sin, a * sin + b * cos], axis=-1)


def attention(q: np.ndarray, k: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Softmax attention of every place over all, head by head: ``(place, head, width)``."""
    scores = np.einsum("ihd,jhd->hij", q, k) / np.sqrt(q.shape[-1])
    scores = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return np.einsum("hij,jhd->ihd", scores / scores.sum(axis=-1, keepdims=True), v)


def gated(x: np.ndarray, value: np.ndarray, gate: np.ndarray, out: np.ndarray) -> np.ndarray:
    """A feed-forward step whose values are gated by a sigmoid-weighted unit; weights are ``(outputs, inputs)``."""
    g = x @ gate.T
    return ((x @ value.T) * (g / (1.0 + np.exp(-g)))) @ out.T


@dataclass(frozen=True)
class Layer:
    qkv: np.ndarray
    mix: np.ndarray
    norm_one: tuple[np.ndarray, np.ndarray]
    value: np.ndarray
    gate: np.ndarray
    out: np.ndarray
    norm_two: tuple[np.ndarray, np.ndarray]

    def run(self, x: np.ndarray, heads: int) -> np.ndarray:
        n, width = x.shape
        q, k, v = ((x @ part.T).reshape(n, heads, width // heads) for part in np.split(self.qkv, 3))
        mixed = attention(rotate(q), rotate(k), v).reshape(n, width) @ self.mix.T
        x = layer_norm(x + mixed, *self.norm_one)
        return layer_norm(x + gated(x, self.value, self.gate, self.out), *self.norm_two)


def pooled(x: np.ndarray) -> np.ndarray:
    """The mean of a sequence at unit length; a zero mean stays."""
    mean = x.mean(axis=0)
    size = np.sqrt((mean * mean).sum())
    return mean / size if size > 0 else mean


def encode_sequences(rows: DataFrame, layers: list[Layer], heads: int, start: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``(id, vec)`` of sequences ``(id, vectors array<array<double>>)``: normed, sent through the layers, pooled. Empty ones give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for vectors in batch.column(1).to_pylist():
                x = layer_norm(np.array(vectors, dtype=np.float64), *start)
                for layer in layers:
                    x = layer.run(x, heads)
                made.append(pooled(x).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.float64()))], ["id", "vec"])

    known = rows.where(F.size("vectors") > 0).select(F.col("id").cast("bigint").alias("id"), F.col("vectors").cast("array<array<double>>").alias("vectors"))
    return known.mapInArrow(run, "id bigint, vec array<double>")
