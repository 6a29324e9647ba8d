"""Two projection heads trained by a symmetric contrastive loss, and their evaluation."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F


def contrastive_loss(pairs: DataFrame, temperature: float) -> DataFrame:
    """``(loss)``: mean of both directions' cross entropy over ``(i, j, sim)``, where ``i = j`` are the true pairs.

    A ``j`` without an equal ``i`` is a hard negative: every ``i`` is told from
    it, and it has no direction of its own.
    """
    logits = pairs.withColumn("z", F.col("sim") / temperature)
    by_row, by_col = Window.partitionBy("i"), Window.partitionBy("j")
    rows = logits.withColumn("row_top", F.max("z").over(by_row)).withColumn("row_sum", F.sum(F.exp(F.col("z") - F.col("row_top"))).over(by_row))
    rows = rows.withColumn("col_top", F.max("z").over(by_col)).withColumn("col_sum", F.sum(F.exp(F.col("z") - F.col("col_top"))).over(by_col))
    own = rows.where(F.col("i") == F.col("j"))
    one = F.log("row_sum") + F.col("row_top") - F.col("z")
    two = F.log("col_sum") + F.col("col_top") - F.col("z")
    return own.agg((F.avg((one + two) / 2)).alias("loss"))


def _log_softmax(z: np.ndarray, axis: int) -> np.ndarray:
    z = z - z.max(axis=axis, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=axis, keepdims=True))


def loss_and_gradients(state: np.ndarray, action: np.ndarray, states: np.ndarray, actions: np.ndarray, temperature: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss of heads ``state`` and ``action`` (d, p) over a batch, and its gradients by either.

    The first rows of ``actions`` belong to the rows of ``states``; more of them
    are negatives that the whole batch shares. Logits are plain products of the
    projections over the temperature.
    """
    n = len(states)
    s, a = states @ state, actions @ action
    z = s @ a.T / temperature
    forth, back = _log_softmax(z, 1), _log_softmax(z[:, :n], 0)
    own = np.arange(n)
    loss = -(forth[own, own].sum() + back[own, own].sum()) / (2 * n)
    pull = np.exp(forth)
    pull[:, :n] += np.exp(back)
    pull[own, own] -= 2.0
    pull /= 2 * n * temperature
    return float(loss), states.T @ (pull @ a), actions.T @ (pull.T @ s)


def normal_numbers(seed: int, count: int) -> np.ndarray:
    """Normal numbers by Box and Muller from a 64-bit xorshift generator (shifts 13, 7, 17) with an odd start, in single precision."""
    mask, x, out = (1 << 64) - 1, seed | 1, []
    for _ in range(2 * count):
        x ^= x << 13 & mask
        x ^= x >> 7
        x ^= x << 17 & mask
        out.append(x >> 11)
    uniform = np.array(out, dtype=np.uint64).astype(np.float32) / np.float32(2.0**53)
    one, two = uniform[::2] + np.float32(1e-7), uniform[1::2]
    return np.sqrt(np.float32(-2.0) * np.log(one)) * np.cos(np.float32(2 * np.pi) * two)


@dataclass
class Head:
    """Projections of states and of actions into one space of comparison."""

    state: np.ndarray
    action: np.ndarray
    temperature: float

    @classmethod
    def start(cls, dim: int, width: int, temperature: float, seed: int) -> Head:
        numbers = normal_numbers(seed, 2 * dim * width).astype(np.float64) * np.sqrt(1.0 / dim)
        return cls(numbers[: dim * width].reshape(dim, width), numbers[dim * width :].reshape(dim, width), temperature)

    def step(self, states: np.ndarray, actions: np.ndarray, rate: float) -> float:
        """One step of gradient descent over a whole batch; the loss before it."""
        loss, by_state, by_action = loss_and_gradients(self.state, self.action, states, actions, self.temperature)
        self.state -= rate * by_state
        self.action -= rate * by_action
        return loss

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as out:
            json.dump({"temperature": self.temperature, "state": self.state.tolist(), "action": self.action.tolist()}, out)

    @classmethod
    def load(cls, path: str) -> Head:
        with open(path, encoding="utf-8") as source:
            held = json.load(source)
        return cls(np.array(held["state"]), np.array(held["action"]), held["temperature"])


def fit_head(states: np.ndarray, actions: np.ndarray, width: int, steps: int = 300, rate: float = 0.05, temperature: float = 0.1, seed: int = 42) -> tuple[Head, list[float]]:
    """A head by plain gradient descent; a model of fixed size from one bounded batch."""
    head = Head.start(states.shape[1], width, temperature, seed)
    return head, [head.step(states, actions, rate) for _ in range(steps)]


def project(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """``(id, vec)`` with vectors sent through a head ``(d, p)`` and set to unit length; a zero vector stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), weights.shape[0]) @ weights
            size = np.sqrt((x * x).sum(axis=1, keepdims=True))
            x = np.where(size > 0, x / np.where(size > 0, size, 1.0), x)
            offsets = pa.array(np.arange(0, x.size + 1, weights.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], ["id", "vec"])

    return rows.where(F.size("vec") == weights.shape[0]).select(F.col("id").cast("bigint").alias("id"), "vec").mapInArrow(run, "id bigint, vec array<double>")


def accuracy(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """``(accuracy, n)`` of first-ranked ``(query_id, label)`` against ``(query_id, label)``."""
    both = ranked.where(F.col("rank") == 1).select("query_id", F.col("label").alias("said")).join(truth, "query_id")
    return both.agg(F.avg((F.col("said") == F.col("label")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def routing_accuracy(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """``(accuracy, n)`` of the best ``(query_id, idx, score)``, the last ``idx`` of equal scores, against ``(query_id, idx)``."""
    picked = scores.groupBy("query_id").agg(F.max(F.struct("score", "idx")).alias("x")).select("query_id", F.col("x.idx").alias("said"))
    both = picked.join(truth, "query_id")
    return both.agg(F.avg((F.col("said") == F.col("idx")).cast("double")).alias("accuracy"), F.count("*").alias("n"))
