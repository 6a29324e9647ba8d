"""Filling fixed-capacity containers with documents.

Hashed bag-of-token vectors are projected to three dimensions, documents are
range-sorted by their Hilbert key, and each range is packed along the curve by
best fit over a bounded set of open containers.

Defined results
- sizes are token counts of a public vocabulary; null and empty texts have
  size 0 and still get a container;
- a document over the capacity is split into full pieces and a remainder;
  no other document is split;
- equal texts have equal keys; their order, and the range cut between them, is
  by id, so a group of copies that holds a third of all rows is spread;
- repeated rows are packed as often as they occur; extra columns are ignored;
- an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.tokens import VOCABULARY, encoder
from millrace.session import cut_lineage

CAPACITY = 4096
OPEN = 64
AXES, BITS, BUCKETS = 3, 10, 1024
SLICE = 256


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of integer points ``(n, axes)`` below ``2**bits``.

    The published transpose method: undo the excess work from the top bit
    down, Gray-encode, then interleave the axes' bits.
    """
    x = points.astype(np.int64).T.copy()
    axes = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(axes):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[axes - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


@lru_cache(maxsize=1)
def _projection() -> np.ndarray:
    signs = np.random.default_rng(77).integers(0, 2, (BUCKETS, AXES)) * 2 - 1
    return signs.astype(np.float64)


def document_keys(documents: list[np.ndarray]) -> np.ndarray:
    """Hilbert keys of documents' hashed token counts (damped, of unit length); 0 for one without tokens."""
    keys = np.zeros(len(documents), dtype=np.int64)
    for at in range(0, len(documents), SLICE):
        part = documents[at : at + SLICE]
        sizes = [len(x) for x in part]
        owner = np.repeat(np.arange(len(part)), sizes)
        axis = np.concatenate(part) * 2654435761 % 4294967296 % BUCKETS
        counts = np.log1p(np.bincount(owner * BUCKETS + axis, minlength=len(part) * BUCKETS).reshape(len(part), BUCKETS))
        length = np.sqrt((counts * counts).sum(axis=1))
        spots = counts @ _projection() / np.maximum(length, 1e-300)[:, None]
        grid = np.clip((spots + 2.0) / 4.0 * (1 << BITS), 0, (1 << BITS) - 1)
        keys[at : at + SLICE] = np.where(length > 0, hilbert_key(grid), 0)
    return keys


def _measure(vocabulary: str, folder: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, folder).encode_ordinary
        for batch in batches:
            texts, sizes, keys = batch.column(1), [], []
            for at in range(0, len(texts), SLICE):
                ids = [np.asarray(encode(t), dtype=np.int64) if t else np.empty(0, np.int64) for t in texts.slice(at, SLICE).to_pylist()]
                sizes += [len(x) for x in ids]
                keys.append(document_keys(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(np.concatenate(keys) if keys else [], pa.int64())], ["id", "size", "curve"]
            )

    return run


def _pack(id_type: pa.DataType, capacity: int):
    """Best fit over at most ``OPEN`` containers, whose room is kept sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 40
        room: list[tuple[int, int]] = []
        opened = 0
        for batch in batches:
            places = []
            for size in batch.column(2).to_pylist():
                if size >= capacity:
                    places.append(base + opened)
                    opened += 1
                    continue
                at = bisect_left(room, (size, -1))
                if at == len(room):
                    if len(room) == OPEN:
                        room.pop(0)
                    left, name = capacity, base + opened
                    opened += 1
                else:
                    left, name = room.pop(at)
                places.append(name)
                if left > size:
                    insort(room, (left - size, name))
            yield pa.RecordBatch.from_arrays(
                [pa.array(places, pa.int64()), batch.column(0), batch.column(1), batch.column(2)], ["container", "id", "piece", "size"]
            )

    return run


def measure_documents(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, folder: str | None = None
) -> DataFrame:
    """``(id, size, curve)``: token count and Hilbert key of each document."""
    kind = documents.schema[id_col].dataType
    return documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _measure(vocabulary, folder), f"id {kind.simpleString()}, size bigint, curve bigint"
    )


def pack_documents(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    vocabulary: str = VOCABULARY, folder: str | None = None,
) -> DataFrame:
    """``(container, id_col, piece, size)``: one row per document, more for those over the capacity.

    Texts never leave their scan task: what is shuffled is 24 bytes a document.
    The measures are written once, since the range sort reads them twice (for
    its bounds and for its rows).
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = documents.schema[id_col].dataType
    measured = cut_lineage(measure_documents(documents, id_col, text_col, vocabulary, folder))
    last = F.greatest(F.ceil(F.col("size") / capacity) - 1, F.lit(0))
    pieces = measured.select("id", "curve", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece")).select(
        "id", "piece", "curve", F.least(F.lit(capacity), F.col("size") - F.col("piece") * capacity).cast("bigint").alias("size")
    )
    ranged = pieces.repartitionByRange("curve", "id", "piece").sortWithinPartitions("curve", "id", "piece")
    return ranged.select("id", "piece", "size").mapInArrow(
        _pack(to_arrow_type(kind), capacity), f"container bigint, id {kind.simpleString()}, piece bigint, size bigint"
    ).withColumnRenamed("id", id_col)
