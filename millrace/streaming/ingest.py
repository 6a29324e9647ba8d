"""Structured Streaming forms: chunks as files arrive, windowed event counts, deltas by arrival."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.chunking import chunk_files


def stream_chunks(files: DataFrame, key: str, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Chunk each micro-batch of a stream ``(key, path, text)`` and hand the rows to ``write`` once a batch id.

    Chunking keeps no state; a repeated batch gives the same digests, so a
    writer that replaces the batch's partition is exactly-once.
    """
    return files.writeStream.foreachBatch(lambda batch, number: write(chunk_files(batch, key), number)).option("checkpointLocation", checkpoint).start()


def windowed_counts(events: DataFrame, time: str, key: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """``(window_start, key, n, total)`` of a stream of ``value`` events, state bounded by the watermark."""
    grouped = events.withWatermark(time, late).groupBy(F.window(time, width), key)
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), key, "n", "total")


DELTA_OUT = "stream_id string, text string, n int"
DELTA_STATE = "since bigint, text string, n int"


def stream_deltas(deltas: DataFrame, gap_ms: int = 40, quiet_ms: int = 60_000) -> DataFrame:
    """Deltas ``(stream_id, at_ms, piece)`` joined until ``gap_ms`` have passed since a stream's last flush.

    The state of a stream is its unflushed text; after ``quiet_ms`` without
    news it is flushed and dropped.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, text, n = state.get if state.exists else (None, "", 0)
        out = []
        if state.hasTimedOut:
            state.remove()
            if n:
                yield pd.DataFrame({"stream_id": [key[0]], "text": [text], "n": [n]})
            return
        rows = sorted((at, piece) for frame in frames for at, piece in zip(frame["at_ms"], frame["piece"]))
        for at, piece in rows:
            text, n = text + piece, n + 1
            if since is None:
                since = at
            elif at - since >= gap_ms:
                out.append((key[0], text, n))
                since, text, n = at, "", 0
        state.update((int(since), text, n))
        state.setTimeoutDuration(quiet_ms)
        yield pd.DataFrame(out, columns=["stream_id", "text", "n"])

    return deltas.groupBy("stream_id").applyInPandasWithState(step, DELTA_OUT, DELTA_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
