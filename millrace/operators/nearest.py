"""Exact and staged nearest-neighbour search over ``(id, vec)`` tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from millrace.functions import vectors as V

QUERY_BLOCK, ROW_BLOCK = 4096, 65536
NAMES = ["query_id", "id", "score"]
FOUND = "query_id bigint, id bigint, score double"
Search = Callable[[np.ndarray, np.ndarray, np.ndarray, int, int], tuple[np.ndarray, np.ndarray]]


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _ranked(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(query, place)`` arrays of the best ``k`` ids and scores of each row, ties by smaller id.

    Only what reaches the row's k-th score is sorted.
    """
    if scores.shape[1] > 4 * k:
        # Whatever equals the k-th score stays, so that ties go by id.
        last = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        width = int((scores >= last[:, None]).sum(axis=1).max())
        near = np.argpartition(-scores, min(width, scores.shape[1] - 1), axis=1)[:, :width]
        ids, scores = np.broadcast_to(ids, scores.shape), np.take_along_axis(scores, near, axis=1)
        ids = np.take_along_axis(ids, near, axis=1)
    ids = np.broadcast_to(ids, scores.shape)
    order = np.lexsort((ids, -scores), axis=-1)[:, :k]
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(scores, order, axis=1)


def exact_search(queries: np.ndarray, ids: np.ndarray, points: np.ndarray, k: int, decimals: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the best ``k`` rows of each query by dot product; places that no row fills have the score -inf."""
    out_i, out_s = [], []
    for at in range(0, len(queries), 256):
        scores = np.round(queries[at : at + 256] @ points.T, decimals)
        scores[np.isnan(scores)] = -np.inf
        i, s = _ranked(ids, scores, k)
        out_i.append(i)
        out_s.append(s)
    return np.concatenate(out_i), np.concatenate(out_s)


def hamming_search(queries: np.ndarray, ids: np.ndarray, points: np.ndarray, k: int, decimals: int) -> tuple[np.ndarray, np.ndarray]:
    """The same by Hamming distance of sign bits, packed 64 to a word; the score is minus the distance."""

    def packed(x: np.ndarray) -> np.ndarray:
        bits = np.packbits(x > 0, axis=1)
        return np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.uint64)

    mine, theirs = packed(queries), packed(points)
    out_i, out_s = [], []
    for at in range(0, len(mine), 256):
        far = sum(np.bitwise_count(mine[at : at + 256, None, w] ^ theirs[None, :, w]).astype(np.int32) for w in range(mine.shape[1]))
        i, s = _ranked(ids, -far.astype(np.float64), k)
        out_i.append(i)
        out_s.append(s)
    return np.concatenate(out_i), np.concatenate(out_s)


def staged_search(queries: np.ndarray, ids: np.ndarray, points: np.ndarray, k: int, decimals: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``exact_search``, by stages that drop a row only where a bound proves that it is not among the best.

    Components of unequal signs add nothing to a dot product, so a row's is at
    most its length times that of the query's components of equal sign. The
    8-bit product is off by no more than the lengths of what rounding took.
    """
    slack = 2 * 10.0**-decimals
    lengths = np.linalg.norm(points, axis=1)
    codes = np.round(points * 127) / 127
    lost, coded = np.linalg.norm(points - codes, axis=1), np.linalg.norm(codes, axis=1)
    bits, few = (points > 0).astype(np.float32), min(k, len(ids))
    out_i, out_s = np.zeros((len(queries), few), np.int64), np.full((len(queries), few), -np.inf)
    square = queries * queries
    signs = np.where(queries > 0, square, -square).astype(np.float32)
    base = np.where(queries <= 0, square, 0).sum(axis=1)
    for at in range(0, len(queries), 256):
        # The sketch's bound of every row, a little above what single precision may lose.
        most = np.sqrt(np.maximum(signs[at : at + 256] @ bits.T + base[at : at + 256, None] + 1e-5, 0)) * lengths
        for j, q in enumerate(queries[at : at + 256]):
            left = np.arange(len(ids))
            if len(ids) > k:
                first = np.argpartition(-most[j], k - 1)[:k]
                floor = (points[first] @ q).min() - slack
                left = np.flatnonzero(most[j] >= floor)
                code = np.round(q * 127) / 127
                rough = codes[left] @ code
                error = lost[left] * np.linalg.norm(q) + coded[left] * np.linalg.norm(q - code)
                if len(left) > k:
                    floor = max(floor, np.partition(rough - error, len(left) - k)[len(left) - k] - slack)
                left = left[rough + error >= floor]
            i, s = _ranked(ids[left], np.round(points[left] @ q, decimals)[None, :], k)
            out_i[at + j, : i.shape[1]], out_s[at + j, : s.shape[1]] = i[0], s[0]
    return out_i, out_s


def _merged(names: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]], k: int) -> pa.Table:
    ids, scores = _ranked(np.concatenate([p[0] for p in parts], axis=1), np.concatenate([p[1] for p in parts], axis=1), k)
    real = np.isfinite(scores)
    return pa.table([pa.array(np.repeat(names, real.sum(axis=1)), pa.int64()), pa.array(ids[real], pa.int64()), pa.array(scores[real], pa.float64())], NAMES)


def _over_scan(names: np.ndarray, queries: np.ndarray, k: int, decimals: int, search: Search) -> Callable:
    """The best of a partition for a block of queries that every task holds: rows are met batch by batch and never shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not len(batch):
                continue
            best.append(search(queries, batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1)), k, decimals))
            if len(best) == 8:
                joined = [np.concatenate([p[i] for p in best], axis=1) for i in (0, 1)]
                best = [_ranked(joined[0], joined[1], k)]
        if best:
            yield from _merged(names, best, k).to_batches()

    return run


def _over_block(k: int, decimals: int, search: Search) -> Callable:
    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(asked) or not len(rows):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], NAMES)
        found = search(_matrix(asked["vec"]), rows["id"].to_numpy(), _matrix(rows["vec"]), k, decimals)
        return _merged(asked["query_id"].to_numpy(), [found], k)

    return run


def _numbers(count: int):
    return F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint"))


def top_k(rows: DataFrame, queries: DataFrame, k: int, decimals: int = 6, search: Search = exact_search, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, id, score, rank)``: exact best ``k`` by dot product, ties by smaller id, NaN never.

    Up to ``query_block`` queries are held by every task, which meets its rows
    where they are scanned. More queries and the rows meet in blocks of bounded
    size, a blocked matrix product each; there is no cross join of tables.
    Non-finite rows are never found, and non-finite queries find nothing.
    """
    if k <= 0:
        return queries.select("query_id").where(F.lit(False)).selectExpr("query_id", "0L as id", "0D as score", "0 as rank")
    held = rows.where(F.col("vec").isNotNull() & V.all_finite(F.col("vec"))).select(F.col("id").cast("bigint").alias("id"), "vec")
    asked = queries.where(F.col("vec").isNotNull() & V.all_finite(F.col("vec"))).select(F.col("query_id").cast("bigint").alias("query_id"), "vec")
    few = asked.limit(query_block + 1).toArrow()
    if len(few) <= query_block:
        names, points = few["query_id"].to_numpy(), _matrix(few["vec"]) if len(few) else np.empty((0, 1))
        held = held.where(F.size("vec") == points.shape[1])
        part = held.mapInArrow(_over_scan(names, points, k, decimals, search), FOUND) if len(few) else asked.selectExpr("query_id", "0L as id", "0D as score").where(F.lit(False))
    else:
        row_blocks, query_blocks = max(1, -(-held.count() // ROW_BLOCK)), max(1, -(-asked.count() // query_block))
        held = held.withColumn("rb", F.pmod(F.xxhash64("id"), F.lit(row_blocks))).withColumn("qb", F.explode(_numbers(query_blocks)))
        asked = asked.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks))).withColumn("rb", F.explode(_numbers(row_blocks)))
        part = asked.groupBy("rb", "qb").cogroup(held.groupBy("rb", "qb")).applyInArrow(_over_block(k, decimals, search), FOUND)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return part.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def top_k_single(rows: DataFrame, vector: list[float], k: int, decimals: int = 6) -> DataFrame:
    """The same for one given vector: a projection and a bounded sort, no Python."""
    literal = F.array(*(F.lit(float(x)) for x in vector))
    scored = rows.where(F.col("vec").isNotNull()).select("id", F.round(V.dot(F.col("vec"), literal), decimals).alias("score"))
    return scored.where(~F.isnan("score")).orderBy(F.col("score").desc(), "id").limit(max(k, 0))


def sketches(rows: DataFrame) -> DataFrame:
    """``(id, low, high)``: sign bits of the first 64 components, in two halves."""
    return rows.select("id", V.sign_bits(F.col("vec"), 0, 32).alias("low"), V.sign_bits(F.col("vec"), 32, 32).alias("high"))


def hamming_top(rows: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """``(query_id, id, distance, rank)`` by Hamming distance of packed sign bits."""
    found = top_k(rows, queries, limit, search=hamming_search)
    return found.select("query_id", "id", (-F.col("score")).cast("bigint").alias("distance"), "rank")


def cascade(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, id, score, rank)``: sign sketch, 8-bit product, exact score.

    A stage drops a row only where its bound proves that it is not among the
    best, so the result is that of ``top_k`` at every size of the table.
    """
    return top_k(rows, queries, k, search=staged_search)


def recall(found: DataFrame, exact: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """``(query_id, recall)``: share of exact neighbours that were found; as good as the last one counts."""
    last = exact.groupBy("query_id").agg(F.min("score").alias("last"), F.count("*").alias("wanted"))
    hits = found.join(last, "query_id").where(F.col("score") >= F.col("last") - tolerance).groupBy("query_id").agg(F.count("*").alias("hits"))
    return last.join(hits, "query_id", "left").select("query_id", F.least(F.coalesce(F.col("hits") / F.col("wanted"), F.lit(0.0)), F.lit(1.0)).alias("recall"))


def gate(ranked: DataFrame, min_margin: float) -> DataFrame:
    """``(query_id, picked, margin)``: the best row if it leads the second by ``min_margin``, or stands alone."""
    two = ranked.where(F.col("rank") <= 2).groupBy("query_id").agg(
        F.min_by("id", "rank").alias("first"), F.max("score").alias("best"), F.when(F.count("*") > 1, F.min("score")).alias("second")
    )
    margin = F.round(F.col("best") - F.col("second"), 6)
    return two.select("query_id", F.when(margin.isNull() | (margin >= min_margin), F.col("first")).alias("picked"), margin.alias("margin"))
