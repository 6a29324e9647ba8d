"""Splitting oversized texts at natural boundaries.

Lexical cohesion: the similarity of the word blocks before and after each line
break forms valleys where the topic changes. Every piece ends at the deepest
valley within the window that the limit leaves, and the next piece starts a set
number of lines earlier. A line that is over the limit by itself is cut inside,
after the last separator that fits.

Defined results
- lines end at LF or CRLF; a final line break counts neither as a byte nor as a line;
- null, empty and short texts are under the limit and give no pieces;
- repeated rows of one id come out once, different texts of one id each by
  itself; extra columns are ignored;
- equal valleys: a blank line wins, then the later one;
- pieces of one text cover every character, in order.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

MAX_LINES, MAX_BYTES, OVERLAP = 60, 2400, 4
BLOCK_LINES, AXES = 6, 128
LEAST_FILL = 0.5
SLICE = 4096
WORD = re.compile(r"[^\W\d_]{2,}")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
INSIDE_OVERLAP = 64


@lru_cache(maxsize=200_000)
def _axis(word: str) -> int:
    return zlib.crc32(word.encode()) % AXES


def _gap_similarity(lines: list[str]) -> np.ndarray:
    """Cosine between the word counts of the blocks before and after each gap, the first gap being before the second line.

    Counts are held for a slice of lines at a time, so memory does not grow
    with the text.
    """
    n = len(lines)
    out = np.zeros(n - 1)
    for low in range(1, n, SLICE):
        high = min(low + SLICE, n)
        first, last = max(low - BLOCK_LINES, 0), min(high + BLOCK_LINES, n)
        counts = np.zeros((last - first + 1, AXES))
        for i in range(first, last):
            for word in WORD.findall(lines[i]):
                for part in CAMEL.split(word):
                    counts[i - first + 1, _axis(part.lower())] += 1
        total = np.cumsum(counts, axis=0)
        at = np.arange(low, high) - first
        before = total[at] - total[np.maximum(at - BLOCK_LINES, 0)]
        after = total[np.minimum(at + BLOCK_LINES, last - first)] - total[at]
        norm = np.sqrt((before**2).sum(1) * (after**2).sum(1))
        out[low - 1 : high - 1] = np.divide((before * after).sum(1), norm, out=np.zeros(high - low), where=norm > 0)
    return out


def cohesion_depth(lines: list[str]) -> np.ndarray:
    """Valley depth at the gap before each line (index 0 is unused).

    Gap similarity is the cosine between the word counts of the blocks on
    either side; depth is how far it lies below the peaks left and right.
    """
    n = len(lines)
    same = _gap_similarity(lines)
    depth = np.zeros(n)
    left = right = 0.0
    climb_left, climb_right = np.zeros(n - 1), np.zeros(n - 1)
    for i in range(n - 1):
        left = same[i] if i == 0 or same[i] > same[i - 1] or left < same[i] else left
        climb_left[i] = left
    for i in range(n - 2, -1, -1):
        right = same[i] if i == n - 2 or same[i] > same[i + 1] or right < same[i] else right
        climb_right[i] = right
    depth[1:] = climb_left + climb_right - 2 * same
    return depth


def _inside(line: str, room: int, head: int = 0) -> list[tuple[int, int]]:
    """Character spans of pieces of one long line, each within ``room`` bytes, the first one within ``head`` fewer."""
    spans, start, n, whole = [], 0, len(line), room
    room -= head
    while True:
        raw = line[start : start + room].encode("utf-8")[:room]
        stop = start + len(raw.decode("utf-8", "ignore"))
        if stop >= n:
            spans.append((start, n))
            return spans
        cut = max((line.rfind(c, start + (stop - start) // 2, stop) for c in " ;,}>\t"), default=-1)
        cut = cut + 1 if cut > start else stop
        spans.append((start, cut))
        start, room = max(cut - INSIDE_OVERLAP, start + 1), whole


def split_text(
    text: str, max_lines: int = MAX_LINES, max_bytes: int = MAX_BYTES, overlap: int = OVERLAP, least_fill: float = LEAST_FILL
) -> list[tuple[int, int, str, bool]]:
    """``(start_line, end_line, piece, inside)`` of a text, lines counted from 1; ``inside`` if the piece starts or ends within a line."""
    return split_lines(re.sub(r"\r?\n\Z", "", text).replace("\r\n", "\n").split("\n"), max_lines, max_bytes, overlap, least_fill)


def split_lines(lines: list[str], max_lines: int, max_bytes: int, overlap: int, least_fill: float = LEAST_FILL) -> list[tuple[int, int, str, bool]]:
    sizes = [len(x.encode("utf-8")) for x in lines]
    depth = cohesion_depth(lines) if len(lines) > 1 else np.zeros(1)
    pieces, start, n = [], 0, len(lines)
    fresh = 0  # the first line that no piece holds yet
    tail = ""  # the end of a long line, which the next piece starts with
    while start < n:
        if sizes[start] > max_bytes:
            # Lines before it that fit into half a piece go ahead of its first part.
            low, head = start, 0
            while start > low - 1 >= max(start - overlap, 0) and sizes[low - 1] <= max_bytes and head + sizes[low - 1] + 1 <= max_bytes // 2:
                low -= 1
                head += sizes[low] + 1
            for k, (a, b) in enumerate(_inside(lines[start], max_bytes, head)):
                before = "\n".join([*lines[low:start], ""]) if k == 0 and head else ""
                pieces.append((low + 1 if before else start + 1, start + 1, before + lines[start][a:b], True))
            tail = lines[start][-INSIDE_OVERLAP:] if overlap else ""
            start = fresh = start + 1
            continue
        lead = len(tail.encode("utf-8")) + 1 if tail else 0
        if lead + sizes[start] > max_bytes:
            tail, lead = "", 0
        room = max_lines - bool(tail)
        stop, size = start + 1, lead + sizes[start]
        while stop < n and stop - start < room and sizes[stop] <= max_bytes and size + 1 + sizes[stop] <= max_bytes:
            size += 1 + sizes[stop]
            stop += 1
        if stop < n and sizes[stop] <= max_bytes and stop - start > 1:
            least = max(start + max(overlap + 1, int((stop - start) * least_fill)), fresh + 1)
            gaps = range(min(least, stop), stop + 1)
            stop = max(gaps, key=lambda g: (round(float(depth[g]), 9), not lines[g - 1].strip(), g))
        pieces.append((start + (0 if tail else 1), stop, "\n".join([*([tail] if tail else []), *lines[start:stop]]), bool(tail)))
        tail, fresh = "", stop
        if stop >= n:
            break
        if sizes[stop] > max_bytes:
            start = stop
            continue
        # Fewer lines are shared where all of them would leave the next line no room.
        start = max(stop - overlap, start + 1)
        shared = sum(sizes[start:stop]) + stop - start
        while start < stop and shared + sizes[stop] > max_bytes:
            shared -= sizes[start] + 1
            start += 1
    return pieces


def normalized(text: Column) -> Column:
    """The text with LF line ends and without its final line break."""
    return F.regexp_replace(F.regexp_replace(text, r"\r?\n\z", ""), "\r\n", "\n")


def oversized(text: Column, max_lines: int = MAX_LINES, max_bytes: int = MAX_BYTES) -> Column:
    plain = normalized(text)
    lines = F.length(plain) - F.length(F.replace(plain, F.lit("\n"))) + 1
    return F.coalesce((F.octet_length(plain) > max_bytes) | (lines > max_lines), F.lit(False))


def _split(id_type: pa.DataType, max_lines: int, max_bytes: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                whole = hashlib.md5(text.encode("utf-8")).hexdigest()
                for k, (first, last, piece, inside) in enumerate(split_lines(text.split("\n"), max_lines, max_bytes, overlap)):
                    for column, value in zip(out, (key, k, first, last, piece, "inside_line" if inside else "between_lines", whole)):
                        column.append(value)
            kinds = (id_type, pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds)], ["id", "piece", "start_line", "end_line", "content", "cut", "whole"]
            )

    return run


def split_oversized(
    items: DataFrame, id_col: str = "file_id", text_col: str = "text",
    max_lines: int = MAX_LINES, max_bytes: int = MAX_BYTES, overlap: int = OVERLAP,
) -> DataFrame:
    """``(id_col, piece, start_line, end_line, content, cut, whole)`` of every text over the limit.

    Size is tested by expressions in the JVM, so only oversized texts reach
    Python, each in its own row; the one shuffle drops repeated rows. ``whole`` is
    the text's digest, which tells several texts of one id apart.
    """
    if not 0 <= overlap <= 8:
        raise ValueError("overlap must be between 0 and 8 lines")
    from pyspark.sql.pandas.types import to_arrow_type

    kind = items.schema[id_col].dataType
    large = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(oversized(F.col("text"), max_lines, max_bytes))
    single = large.select("id", normalized(F.col("text")).alias("text")).distinct()
    schema = f"id {kind.simpleString()}, piece int, start_line bigint, end_line bigint, content string, cut string, whole string"
    return single.mapInArrow(_split(to_arrow_type(kind), max_lines, max_bytes, overlap), schema).withColumnRenamed("id", id_col)


def oversized_cuts(items: DataFrame, id_col: str = "file_id", text_col: str = "text") -> DataFrame:
    """``(id_col, cut)``: ``inside_line`` if any piece had to be cut within a line; one row for each text of an id."""
    pieces = split_oversized(items, id_col, text_col).select(id_col, "cut", "whole")
    return pieces.groupBy(id_col, "whole").agg(F.max(F.col("cut") == "inside_line").alias("inside")).select(
        id_col, F.when(F.col("inside"), "inside_line").otherwise("between_lines").alias("cut")
    )
