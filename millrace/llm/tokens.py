"""Encoding a corpus with a public byte-level BPE vocabulary.

Texts are cut at content-defined points (a rolling hash over the last 16
bytes), equal chunks of all documents are encoded once, and the ids are joined
again. A cut is only kept where encoding both sides apart agrees with encoding
them together: the window around each cut is re-encoded, and while the two
disagree the cut moves on to the next start of a white-space run.

Defined results
- null and empty texts give an empty list;
- special-token strings inside a text are ordinary text;
- one result row per distinct ``(id, text)``: repeated rows come out once;
- very long texts are cut like others; a run without white space stays whole;
- extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

VOCABULARY = "byte_bpe_50k"
SPACES = b" \t\n\r\x0b\x0c"
WINDOW = 16
MASK = np.uint32((1 << 10) - 1)
LEAST = 64
# The pre-tokenizer's pattern, published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_dir() -> str:
    """Folder of the vocabulary files: MILLRACE_TOKENIZERS, /opt/tokenizers or the installed package."""
    named = os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers")
    if os.path.isdir(named):
        return named
    spec = importlib.util.find_spec("public_tokenizers")
    if spec is None or spec.origin is None:
        raise FileNotFoundError("no folder of tokenizer vocabularies")
    return os.path.dirname(spec.origin)


@lru_cache(maxsize=4)
def encoder(vocabulary: str = VOCABULARY, folder: str | None = None):
    """The vocabulary's encoder, read once per Python worker."""
    import tiktoken

    with open(os.path.join(folder or vocabulary_dir(), f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _gear() -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """Hash of the ``WINDOW`` bytes that end at each position (fewer at the start)."""
    gear = _gear()[data]
    out = gear.copy()
    for k in range(1, min(WINDOW, len(data))):
        out[k:] += gear[:-k] << np.uint32(k * 2 % 32)
    return out


def _run_start(raw: bytes, at: int) -> int:
    """First start of a white-space run at or after ``at``, or the text's end."""
    n = len(raw)
    while at < n:
        if raw[at] in SPACES and raw[at - 1] not in SPACES:
            if raw[at - 1] < 0x80:
                if raw[at - 1] > 0x20:
                    return at
            else:
                back = at - 1
                while raw[back] & 0xC0 == 0x80:
                    back -= 1
                if not raw[back:at].decode("utf-8", "replace").isspace():
                    return at
        at += 1
    return n


def _agrees(raw: bytes, cut: int, start: int, encode) -> bool:
    """Whether the ids of the window around ``cut`` are those of its two halves."""
    left = cut - 1
    while left > start and not (raw[left] in SPACES and raw[left - 1] not in SPACES):
        left -= 1
    right = _run_start(raw, cut + 1)
    a, b = raw[left:cut].decode("utf-8"), raw[cut:right].decode("utf-8")
    return encode(a + b) == encode(a) + encode(b)


def chunk_bytes(raw: bytes, encode) -> list[bytes]:
    """Content-defined chunks of ``raw`` whose ids concatenate to the ids of the whole."""
    n = len(raw)
    if n <= LEAST:
        return [raw]
    marks = np.flatnonzero((rolling_hash(np.frombuffer(raw, dtype=np.uint8)) & MASK) == 0)
    chunks, start = [], 0
    for mark in marks.tolist():
        if mark - start < LEAST:
            continue
        cut = _run_start(raw, mark)
        while cut < n and not _agrees(raw, cut, start, encode):
            cut = _run_start(raw, cut + 1)
        if cut >= n:
            break
        chunks.append(raw[start:cut])
        start = cut
    chunks.append(raw[start:])
    return chunks


def _chunker(id_type: pa.DataType, vocabulary: str, folder: str | None, with_text: bool):
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, folder).encode_ordinary
        for batch in batches:
            ids, whole, place, keys, texts = [], [], [], [], []
            seen: set[bytes] = set()
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = text.as_buffer().to_pybytes()
                parts = chunk_bytes(raw, encode)
                if with_text:
                    for part in parts:
                        key = xxhash.xxh3_128_digest(part)
                        if key not in seen:
                            seen.add(key)
                            keys.append(key)
                            texts.append(part.decode("utf-8"))
                else:
                    sign = xxhash.xxh3_64_intdigest(raw) - (1 << 63)
                    for k, part in enumerate(parts):
                        ids.append(doc)
                        whole.append(sign)
                        place.append(k)
                        keys.append(xxhash.xxh3_128_digest(part))
            if with_text:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(texts, pa.string())], ["key", "chunk"])
            else:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, id_type), pa.array(whole, pa.int64()), pa.array(place, pa.int32()), pa.array(keys, pa.binary())],
                    ["id", "whole", "place", "key"],
                )

    return run


def _encode_chunks(vocabulary: str, folder: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, folder).encode_ordinary
        for batch in batches:
            ids = [encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])

    return run


def encode_corpus(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, folder: str | None = None
) -> DataFrame:
    """``(id_col, ids array<int>)`` for every row of ``documents``.

    The corpus is scanned twice, once for the chunk references and once for
    the distinct chunk texts, which is cheaper than storing the cut corpus.
    References are narrow; a chunk shared by a third of all documents is one
    row on the encoding side, and the join's hot key is left to AQE to split.
    """
    kind = documents.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    filled = texts.where(F.col("text").isNotNull() & (F.col("text") != ""))
    blank = texts.where(F.col("text").isNull() | (F.col("text") == "")).select("id").distinct()
    id_ddl = kind.simpleString()
    arrow = to_arrow_type(kind)
    refs = filled.mapInArrow(_chunker(arrow, vocabulary, folder, False), f"id {id_ddl}, whole bigint, place int, key binary")
    chunks = filled.mapInArrow(_chunker(arrow, vocabulary, folder, True), "key binary, chunk string")
    coded = chunks.groupBy("key").agg(F.first("chunk").alias("chunk")).mapInArrow(
        _encode_chunks(vocabulary, folder), "key binary, ids array<int>"
    )
    joined = refs.join(coded, "key").groupBy("id", "whole").agg(F.array_sort(F.collect_set(F.struct("place", "ids"))).alias("parts"))
    done = joined.select("id", F.flatten(F.col("parts.ids")).alias("ids"))
    empty = blank.select("id", F.array().cast("array<int>").alias("ids"))
    return done.unionByName(empty).select(F.col("id").alias(id_col), "ids")
