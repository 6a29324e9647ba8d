"""Search tokens, term counts and hashed embeddings of texts, made in one Arrow pass over a scan.

The column form of the tokenizer (``functions.text.tokens``) says the same; it
costs several interpreted lambdas a word, so whole corpora go this way.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.sources.fnv import fnv1a64

DIM = 256


@lru_cache(maxsize=1)
def _patterns():
    import regex

    # A word; where a capital follows a small letter or digit, or the last capital of a run precedes a small letter.
    return regex.compile(r"[\p{L}\p{N}_]+"), regex.compile(r"_+|(?<=[\p{Ll}0-9])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})")


@lru_cache(maxsize=1 << 18)
def word_tokens(word: str) -> tuple[str, ...]:
    """A word in lower case, then its identifier parts of two characters or more that are shorter than it."""
    bare = word.strip("_")
    if len(bare) < 2:
        return ()
    small = bare.lower()
    if small == bare and "_" not in bare:
        return (small,)
    parts = _patterns()[1].split(bare)
    return (small, *(p.lower() for p in parts if p and 2 <= len(p) < len(bare)))


@lru_cache(maxsize=1 << 18)
def _axis(term: str, dim: int) -> int:
    return fnv1a64(term.encode("utf-8")) % dim


def count_terms(*texts: str) -> Counter:
    """How often each search token occurs in the texts together."""
    words: Counter = Counter()
    for text in texts:
        words.update(_patterns()[0].findall(text))
    out: Counter = Counter()
    for word, n in words.items():
        for term in word_tokens(word):
            out[term] += n
    return out


def embed_counts(counts: Counter, dim: int) -> np.ndarray:
    """The hashed embedding of term counts, of unit length; all zeros without terms."""
    vec = np.zeros(dim)
    for term, n in counts.items():
        vec[_axis(term, dim)] += n
    size = np.sqrt((vec * vec).sum())
    return vec / size if size else vec


ANALYSED = "id {id}, len bigint, terms array<struct<term:string,tf:bigint>>, vec array<double>"


def analyse(chunks: DataFrame, columns: tuple[str, ...] = ("path", "content"), terms: frozenset[str] | None = None, dim: int = DIM, vectors: bool = True, counted: bool = True) -> DataFrame:
    """``(id, len, terms, vec)`` of each row of ``chunks (id, *columns)``.

    ``len`` counts every token of the columns together; ``terms`` are the
    counts, of the given terms alone if some are given; ``vec`` is the hashed
    embedding of the same tokens. What is not asked for is null.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = chunks.schema["id"].dataType
    arrow = to_arrow_type(kind)
    pairs = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, posts, vecs = [], [], []
            for texts in zip(*(batch.column(i).to_pylist() for i in range(1, len(columns) + 1))):
                counts = count_terms(*texts)
                sizes.append(counts.total())
                if counted:
                    posts.append([(t, n) for t, n in counts.items() if terms is None or t in terms])
                if vectors:
                    vecs.append(embed_counts(counts, dim))
            offsets = pa.array(np.arange(0, len(vecs) * dim + 1, dim, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(arrow), pa.array(sizes, pa.int64()), pa.array([[{"term": t, "tf": n} for t, n in p] for p in posts], pairs) if counted else pa.nulls(len(batch), pairs),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(vecs))) if vecs else pa.nulls(len(batch), pa.list_(pa.float64())),
                ],
                ["id", "len", "terms", "vec"],
            )

    rows = chunks.select("id", *(F.coalesce(F.col(c), F.lit("")).alias(f"text_{i}") for i, c in enumerate(columns)))
    return rows.mapInArrow(run, ANALYSED.format(id=kind.simpleString()))
