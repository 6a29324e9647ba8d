"""Lexical scoring, hashed embeddings and rank fusion over chunk tables ``(id, path, content, symbol)``.

Texts are read once by ``analysis.analyse``; queries are a table ``(query_id,
text)``. Where the terms of all queries are few, which is checked, a text gives
only those; otherwise postings of all terms are joined with them. What meets
every row is a one-row table of corpus statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from millrace.functions import text as T
from millrace.operators import nearest
from millrace.operators.analysis import DIM, analyse
from millrace.session import cut_lineage

K1, B, BOOST = 1.2, 0.75, 1.5
RRF_K, OVERFETCH = 60, 4
FEW_TERMS = 65536


def postings(chunks: DataFrame) -> DataFrame:
    """``(id, term, tf, len)`` with the path's tokens and the content's; ``len`` counts every token. No shuffle: a text counts its own terms."""
    return _spread(analyse(chunks, vectors=False))


def _spread(analysed: DataFrame) -> DataFrame:
    return analysed.select("id", "len", F.explode_outer("terms").alias("x")).where(F.col("x").isNotNull()).select("id", "x.term", "x.tf", "len")


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))


def bm25(chunks: DataFrame, queries: DataFrame, limit: int, few: int = FEW_TERMS) -> DataFrame:
    """``(query_id, id, score, rank)``: the best chunks by BM25, those whose symbol is a query term raised by half.

    Scores are rounded to 6 decimals before they are ranked; ties go by id.
    Chunks without tokens count in the mean length, which is 1 at least.
    """
    terms = query_terms(queries)
    wanted = [r.term for r in terms.select("term").distinct().limit(few + 1).collect()]
    if len(wanted) <= few:
        analysed = cut_lineage(analyse(chunks, terms=frozenset(wanted), vectors=False).select("id", "len", "terms"))
        held = _spread(analysed)
    else:
        analysed = cut_lineage(analyse(chunks, vectors=False).select("id", "len", "terms"))
        held = _spread(analysed).join(terms.select("term").distinct(), "term", "left_semi")
    sizes = analysed.agg(F.count("*").alias("n"), F.greatest(F.coalesce(F.avg("len"), F.lit(0.0)), F.lit(1.0)).alias("mean_len"))
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = df.crossJoin(sizes).select("term", idf.alias("idf"), "mean_len")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean_len")))
    scored = held.join(terms.join(weights, "term"), "term").groupBy("query_id", "id").agg(F.sum(part).alias("raw"))
    raised = symbol_hits(chunks, terms).withColumn("raised", F.lit(True))
    scored = scored.join(raised, ["query_id", "id"], "left").withColumn("score", F.round(F.col("raw") * F.when(F.col("raised"), BOOST).otherwise(1.0), 6))
    return top(scored.where(F.col("score") > 0).select("query_id", "id", "score"), limit)


def symbol_hits(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """``(query_id, id)`` of chunks whose symbol has a token of three bytes or more that is a query term."""
    parts = chunks.where(F.col("symbol").isNotNull()).select("id", F.explode(F.array_distinct(T.tokens(F.col("symbol")))).alias("term"))
    return parts.where(F.octet_length("term") >= 3).join(terms, "term").select("query_id", "id").distinct()


def top(scored: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` rows of each query with their rank; partial limits apply before the shuffle."""
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


def hashed_embedding(rows: DataFrame, key: str, text: str, dim: int = DIM) -> DataFrame:
    """``(key, axis, weight)``: the hashed bag-of-tokens embedding of each text, its axes that aren't zero."""
    made = analyse(rows.select(F.col(key).alias("id"), F.col(text).alias("text")), ("text",), dim=dim, counted=False)
    return made.select(F.col("id").alias(key), F.posexplode("vec").alias("axis", "weight")).where(F.col("weight") != 0)


def embedded(chunks: DataFrame, columns: tuple[str, ...] = ("path", "content"), dim: int = DIM) -> DataFrame:
    """``(id, vec)``: dense hashed embeddings."""
    return analyse(chunks, columns, dim=dim, counted=False).select("id", "vec")


def vector_rank(chunks: DataFrame, queries: DataFrame, limit: int, dim: int = DIM) -> DataFrame:
    """``(query_id, id, score, rank)`` by cosine of hashed embeddings, of chunks that share something with the query.

    Vectors are dense and meet the queries in blocks where they are made.
    """
    asked = analyse(queries.select(F.col("query_id").alias("id"), "text"), ("text",), dim=dim, counted=False).select(F.col("id").alias("query_id"), "vec")
    found = nearest.top_k(embedded(chunks, dim=dim), asked, limit)
    return found.where(F.col("score") > 0)


def fuse(lists: dict[str, DataFrame], chunks: DataFrame, k: int) -> DataFrame:
    """Reciprocal rank fusion of ranked lists: ``(query_id, id, score, rank, rank_<list>...)``.

    A union and one grouping stand in for a full outer join. Ids without a
    chunk are dropped before the best ``k`` are kept.
    """
    parts = None
    for name, ranked in lists.items():
        cells = [F.col("rank").alias(f"rank_{x}") if x == name else F.lit(None).cast("int").alias(f"rank_{x}") for x in lists]
        part = ranked.select("query_id", "id", (1.0 / (RRF_K + F.col("rank"))).alias("share"), *cells)
        parts = part if parts is None else parts.unionByName(part)
    sums = parts.groupBy("query_id", "id").agg(F.round(F.sum("share"), 8).alias("score"), *(F.max(f"rank_{x}").alias(f"rank_{x}") for x in lists))
    return top(sums.join(chunks.select("id"), "id", "left_semi"), k)


def hybrid(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Best ``k`` chunks a query by fused lexical and vector ranks, each retriever fetching four times as many."""
    lists = {"lexical": bm25(chunks, queries, k * OVERFETCH), "vector": vector_rank(chunks, queries, k * OVERFETCH)}
    return fuse(lists, chunks, k)
