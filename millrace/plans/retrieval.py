"""Queries over search, vectors and grounding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from millrace.functions import text as T, vectors as V
from millrace.operators import index, nearest, search, tensors, training
from millrace.plans.base import CHUNKS_SQL, QUESTIONS_SQL, chunks, questions, tokens_sql
from millrace.sources import read_table

K = 10
HEADER, FOOTER = "Sources:\n", "\n[end of sources]\n"


def bm25_search(spark: SparkSession, root: str) -> DataFrame:
    return search.bm25(chunks(spark, root), questions(spark), 40).select("query_id", "id", "score", "rank")


def vector_search(spark: SparkSession, root: str) -> DataFrame:
    return search.vector_rank(chunks(spark, root), questions(spark), 40).select("query_id", "id", "score", "rank")


def hybrid_search(spark: SparkSession, root: str) -> DataFrame:
    return search.hybrid(chunks(spark, root), questions(spark), K).select("query_id", "id", "score", "rank", "rank_lexical", "rank_vector")


def document_frequencies(spark: SparkSession, root: str) -> DataFrame:
    """How many chunks hold each term, over the whole corpus."""
    return search.postings(chunks(spark, root)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def hashed_embeddings(spark: SparkSession, root: str) -> DataFrame:
    rows = chunks(spark, root).select("id", "content")
    return search.hashed_embedding(rows, "id", "content").groupBy("id").agg(F.count("*").alias("axes"), F.round(F.sum("weight"), 6).alias("total"), F.round(F.max("weight"), 6).alias("greatest"))


def context_pack(spark: SparkSession, root: str) -> DataFrame:
    hits = search.bm25(chunks(spark, root), questions(spark), K).join(chunks(spark, root), "id")
    return index.pack_context(hits, 6000, HEADER, FOOTER).select("query_id", "n_hits", "bytes", F.md5("text").alias("digest"))


def _rows(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def _asked(spark: SparkSession, root: str) -> DataFrame:
    return _rows(spark, root).where(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), "vec", "label")


def knn_topk(spark: SparkSession, root: str) -> DataFrame:
    """Best ten for the vector of the lowest id."""
    first = _rows(spark, root).orderBy("id").limit(1).collect()
    return nearest.top_k_single(_rows(spark, root), list(first[0]["vec"]), K) if first else _rows(spark, root).select("id", F.lit(0.0).alias("score"))


def knn_batch(spark: SparkSession, root: str) -> DataFrame:
    return nearest.top_k(_rows(spark, root), _asked(spark, root), K).select("query_id", "id", "score", "rank")


def hamming_topk(spark: SparkSession, root: str) -> DataFrame:
    return nearest.hamming_top(_rows(spark, root), _asked(spark, root), K).select("query_id", "id", "distance", "rank")


def cascade_search(spark: SparkSession, root: str) -> DataFrame:
    return nearest.cascade(_rows(spark, root), _asked(spark, root), K).select("query_id", "id", "score", "rank")


def cascade_recall(spark: SparkSession, root: str) -> DataFrame:
    rows, asked = _rows(spark, root), _asked(spark, root)
    return nearest.recall(nearest.cascade(rows, asked, K), nearest.top_k(rows, asked, K)).select("query_id", F.round("recall", 6).alias("recall"))


def routing_accuracy(spark: SparkSession, root: str) -> DataFrame:
    """Share of queries whose own label has the mean vector most like them; of equal ones the last."""
    asked = _asked(spark, root)
    means = tensors.mean_vectors(_rows(spark, root), "label", "vec").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("axis", "mean"))).alias("m")).select(F.col("label").cast("bigint").alias("id"), F.col("m.mean").alias("vec"))
    scores = nearest.top_k(means, asked, 1000).select("query_id", F.col("id").alias("idx"), "score")
    return training.routing_accuracy(scores, asked.select("query_id", F.col("label").cast("bigint").alias("idx"))).select(F.round("accuracy", 6).alias("accuracy"), "n")


def _weights(dim: int = 64, width: int = 8) -> np.ndarray:
    return np.cos(np.arange(dim * width).reshape(dim, width)) / 8.0


def projected_vectors(spark: SparkSession, root: str) -> DataFrame:
    """Vectors sent through a head with given weights, at unit length."""
    rows = training.project(_rows(spark, root).select("id", "vec"), _weights())
    return rows.select("id", *(F.round(F.element_at("vec", i), 6).alias(f"v{i}") for i in (1, 4, 8)))


def neighbour_accuracy(spark: SparkSession, root: str) -> DataFrame:
    """Share of queries whose nearest other vector has their label."""
    asked = _asked(spark, root)
    found = nearest.top_k(_rows(spark, root), asked, 2).where(F.col("id") != F.col("query_id"))
    first = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") == 1)
    ranked = first.join(_rows(spark, root).select("id", "label"), "id")
    return training.accuracy(ranked, asked.select("query_id", "label")).select(F.round("accuracy", 6).alias("accuracy"), "n")


def margin_gate(spark: SparkSession, root: str) -> DataFrame:
    found = nearest.top_k(_rows(spark, root), _asked(spark, root), 3).where(F.col("id") != F.col("query_id"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return nearest.gate(ranked, 0.05)


def label_means(spark: SparkSession, root: str) -> DataFrame:
    means = tensors.mean_vectors(_rows(spark, root), "label", "vec")
    return means.groupBy("label").agg(F.count("*").alias("dim"), F.round(F.sqrt(F.sum(F.col("mean") * F.col("mean"))), 6).alias("norm"))


def vector_norms(spark: SparkSession, root: str) -> DataFrame:
    rows = read_table(spark, root, "index_vectors").where(F.col("embedding").isNotNull() & V.all_finite(F.col("embedding")) & (F.size("embedding") > 0))
    return rows.select("vector_file", "chunk_id", F.round(V.norm(F.col("embedding")), 6).alias("norm")).distinct()


def index_meta_check(spark: SparkSession, root: str) -> DataFrame:
    """Vector files whose meta differs from their contents."""
    held = read_table(spark, root, "index_vectors").groupBy("vector_file").agg(F.countDistinct("chunk_id").alias("held"), F.max(F.size("embedding")).alias("longest"))
    rows = read_table(spark, root, "index_meta").join(held, "vector_file", "left")
    return rows.select("vector_file", "dim", "count", F.coalesce("held", F.lit(0)).alias("held"), (F.col("count") == F.coalesce("held", F.lit(0))).alias("fits"))


_TF = f"""{CHUNKS_SQL},
tk AS (SELECT id, symbol, list_concat({tokens_sql('path')}, {tokens_sql('content')}) AS t FROM chunks),
post AS (SELECT id, term, count(*) AS tf, max(len) AS len FROM (SELECT id, len(t) AS len, unnest(t) AS term FROM tk) GROUP BY id, term)"""
_BM25 = f"""{QUESTIONS_SQL}, {_TF},
terms AS (SELECT DISTINCT query_id, unnest({tokens_sql('text')}) AS term FROM questions),
corpus AS (SELECT count(*) AS n, greatest(avg(len(t)), 1.0) AS mean_len FROM tk),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean_len))) AS raw
  FROM post JOIN df USING (term) JOIN terms USING (term), corpus GROUP BY query_id, id),
hits AS (SELECT DISTINCT query_id, id FROM (SELECT id, unnest({tokens_sql('symbol')}) AS term FROM chunks) JOIN terms USING (term) WHERE strlen(term) >= 3),
lex AS (SELECT query_id, id, round(raw * CASE WHEN h.id IS NULL THEN 1.0 ELSE 1.5 END, 6) AS score FROM raw r LEFT JOIN hits h USING (query_id, id)),
lexical AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM lex WHERE score > 0) WHERE rank <= 40)"""
_FNV = """list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, length(hex(encode(term))), 2), lambda i: ('0x' || substr(hex(encode(term)), i, 2))::INT::HUGEINT)),
  lambda h, b: ((h - h % 256 + xor((h % 256)::BIGINT, b::BIGINT)::HUGEINT) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"""


def _embedding(name: str, source: str, key: str, text: str) -> str:
    return f"""{name}_tf AS (SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest({tokens_sql(text)}) AS term FROM {source}) GROUP BY ALL),
{name}_ax AS (SELECT {key}, axis, sum(tf)::DOUBLE AS tf FROM {name}_tf JOIN (SELECT term, ({_FNV} % 256)::INT AS axis FROM (SELECT DISTINCT term FROM {name}_tf)) USING (term) GROUP BY ALL),
{name} AS (SELECT {key}, axis, tf / sqrt(sum(tf * tf) OVER (PARTITION BY {key})) AS weight FROM {name}_ax)"""


_VECTOR = f"""bodies AS (SELECT id, path || chr(10) || content AS body FROM chunks),
{_embedding('docs', 'bodies', 'id', 'body')},
{_embedding('asked', 'questions', 'query_id', 'text')},
near AS (SELECT query_id, id, round(sum(d.weight * a.weight), 6) AS score FROM docs d JOIN asked a USING (axis) GROUP BY query_id, id),
vector AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM near) WHERE rank <= 40)"""
_PAIR = """rows AS (SELECT vec_id AS id, embedding AS vec, label FROM embeddings),
asked AS (SELECT id AS query_id, vec AS q, label AS asked_label FROM rows WHERE id % 20 = 0)"""
_DOT = "list_dot_product(vec::DOUBLE[], q::DOUBLE[])"
_EXACT = f"""{_PAIR},
scored AS (SELECT query_id, id, label, asked_label, round({_DOT}, 6) AS score FROM rows, asked),
exact AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= 10)"""
_HAMMING = "list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (vec[i] > 0) <> (q[i] > 0) THEN 1 ELSE 0 END))::BIGINT"
_TAGS = "CASE " + " ".join(f"WHEN ext IN ({', '.join(repr(x) for x in endings.split())}) THEN '{name}'" for name, endings in T.FENCE_TAGS.items()) + " ELSE '' END"
_FRAME = {"head": "'Sources:' || chr(10)", "foot": "chr(10) || '[end of sources]' || chr(10)"}

ORACLE = {
    "bm25_search": f"WITH {_BM25} SELECT query_id, id, score, rank FROM lexical",
    "vector_search": f"WITH {QUESTIONS_SQL}, {CHUNKS_SQL}, {_VECTOR} SELECT query_id, id, score, rank FROM vector",
    "hybrid_search": f"""WITH {_BM25}, {_VECTOR},
      parts AS (SELECT query_id, id, 1.0::DOUBLE / (60 + rank) AS share, rank AS rl, NULL AS rv FROM lexical UNION ALL SELECT query_id, id, 1.0::DOUBLE / (60 + rank), NULL, rank FROM vector),
      fused AS (SELECT query_id, id, round(sum(share), 8) AS score, max(rl) AS rank_lexical, max(rv) AS rank_vector FROM parts GROUP BY query_id, id)
      SELECT query_id, id, score, rank, rank_lexical, rank_vector FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fused) WHERE rank <= 10""",
    "document_frequencies": f"WITH {_TF} SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM post GROUP BY term",
    "hashed_embeddings": f"WITH {CHUNKS_SQL}, {_embedding('docs', 'chunks', 'id', 'content')} SELECT id, count(*) AS axes, round(sum(weight), 6) AS total, round(max(weight), 6) AS greatest FROM docs GROUP BY id",
    "knn_topk": f"""WITH {_PAIR}, one AS (SELECT vec AS q FROM rows ORDER BY id LIMIT 1)
      SELECT id, round({_DOT}, 6) AS score FROM rows, one ORDER BY score DESC, id LIMIT 10""",
    "knn_batch": f"WITH {_EXACT} SELECT query_id, id, score, rank FROM exact",
    "hamming_topk": f"""WITH {_PAIR} SELECT query_id, id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank
      FROM (SELECT query_id, id, {_HAMMING} AS distance FROM rows, asked)) WHERE rank <= 10""",
    "cascade_search": f"WITH {_EXACT} SELECT query_id, id, score, rank FROM exact",
    "cascade_recall": f"WITH {_PAIR} SELECT query_id, 1.0::DOUBLE AS recall FROM asked",
    "routing_accuracy": f"""WITH {_PAIR}, x AS (SELECT label, i, avg(vec[i]::DOUBLE) AS m FROM (SELECT label, vec, unnest(range(1, len(vec) + 1)) AS i FROM rows) GROUP BY label, i),
      m AS (SELECT label, list(m ORDER BY i) AS mean FROM x GROUP BY label),
      s AS (SELECT query_id, asked_label, label, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(mean, q::DOUBLE[]), 6) DESC, label DESC) AS k FROM asked, m)
      SELECT round(avg(CASE WHEN label = asked_label THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM s WHERE k = 1""",
    "projected_vectors": """WITH p AS (SELECT vec_id AS id, list_transform(range(0, 8), lambda j: list_sum(list_transform(range(0, 64), lambda i: embedding[i + 1]::DOUBLE * cos(i * 8 + j) / 8.0))) AS v FROM embeddings),
      n AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM p)
      SELECT id, round(v[1] / size, 6) AS v1, round(v[4] / size, 6) AS v4, round(v[8] / size, 6) AS v8 FROM n""",
    "context_pack": f"""WITH {_BM25},
      picked AS (SELECT query_id, rank, path, content, lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1)) AS ext, repeat('`', greatest(coalesce(list_max(list_transform(regexp_extract_all(content, '`+'), lambda x: length(x))), 0), 2)::INT + 1) AS mark
        FROM lexical JOIN chunks USING (id) WHERE rank <= 10),
      entries AS (SELECT query_id, rank, chr(10) || '[' || rank || '] ' || path || chr(10) || mark || {_TAGS} || chr(10) || replace(content, {_FRAME['foot']}, '[end]') || chr(10) || mark || chr(10) AS entry FROM picked),
      summed AS (SELECT *, sum(strlen(entry)) OVER (PARTITION BY query_id ORDER BY rank) + strlen({_FRAME['head']} || {_FRAME['foot']}) <= 6000 AS fits FROM entries),
      packed AS (SELECT query_id, sum(CASE WHEN fits THEN 1 ELSE 0 END)::BIGINT AS n_hits, {_FRAME['head']} || coalesce(string_agg(CASE WHEN fits THEN entry END, '' ORDER BY rank), '') || {_FRAME['foot']} AS text FROM summed GROUP BY query_id)
      SELECT query_id, n_hits, strlen(text) AS bytes, md5(text) AS digest FROM packed""",
    "neighbour_accuracy": f"""WITH {_EXACT}, first AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM exact WHERE rank <= 2 AND id <> query_id)
      SELECT round(avg(CASE WHEN label = asked_label THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM first WHERE k = 1""",
    "margin_gate": f"""WITH {_EXACT}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM exact WHERE rank <= 3 AND id <> query_id),
      t AS (SELECT query_id, min_by(id, k) AS first, max(score) AS best, CASE WHEN count(*) > 1 THEN min(score) END AS second FROM r WHERE k <= 2 GROUP BY query_id)
      SELECT query_id, CASE WHEN second IS NULL OR round(best - second, 6) >= 0.05 THEN first END AS picked, round(best - second, 6) AS margin FROM t""",
    "label_means": """WITH x AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i)
      SELECT label, count(*) AS dim, round(sqrt(sum(m * m)), 6) AS norm FROM x GROUP BY label""",
    "vector_norms": """SELECT DISTINCT vector_file, chunk_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM index_vectors
      WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0""",
    "index_meta_check": """SELECT m.vector_file, m.dim, m.count, coalesce(h.held, 0) AS held, m.count = coalesce(h.held, 0) AS fits FROM index_meta m
      LEFT JOIN (SELECT vector_file, count(DISTINCT chunk_id) AS held FROM index_vectors GROUP BY 1) h USING (vector_file)""",
}

QUERIES = (
    bm25_search, vector_search, hybrid_search, document_frequencies, hashed_embeddings, context_pack, knn_topk, knn_batch, hamming_topk, cascade_search, cascade_recall,
    routing_accuracy, projected_vectors, neighbour_accuracy, margin_gate, label_means, vector_norms, index_meta_check,
)
