"""Scoring, vectors and fusion against hand-made and brute-force values."""

import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from millrace.functions import text as T, vectors as V
from millrace.functions.hashing import fnv1a64
from millrace.operators import analysis, nearest, search


def chunks(spark, rows):
    return spark.createDataFrame(rows, "id long, path string, content string, symbol string")


def test_bm25_by_hand(spark):
    table = chunks(spark, [(1, "a", "red blue", None), (2, "b", "red red green green", "redTool"), (3, "c", "blue", None)])
    queries = spark.createDataFrame([(1, "red")], "query_id int, text string")
    got = {r.id: r.score for r in search.bm25(table, queries, 10).collect()}
    mean, idf = 7 / 3, math.log(1 + (3 - 2 + 0.5) / (2 + 0.5))

    def score(tf, n):
        return idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))

    assert got == {1: round(score(1, 2), 6), 2: round(score(2, 4) * 1.5, 6)}


def test_empty_inputs(spark):
    none = chunks(spark, [])
    asked = spark.createDataFrame([(1, "red"), (2, ""), (3, None)], "query_id int, text string")
    assert search.hybrid(none, asked, 5).count() == 0
    assert search.bm25(chunks(spark, [(1, None, None, None)]), asked, 5).count() == 0


def test_fusion_ranks(spark):
    table = chunks(spark, [(i, "p", "x", None) for i in range(4)])
    ranked = "query_id int, id long, rank int"
    a = spark.createDataFrame([(1, 0, 1), (1, 1, 2)], ranked)
    b = spark.createDataFrame([(1, 1, 1), (1, 9, 2)], ranked)
    rows = search.fuse({"a": a, "b": b}, table, 5).orderBy("rank").collect()
    assert [(r.id, r.score) for r in rows] == [(1, round(1 / 62 + 1 / 61, 8)), (0, round(1 / 61, 8))]
    assert (rows[0].rank_a, rows[0].rank_b) == (2, 1)


def vectors(spark, matrix, key):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(matrix)], f"{key} long, vec array<float>")


@pytest.mark.parametrize("query_block", [3, 4096])
def test_exact_search_matches_brute_force(spark, monkeypatch, query_block):
    """Queries that every task holds, and blocks of queries against blocks of rows."""
    monkeypatch.setattr(nearest, "ROW_BLOCK", 40)
    rng = np.random.default_rng(1)
    points = np.round(rng.normal(size=(150, 8)), 2).astype(np.float32)
    points[7] = points[3]
    rows, asked = vectors(spark, points, "id").repartition(5), vectors(spark, points[:8], "query_id")
    got = {}
    for r in nearest.top_k(rows, asked, 5, query_block=query_block).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id))
    scores = np.round(points[:8].astype(float) @ points.astype(float).T, 6)
    for q in range(8):
        assert [i for _, i in sorted(got[q])] == sorted(range(150), key=lambda i: (-scores[q][i], i))[:5]


def test_hamming_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(300, 70)).astype(np.float32)
    rows, asked = vectors(spark, points, "id"), vectors(spark, points[:5], "query_id")
    got = {(r.query_id, r.rank): (r.distance, r.id) for r in nearest.hamming_top(rows, asked, 20).collect()}
    for q in range(5):
        far = ((points > 0) != (points[q] > 0)).sum(axis=1)
        assert [got[q, k + 1] for k in range(20)] == sorted((int(d), i) for i, d in enumerate(far))[:20]


@pytest.mark.parametrize("size", [3, 1500])
def test_staged_search_finds_all(spark, size):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(1500, 64)).astype(np.float32)
    points[200:400] = points[0] + 0.1 * points[200:400]
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    points[9] = points[4]
    rows, asked = vectors(spark, points[:size], "id"), vectors(spark, points[:20], "query_id")
    exact = nearest.top_k(rows, asked, 10)
    wanted = sorted(map(tuple, exact.select("query_id", "id", "score", "rank").collect()))
    assert sorted(map(tuple, nearest.cascade(rows, asked, 10).select("query_id", "id", "score", "rank").collect())) == wanted and len(wanted) == 20 * min(size, 10)
    assert min(r.recall for r in nearest.recall(nearest.cascade(rows, asked, 10), exact).collect()) == 1.0


def test_many_terms_and_few_give_the_same(spark):
    table = chunks(spark, [(i, f"src/f{i}.py", " ".join(["alpha beta gammaRay"[i % 3 :], "delta_x " * (i % 5)]), "deltaX") for i in range(40)])
    asked = spark.createDataFrame([(1, "alpha delta_x"), (2, "gammaRay beta")], "query_id int, text string")
    few, many = (sorted(map(tuple, search.bm25(table, asked, 10, few=n).select("query_id", "id", "score", "rank").collect())) for n in (100, 0))
    assert few == many and few


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet=st.sampled_from("aB_Ç1é日ßX -.\n"), max_size=60))
def test_both_tokenizers_agree(spark, text):
    """The column form and the Arrow form of the tokenizer are twins."""
    row = spark.createDataFrame([(text,)], "t string").select(T.tokens(F.col("t")).alias("x")).first()
    assert Counter(row.x) == analysis.count_terms(text)


def test_embeddings_of_both_forms(spark):
    text = "readConfig reads the config of the config reader"
    counts = analysis.count_terms(text)
    vec = analysis.embed_counts(counts, 256)
    got = {r.axis: r.weight for r in search.hashed_embedding(spark.createDataFrame([(1, text), (2, None), (3, "")], "k long, text string"), "k", "text").collect()}
    assert got == {i: x for i, x in enumerate(vec) if x} and abs(sum(x * x for x in got.values()) - 1) < 1e-12
    axes = {t: spark.range(1).select((fnv1a64(F.lit(t)) % 256).cast("int").alias("a")).first().a for t in counts}
    assert {a for a in axes.values()} == set(got)


def test_search_edges(spark):
    rows = spark.createDataFrame([(5, [0.6, 0.8]), (3, [0.6, 0.8]), (9, [0.6, 0.8]), (1, [-0.6, -0.8]), (2, [float("nan"), 1.0]), (4, None)], "id long, vec array<float>")
    asked = spark.createDataFrame([(0, [0.6, 0.8]), (1, [float("inf"), 0.0])], "query_id long, vec array<float>")
    assert [(r.query_id, r.id) for r in nearest.top_k(rows, asked, 3).orderBy("query_id", "rank").collect()] == [(0, 3), (0, 5), (0, 9)]
    assert nearest.top_k(rows, asked, 0).count() == 0
    assert [r.id for r in nearest.top_k_single(rows, [0.6, 0.8], 3).collect()] == [3, 5, 9]
    assert nearest.top_k(rows, asked, 99).where("query_id = 0").count() == 4


def test_expressions(spark):
    row = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>").select(
        V.dot(F.col("a"), F.col("b")).alias("dot"), V.normalized(F.col("a")).alias("unit"), V.normalized(F.col("z")).alias("zero"), V.cosine(F.col("a"), F.col("z")).alias("none"),
        V.sign_bits(F.col("a"), 0, 2).alias("bits"),
    ).first()
    assert row.dot == 3.0 and row.unit == [0.6, 0.8] and row.zero == [0.0, 0.0] and row.none is None and row.bits == 3
    assert spark.range(1).select(V.hamming(F.lit(0xAA55), F.lit(0x55AA)).alias("h")).first().h == 16


def test_recall_and_gate(spark):
    schema = "query_id int, id long, score double, rank int"
    exact = spark.createDataFrame([(1, 1, 0.9, 1), (1, 2, 0.8, 2)], schema)
    found = spark.createDataFrame([(1, 3, 0.8, 1)], schema)
    assert nearest.recall(found, exact).first().recall == 0.5
    ranked = spark.createDataFrame([(1, 7, 0.90, 1), (1, 8, 0.88, 2), (2, 7, 0.9, 1), (2, 8, 0.1, 2), (3, 5, 0.2, 1)], schema)
    assert {r.query_id: r.picked for r in nearest.gate(ranked, 0.05).collect()} == {1: None, 2: 7, 3: 5}
