"""Vantage-point search against brute force, with files that are cut into cells and cells of cells."""

import numpy as np
import pytest

from millrace.llm import neighbours as N


def brute(files, dims, k=10):
    pairs = set()
    for name, rows in files.items():
        if name not in dims:
            continue
        seen = {}
        for key, vec in rows:
            if key is not None and vec is not None and len(vec) == dims[name] and np.isfinite(np.array(vec, dtype=float)).all() and np.any(vec):
                seen[key] = np.asarray(vec, dtype=np.float32).astype(float)
        ids = np.array(sorted(seen))
        if len(ids) < 2:
            continue
        points = np.stack([seen[i] / np.linalg.norm(seen[i]) for i in ids])
        sims = np.round(points @ points.T, 8)
        for i, row in enumerate(sims):
            order = [j for j in np.lexsort((ids, -row)) if j != i][:k]
            pairs |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in order}
    return {(int(a), int(b)) for a, b in pairs}


def tables(spark, files, dims):
    rows = [(f, i, None if v is None else [None if x is None else float(x) for x in v], "x") for f, part in files.items() for i, v in part]
    return (
        spark.createDataFrame(rows, "vector_file string, chunk_id long, embedding array<float>, node string"),
        spark.createDataFrame([(f, d, 3) for f, d in dims.items()], "vector_file string, dim int, count long"),
    )


def clustered(rng, n, dim, groups, start=0):
    centres = rng.normal(size=(groups, dim))
    return [(start + i, centres[i % groups] + 0.4 * rng.normal(size=dim)) for i in range(n)]


def found(frame):
    rows = [tuple(r) for r in frame.collect()]
    assert len(rows) == len(set(rows)) and all(a < b for a, b in rows)
    return set(rows)


def test_dirt_ties_and_copies(spark):
    rng = np.random.default_rng(0)
    a = clustered(rng, 60, 6, 4)
    a += [(100 + i, a[3][1]) for i in range(25)] + [(200 + i, 2.5 * a[5][1]) for i in range(3)] + [a[0], a[0]]
    a += [(900, None), (901, [0.0] * 6), (902, [1.0] * 5), (903, [float("nan")] * 6), (904, [float("inf")] + [1.0] * 5), (905, [None] * 6), (None, a[1][1]), (906, [])]
    files = {"a": a, "b": [(1000 + i, rng.normal(size=3)) for i in range(5)], "c": [(2000, [1.0, 0.0])], "no_meta": [(3000 + i, [1.0, float(i)]) for i in range(4)]}
    dims = {"a": 6, "b": 3, "c": 2}
    assert found(N.similar_pairs(*tables(spark, files, dims), relax=1.0)) == brute(files, dims)


@pytest.mark.parametrize("limits", [(16, 48, 4096), (16, 48, 4)])
def test_cells_and_cells_of_cells(spark, monkeypatch, limits):
    monkeypatch.setattr(N, "CELL", limits[0])
    monkeypatch.setattr(N, "CELL_MAX", limits[1])
    monkeypatch.setattr(N, "FANOUT", limits[2])
    monkeypatch.setattr(N, "LEAF", 8)
    rng = np.random.default_rng(1)
    files = {"a": clustered(rng, 400, 8, 12), "b": clustered(rng, 90, 8, 3, 1000), "c": clustered(rng, 20, 8, 2, 2000)}
    dims = dict.fromkeys(files, 8)
    want = brute(files, dims)
    assert found(N.similar_pairs(*tables(spark, files, dims), relax=1.0)) == want
    some = found(N.similar_pairs(*tables(spark, files, dims)))
    assert len(some & want) >= 0.9 * len(want)


def test_lists_are_ordered(spark):
    files = {"a": clustered(np.random.default_rng(2), 40, 5, 3)}
    rows = N.neighbour_lists(*tables(spark, files, {"a": 5}), k=4, relax=1.0).collect()
    assert len(rows) == 40
    for r in rows:
        assert len(r.neighbours) == 4 and [(-x.sim, x.id) for x in r.neighbours] == sorted((-x.sim, x.id) for x in r.neighbours)


def test_empty(spark):
    vectors, meta = tables(spark, {"a": [(1, [1.0])]}, {"a": 1})
    assert N.similar_pairs(vectors.limit(0), meta).count() == 0 and N.similar_pairs(vectors, meta.limit(0)).count() == 0 and N.similar_pairs(vectors, meta).count() == 0


def test_tree_is_exact_at_factor_one():
    rng = np.random.default_rng(4)
    points = rng.normal(size=(500, 6))
    points /= np.linalg.norm(points, axis=1)[:, None]
    ids = rng.permutation(500)
    sims, names = np.full((50, 5), -np.inf), np.full((50, 5), np.iinfo(np.int64).max)
    N.VantageTree(points, ids, leaf=16).search(points[:50], sims, names, 1.0)
    whole = np.round(points[:50] @ points.T, 8)
    for i in range(50):
        assert list(names[i]) == list(ids[np.lexsort((ids, -whole[i]))[:5]])
