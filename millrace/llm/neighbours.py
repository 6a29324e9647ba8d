"""The most similar vectors of every vector, file by file, by vantage-point trees.

Plan
1. Usable vectors are keyed by their direction, batch by batch; equal ones collapse to one
   representative with the smallest ``k + 1`` ids, which is all that any list
   of ``k`` neighbours can use, so a group of copies that holds a third of all
   rows costs one search.
2. A file beyond ``CELL_MAX`` vectors is cut into cells around vantage points
   fitted on a bounded sample of it (``FIT_ROWS``); cells that are still too
   large are cut again. Every vector is indexed. Each cell is a shard with a
   vantage-point tree of its own.
3. Every vector searches its own shard. The distance of the last neighbour
   found there and the triangle inequality (distance to a cell's vantage point
   against the cell's radius, and against the nearest vantage point) rule out
   other shards; only the rest are visited.
4. Lists are merged, expanded to all members of a group and returned.

A bound rules a shard or a branch out if ``bound * relax`` exceeds the distance
of the last neighbour; ``relax = 1`` restores exact search.

Defined results
- a vector is usable if it has the file's ``dim`` components, all finite and
  not all zero; files without a row in the meta table have no usable vectors;
- each chunk id counts once, repeated rows are equal;
- similarity is the cosine rounded to 8 decimals, equal ones go by smaller id;
- a file with at most ``k`` usable vectors gives all its pairs;
- null keys are dropped; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from millrace.session import cut_lineage

K = 10
RELAX = 2.0
CELL, CELL_MAX = 512, 2048
FANOUT = 1024
FIT_ROWS = 16384
LEVELS = 3
ROUTE_ROWS = 32768
VISIT_ROWS = 65536
LEAF = 128
DECIMALS = 8


class VantageTree:
    """A vantage-point tree over unit vectors, searched by batches of queries."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.points, self.ids, self.leaf = points, ids, leaf
        self.root = self._build(np.arange(len(points)), np.random.default_rng(len(points)))

    def _build(self, rows: np.ndarray, rng: np.random.Generator):
        if len(rows) <= self.leaf:
            return rows
        # The candidate whose distances to a sample spread most sees most structure.
        tried = rng.choice(rows, min(8, len(rows)), replace=False)
        against = rng.choice(rows, min(64, len(rows)), replace=False)
        best = tried[int(np.argmax(_distance(self.points[tried] @ self.points[against].T).std(axis=1)))]
        away = _distance(self.points[rows] @ self.points[best])
        order = np.argsort(away, kind="stable")
        middle = len(rows) // 2
        near, far = order[:middle], order[middle:]
        spans = (away[near].min(), away[near].max()), (away[far].min(), away[far].max())
        return best, spans, self._build(rows[near], rng), self._build(rows[far], rng)

    def search(self, queries: np.ndarray, sims: np.ndarray, ids: np.ndarray, relax: float) -> None:
        """Merge the tree's points into the sorted lists ``sims`` and ``ids`` (one row a query), in place."""
        if len(queries) and len(self.points):
            self._visit(self.root, np.arange(len(queries)), queries, sims, ids, relax)

    def _visit(self, node, who, queries, sims, ids, relax) -> None:
        if isinstance(node, np.ndarray):
            found = np.round(queries[who] @ self.points[node].T, DECIMALS)
            hit = (found >= sims[who, -1:]).any(axis=1)
            if not hit.any():
                return
            who, found = who[hit], found[hit]
            both = np.concatenate([sims[who], found], axis=1)
            names = np.concatenate([ids[who], np.broadcast_to(self.ids[node], found.shape)], axis=1)
            order = np.lexsort((names, -both), axis=-1)[:, : sims.shape[1]]
            sims[who] = np.take_along_axis(both, order, axis=1)
            ids[who] = np.take_along_axis(names, order, axis=1)
            return
        centre, spans, near, far = node
        away = _distance(queries[who] @ self.points[centre])
        inner = away <= (spans[0][1] + spans[1][0]) / 2
        branches = ((near, spans[0]), (far, spans[1]))
        # The likelier branch first; then the other one for those it may still serve.
        for first in (0, 1):
            for group, branch in ((inner, branches[first]), (~inner, branches[1 - first])):
                if not group.any():
                    continue
                bound = np.maximum(branch[1][0] - away[group], away[group] - branch[1][1])
                rows = who[group][bound * relax <= reach(sims[who[group], -1])] if first else who[group]
                if len(rows):
                    self._visit(branch[0], rows, queries, sims, ids, relax)


def _distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


def reach(last: np.ndarray) -> np.ndarray:
    """Distance within which a vector may still enter a list whose last similarity is ``last``."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (last - 10.0**-DECIMALS)))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Unit vectors of a list column, in double precision."""
    flat = column.combine_chunks()
    raw = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = raw.reshape(len(flat), -1) if len(flat) else raw.reshape(0, 1)
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def _expanded(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and ids of all kept members of the representatives."""
    lists = table["ids"].combine_chunks()
    counts = np.diff(lists.offsets.to_numpy())
    return np.repeat(_matrix(table["vec"]), counts, axis=0), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _lists(sims: np.ndarray, ids: np.ndarray) -> pa.Array:
    """Lists of ``(sim, id)`` without the empty places."""
    real = np.isfinite(sims)
    offsets = np.concatenate([[0], np.cumsum(real.sum(axis=1))]).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(sims[real]), pa.array(ids[real])], ["sim", "id"])
    return pa.ListArray.from_arrays(pa.array(offsets), pairs)


FOUND = "array<struct<sim:double,id:bigint>>"

_KINDS = {
    "file": pa.string(), "node": pa.string(), "home": pa.string(), "rep": pa.int64(), "vec": pa.list_(pa.float32()), "ids": pa.list_(pa.int64()),
    "last": pa.float64(), "away": pa.float64(), "child": pa.int32(), "centre": pa.list_(pa.float64()),
    "found": pa.list_(pa.struct([("sim", pa.float64()), ("id", pa.int64())])),
}


def _table(columns: list, names: list[str]) -> pa.Table:
    """A table with nullable columns of the declared types, as the result schemas want them."""
    made = pa.table(columns, names)
    return made.cast(pa.schema([(name, _KINDS[name]) for name in names]))


def _search_home(k: int, relax: float) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        points, names = _expanded(table)
        queries = _matrix(table["vec"])
        sims = np.full((len(queries), k + 1), -np.inf)
        ids = np.full((len(queries), k + 1), np.iinfo(np.int64).max)
        VantageTree(points, names).search(queries, sims, ids, relax)
        columns = [table[c] for c in ("file", "node", "rep", "vec", "ids")]
        last = pa.array(np.where(np.isfinite(sims[:, -1]), sims[:, -1], -2.0))
        return _table([*columns, _lists(sims, ids), last], ["file", "node", "rep", "vec", "ids", "found", "last"])

    return run


def _search_visit(k: int, relax: float) -> Callable:
    def run(visits: pa.Table, cell: pa.Table) -> pa.Table:
        if not len(visits) or not len(cell):
            return _table([visits["file"][:0], visits["rep"][:0], _lists(np.empty((0, 1)), np.empty((0, 1), np.int64))], ["file", "rep", "found"])
        points, names = _expanded(cell)
        queries = _matrix(visits["vec"])
        sims = np.full((len(queries), k + 1), -np.inf)
        # A list that is full elsewhere only takes what reaches its last place.
        sims[:, -1] = np.maximum(visits["last"].to_numpy() - 0.5 * 10.0**-DECIMALS, -2.0)
        floor = sims[:, -1].copy()
        sims[:] = floor[:, None]
        ids = np.full((len(queries), k + 1), np.iinfo(np.int64).max)
        VantageTree(points, names).search(queries, sims, ids, relax)
        sims[ids == np.iinfo(np.int64).max] = -np.inf
        some = np.isfinite(sims).any(axis=1)
        keep = pa.array(some)
        return _table([visits["file"].filter(keep), visits["rep"].filter(keep), _lists(sims[some], ids[some])], ["file", "rep", "found"])

    return run


def _fit(table: pa.Table) -> pa.Table:
    """Vantage points of one node, from its sample: spread-out choices, then a few rounds of averaging."""
    points = _matrix(table["vec"])
    n, wanted = len(points), min(FANOUT, -(-table["n"][0].as_py() // CELL))
    rng = np.random.default_rng(n)
    chosen = [int(rng.integers(n))]
    gap = 2.0 - 2.0 * points @ points[chosen[0]]
    for _ in range(min(wanted, n) - 1):
        gap = np.maximum(gap, 0.0)
        if gap.sum() <= 0:
            break
        chosen.append(int(rng.choice(n, p=gap / gap.sum())))
        gap = np.minimum(gap, 2.0 - 2.0 * points @ points[chosen[-1]])
    centres = points[chosen]
    for _ in range(4):
        home = np.argmax(points @ centres.T, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, home, points)
        size = np.sqrt((total * total).sum(axis=1))
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1e-300)[:, None], centres)
    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, centres.size + 1, centres.shape[1], dtype=np.int32)), pa.array(centres.ravel()))
    return _table([pa.array([table["node"][0].as_py()] * len(centres)), pa.array(np.arange(len(centres), dtype=np.int32)), flat], ["node", "child", "centre"])


def _assign(points: pa.Table, router: pa.Table) -> pa.Table:
    names = ["file", "node", "rep", "vec", "ids", "away"]
    if not len(points):
        return _table([points["file"], points["node"], points["rep"], points["vec"], points["ids"], pa.array([], pa.float64())], names)
    cosine = _matrix(points["vec"]) @ _matrix(router["centre"]).T
    home = np.argmax(cosine, axis=1)
    child = router["child"].to_numpy()[home]
    node = pa.array([f"{a}\x1f{b}" for a, b in zip(points["node"].to_pylist(), child.tolist())])
    away = _distance(cosine[np.arange(len(home)), home])
    return _table([points["file"], node, points["rep"], points["vec"], points["ids"], pa.array(away)], names)


def _route(relax: float) -> Callable:
    def run(asking: pa.Table, router: pa.Table) -> pa.Table:
        names = ["file", "node", "rep", "home", "vec", "last"]
        if not len(asking) or not len(router):
            return _table([asking[c][:0] for c in names], names)
        away = _distance(_matrix(asking["vec"]) @ _matrix(router["centre"]).T)
        radius = router["radius"].to_numpy()
        bound = np.maximum(away - radius, (away - away.min(axis=1, keepdims=True)) / 2)
        who, where = np.nonzero(bound * relax <= reach(asking["last"].to_numpy())[:, None])
        children = router["path"].to_pylist()
        target = np.array(children, dtype=object)[where]
        homes = np.array(asking["home"].to_pylist(), dtype=object)[who]
        other = target != homes
        rows = pa.array(who[other])
        out = {c: asking[c].take(rows) for c in names}
        out["node"] = pa.array(target[other].tolist(), pa.string())
        return _table([out[c] for c in names], names)

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable rows of ``(file, chunk_id, vec, dim)`` with a 128-bit key of their direction."""
    import xxhash

    names = ["file", "chunk_id", "vec", "k1", "k2"]
    for batch in batches:
        vectors, dims = batch.column("vec"), batch.column("dim").to_numpy()
        sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
        for dim in np.unique(dims):
            rows = np.flatnonzero((dims == dim) & (sizes == dim))
            if not dim or not len(rows):
                continue
            raw = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)
            good = np.isfinite(raw).all(axis=1) & (raw != 0).any(axis=1)
            rows, raw = rows[good], raw[good]
            unit = np.round(raw / np.sqrt((raw * raw).sum(axis=1))[:, None], 10) + 0.0
            keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in unit), dtype="<i8").reshape(-1, 2)
            kept = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([kept.column("file"), kept.column("chunk_id"), kept.column("vec"), pa.array(keys[:, 0]), pa.array(keys[:, 1])], names)


def usable_vectors(vectors: DataFrame, meta: DataFrame) -> DataFrame:
    """``(file, chunk_id, vec, k1, k2)``: usable rows, with a 128-bit key of the direction."""
    dims = meta.where(F.col("vector_file").isNotNull() & F.col("dim").isNotNull()).groupBy("vector_file").agg(F.max("dim").alias("dim"))
    rows = vectors.select("vector_file", "chunk_id", F.col("embedding").alias("vec")).where(F.col("vec").isNotNull() & F.col("chunk_id").isNotNull())
    rows = rows.join(dims, "vector_file").select(F.col("vector_file").alias("file"), "chunk_id", "vec", "dim")
    return rows.mapInArrow(_keyed, "file string, chunk_id bigint, vec array<float>, k1 bigint, k2 bigint")


def _representatives(usable: DataFrame, k: int) -> DataFrame:
    """``(file, k1, k2, rep, vec, ids)``: one row per direction, with its ``k + 1`` smallest ids.

    Both branches end hash-partitioned by the same keys, so the join adds no
    shuffle; only one of them carries vectors, after a map-side combine.
    """
    group = ("file", "k1", "k2")
    least = Window.partitionBy(*group).orderBy("chunk_id")
    few = usable.select(*group, "chunk_id").distinct().withColumn("rank", F.row_number().over(least)).where(F.col("rank") <= k + 1)
    ids = few.groupBy(*group).agg(F.array_sort(F.collect_list("chunk_id")).alias("ids"))
    heads = usable.groupBy(*group).agg(F.min_by("vec", "chunk_id").alias("vec"))
    return heads.join(ids, list(group)).withColumn("rep", F.col("ids")[0])


def _salted(rows: DataFrame, large: DataFrame, by: str) -> DataFrame:
    return rows.join(large.select(F.col("node").alias("at"), "salts"), rows[by] == F.col("at")).withColumn(
        "salt", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int")
    )


def neighbour_lists(vectors: DataFrame, meta: DataFrame, k: int = K, relax: float = RELAX) -> DataFrame:
    """``(vector_file, chunk_id, neighbours)``: the ``k`` most similar chunks of every usable chunk, best first.

    ``neighbours`` is an array of ``(sim, id)``.
    """
    usable = usable_vectors(vectors, meta)
    points = _representatives(usable, k).withColumn("node", F.col("file"))
    keys = cut_lineage(points)
    points = keys.select("file", "node", "rep", "vec", "ids")
    routers: list[tuple[DataFrame, DataFrame]] = []
    for _ in range(LEVELS):
        large = points.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > CELL_MAX)
        large = cut_lineage(large.withColumn("salts", F.ceil(F.col("n") / ROUTE_ROWS)))
        if large.isEmpty():
            break
        sample = points.join(large.select("node", "n"), "node").select("node", "n", "vec", F.xxhash64("rep").alias("spot"))
        near = Window.partitionBy("node").orderBy("spot")
        sample = sample.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= FIT_ROWS).select("node", "n", "vec")
        centres = cut_lineage(sample.groupBy("node").applyInArrow(_fit, "node string, child int, centre array<double>"))
        spread = centres.join(large.select("node", "salts"), "node").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts").cast("int") - 1)))
        here = _salted(points, large, "node")
        cells = here.groupBy("at", "salt").cogroup(spread.select(F.col("node").alias("at"), "salt", "child", "centre").groupBy("at", "salt")).applyInArrow(
            _assign, "file string, node string, rep bigint, vec array<float>, ids array<bigint>, away double"
        )
        rest = points.join(large, "node", "left_anti").withColumn("away", F.lit(None).cast("double"))
        points = cut_lineage(rest.select("file", "node", "rep", "vec", "ids", "away").unionByName(cells))
        radii = points.where(F.col("away").isNotNull()).groupBy("node").agg(F.max("away").alias("radius"))
        path = F.concat_ws("\x1f", "node", F.col("child").cast("string"))
        bounded = spread.select(F.col("node").alias("at"), "salt", "centre", path.alias("path")).join(radii.withColumnRenamed("node", "path"), "path")
        routers.append((large, cut_lineage(bounded)))
        points = points.drop("away")
    schema = f"file string, node string, rep bigint, vec array<float>, ids array<bigint>, found {FOUND}, last double"
    home = cut_lineage(points.groupBy("node").applyInArrow(_search_home(k, relax), schema))
    lists = home.select("file", "rep", "ids", "found")
    asking = home.select("file", F.col("file").alias("node"), "rep", F.col("node").alias("home"), "vec", "last")
    visited = None
    for level, (large, router) in enumerate(routers):
        here = _salted(asking, large, "node").select("at", "salt", "file", "node", "rep", "home", "vec", "last")
        asking = here.groupBy("at", "salt").cogroup(router.groupBy("at", "salt")).applyInArrow(
            _route(relax), "file string, node string, rep bigint, home string, vec array<float>, last double"
        )
        ends = asking if level + 1 == len(routers) else asking.join(routers[level + 1][0].select("node"), "node", "left_anti")
        visited = ends if visited is None else visited.unionByName(ends)
    if visited is not None:
        cells = home.select("node", "vec", "ids")
        # Visits of one cell are spread by the visitors' own cells, a cell going to the places that ask for it.
        most = routers[0][0].agg(F.max("n")).first()[0]
        places = max(1, -(-most // VISIT_ROWS))
        visits = visited.withColumn("place", F.pmod(F.xxhash64("home"), F.lit(places)).cast("int"))
        if places > 1:
            cells = cells.join(visits.select("node", "place").distinct(), "node")
        else:
            cells = cells.withColumn("place", F.lit(0))
        more = visits.groupBy("node", "place").cogroup(cells.groupBy("node", "place")).applyInArrow(
            _search_visit(k, relax), f"file string, rep bigint, found {FOUND}"
        )
        lists = lists.unionByName(more.withColumn("ids", F.lit(None).cast("array<bigint>")))
    order = F.transform(F.flatten(F.collect_list("found")), lambda x: F.struct((-x["sim"]).alias("minus"), x["id"].alias("id")))
    merged = lists.groupBy("file", "rep").agg(F.max("ids").alias("ids"), order.alias("all"))
    merged = merged.withColumn("best", F.slice(F.array_sort(F.array_distinct("all")), 1, k + 1)).select("file", "rep", "ids", "best")
    own = merged.select("file", F.explode("ids").alias("chunk_id"), "best")
    # Members of a group beyond its k + 1 smallest ids share its list.
    groups = merged.where(F.size("ids") == k + 1).join(keys.select("file", "rep", "k1", "k2"), ["file", "rep"])
    later = usable.select("file", "k1", "k2", "chunk_id").distinct().join(groups, ["file", "k1", "k2"])
    later = later.where(F.col("chunk_id") > F.element_at("ids", -1)).select("file", "chunk_id", "best")
    mine = own.unionByName(later)
    others = F.slice(F.filter("best", lambda x: x["id"] != F.col("chunk_id")), 1, k)
    return mine.select(
        F.col("file").alias("vector_file"), "chunk_id", F.transform(others, lambda x: F.struct((-x["minus"]).alias("sim"), x["id"].alias("id"))).alias("neighbours")
    )


def similar_pairs(vectors: DataFrame, meta: DataFrame, k: int = K, relax: float = RELAX) -> DataFrame:
    """``(chunk_id_a, chunk_id_b)``: pairs of which at least one is among the other's neighbours, once each."""
    edges = neighbour_lists(vectors, meta, k, relax).select("chunk_id", F.explode("neighbours.id").alias("other"))
    return edges.select(F.least("chunk_id", "other").alias("chunk_id_a"), F.greatest("chunk_id", "other").alias("chunk_id_b")).distinct()
