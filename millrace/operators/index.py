"""Keeping an index current: manifests, generations, an embedding cache, citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from millrace.functions import text as T
from millrace.session import cut_lineage


def changed_files(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(repo_id, path, change)``: added, modified or removed between two ``(repo_id, path, size, mtime_ns)`` lists."""
    new = current.select("repo_id", "path", F.struct("size", "mtime_ns").alias("now"), F.lit(True).alias("is_now"))
    old = manifest.select("repo_id", "path", F.struct("size", "mtime_ns").alias("then"), F.lit(True).alias("was"))
    both = new.join(old, ["repo_id", "path"], "full_outer")
    change = (
        F.when(F.col("was").isNull(), "added").when(F.col("is_now").isNull(), "removed").when(~F.col("now").eqNullSafe(F.col("then")), "modified")
    )
    return both.select("repo_id", "path", change.alias("change")).where(F.col("change").isNotNull())


def unchanged_repos(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(repo_id, unchanged)`` of every repository of either list: a refresh is a no-op where it is true."""
    repos = current.select("repo_id").union(manifest.select("repo_id")).distinct()
    touched = changed_files(current, manifest).select("repo_id").distinct().withColumn("touched", F.lit(True))
    return repos.join(touched, "repo_id", "left").select("repo_id", F.col("touched").isNull().alias("unchanged"))


def latest_generation(generations: DataFrame) -> DataFrame:
    """The newest finished generation of each repository."""
    done = generations.where(F.col("finished_at").isNotNull())
    rest = [c for c in generations.columns if c not in ("repo_id", "generation")]
    best = done.groupBy("repo_id").agg(F.max(F.struct("generation", *rest)).alias("best"))
    return best.select("repo_id", "best.*")


def prune_generations(generations: DataFrame, keep: int) -> DataFrame:
    """Generations that stay: the newest ``keep`` finished ones, and unfinished ones newer than the latest finished."""
    done = F.col("finished_at").isNotNull()
    ranked = generations.withColumn("rank", F.row_number().over(Window.partitionBy("repo_id", done).orderBy(F.col("generation").desc())))
    ranked = ranked.withColumn("latest", F.max(F.when(done, F.col("generation"))).over(Window.partitionBy("repo_id")))
    stays = F.when(done, F.col("rank") <= keep).otherwise(F.col("latest").isNull() | (F.col("generation") > F.col("latest")))
    return ranked.where(stays).drop("rank", "latest")


def next_generation(generations: DataFrame) -> DataFrame:
    return generations.groupBy("repo_id").agg((F.coalesce(F.max("generation"), F.lit(0)) + 1).alias("next_generation"))


def begin_generation(generations: DataFrame, requests: DataFrame) -> DataFrame:
    """``generations`` with an unfinished one more for every ``(repo_id, vector_file, recipe, created_at)``, numbered after the repository's last."""
    last = generations.groupBy("repo_id").agg(F.max("generation").alias("last"))
    new = requests.join(last, "repo_id", "left").withColumn("generation", F.coalesce("last", F.lit(0)) + 1).drop("last")
    return generations.unionByName(new.select(*(c for c in generations.columns if c in new.columns)), allowMissingColumns=True)


def finish_generation(generations: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Generations with ``finished_at`` and ``chunk_count`` of ``done (repo_id, generation, ...)``, and the keys of ``done`` that aren't there."""
    from millrace.operators.store import not_found, set_fields

    keys = ["repo_id", "generation"]
    return set_fields(generations, keys, done.select(*keys, "finished_at", "chunk_count")), not_found(generations, keys, done)


def number_rows(rows: DataFrame, order: list[str], column: str, start: int = 1) -> DataFrame:
    """``rows`` with consecutive numbers from ``start`` in the given order.

    Rows are sorted by ranges and written once; every range then counts on
    from the sizes of those before it. No task sees all rows.
    """
    import itertools

    import pyarrow as pa
    from pyspark import TaskContext
    from pyspark.sql.types import LongType, StructField, StructType

    placed = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    sizes = {r.part: r.n for r in placed.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).collect()}
    parts = range(max(sizes, default=0) + 1)
    first = dict(zip(parts, itertools.accumulate((sizes.get(p, 0) for p in parts), initial=start)))

    def run(batches):
        at = first.get(TaskContext.get().partitionId(), start)
        for batch in batches:
            yield batch.append_column(column, pa.array(range(at, at + len(batch)), pa.int64()))
            at += len(batch)

    return placed.mapInArrow(run, StructType([*placed.schema.fields, StructField(column, LongType())]))


def find_by_digest(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Chunks ``(repo_id, generation, id, digest)`` with the digests of ``wanted (repo_id, digest)`` in any generation, with ``place``: newest first, then by id."""
    order = Window.partitionBy("repo_id", "digest").orderBy(F.col("generation").desc(), "id")
    return chunks.join(wanted.select("repo_id", "digest").distinct(), ["repo_id", "digest"], "left_semi").withColumn("place", F.row_number().over(order))


def refresh_reason(repos: DataFrame, current: DataFrame, manifest: DataFrame, generations: DataFrame, files: DataFrame, recipe: str) -> DataFrame:
    """``(repo_id, reason)``: why each of ``repos (repo_id)`` has to be indexed again; null where a refresh has nothing to do.

    The manifest ``(repo_id, generation, path, size, mtime_ns)`` must be of the
    latest finished generation, that one made by ``recipe`` and its vector file
    among ``files (vector_file)``, and the manifest must list the ``current``
    files. Reasons in this order: no_index, recipe, generation, missing_file,
    files.
    """
    latest = latest_generation(generations).select("repo_id", "generation", F.col("recipe").alias("made_by"), "vector_file")
    held = manifest.groupBy("repo_id").agg(F.max("generation").alias("listed"))
    there = files.select("vector_file").distinct().withColumn("there", F.lit(True))
    same = unchanged_repos(current, manifest.select("repo_id", "path", "size", "mtime_ns"))
    rows = repos.select("repo_id").distinct().join(latest, "repo_id", "left").join(held, "repo_id", "left").join(there, "vector_file", "left").join(same, "repo_id", "left")
    reason = (
        F.when(F.col("generation").isNull(), "no_index").when(~F.col("made_by").eqNullSafe(F.lit(recipe)), "recipe").when(~F.col("listed").eqNullSafe(F.col("generation")), "generation")
        .when(F.col("there").isNull(), "missing_file").when(~F.coalesce("unchanged", F.lit(False)), "files")
    )
    return rows.select("repo_id", reason.alias("reason"))


def evict_lru(entries: DataFrame, key: str, used: str, size: str, budget: int) -> DataFrame:
    """Entries that stay within ``budget`` bytes, the most recently used first; a later ``key`` is more recent.

    The running sum is taken in three steps, over days, over the minutes of a
    day and over the rows of a minute; days and minutes behind the budget's end
    are left out before their rows are sorted. Entries never used are the oldest.
    """
    rows = entries.withColumn("day", F.coalesce(F.date_trunc("day", F.col(used)), F.lit("0001-01-01").cast("timestamp_ntz").cast(entries.schema[used].dataType)))
    rows = rows.withColumn("minute", F.coalesce(F.date_trunc("minute", F.col(used)), F.col("day")))
    minutes = rows.groupBy("day", "minute").agg(F.sum(size).alias("bytes"))
    days = minutes.groupBy("day").agg(F.sum("bytes").alias("bytes"))
    before_day = Window.orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("day", F.coalesce(F.sum("bytes").over(before_day), F.lit(0)).alias("newer_days")).where(F.col("newer_days") <= budget)
    before_minute = Window.partitionBy("day").orderBy(F.col("minute").desc()).rowsBetween(Window.unboundedPreceding, -1)
    minutes = minutes.join(days, "day").select("day", "minute", (F.col("newer_days") + F.coalesce(F.sum("bytes").over(before_minute), F.lit(0))).alias("newer")).where(F.col("newer") <= budget)
    inside = Window.partitionBy("day", "minute").orderBy(F.col(used).desc(), F.col(key).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = rows.join(minutes, ["day", "minute"]).withColumn("running", F.col("newer") + F.sum(size).over(inside))
    return kept.where(F.col("running") <= budget).drop("day", "minute", "newer")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key; of several new rows of a key the greatest one."""
    rest = [c for c in old.columns if c not in keys]
    both = old.withColumn("__age", F.lit(0)).unionByName(new.select(*old.columns).withColumn("__age", F.lit(1)))
    best = both.groupBy(*keys).agg(F.max(F.struct("__age", *rest)).alias("best"))
    return best.select(*keys, *(F.col(f"best.{c}").alias(c) for c in rest)).select(*old.columns)


def cache_lookup(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """``wanted`` with ``hit``: whether the cache holds its ``(recipe, digest)``."""
    held = cache.select("recipe", "digest").distinct().withColumn("hit", F.lit(True))
    return wanted.join(held, ["recipe", "digest"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def read_cache(cache: DataFrame, wanted: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """``wanted (recipe, digest)`` with the cache's ``vector`` or null, and the cache with ``last_used`` of every hit raised to ``now``."""
    keys = ["recipe", "digest"]
    asked = wanted.select(*keys).distinct().withColumn("asked", F.lit(True))
    found = wanted.join(cache.select(*keys, "vector"), keys, "left")
    touched = cache.join(asked, keys, "left").withColumn("last_used", F.when(F.col("asked"), F.greatest("last_used", F.lit(now))).otherwise(F.col("last_used")))
    return found, touched.select(*cache.columns)


SPANS = 256


def verify_citations(citations: DataFrame, files: DataFrame, spans: int = SPANS) -> DataFrame:
    """Citations with ``status`` and ``detail`` against the current files.

    A file that is gone is ``missing``; a range outside the file, or a digest
    that differs, is ``file_changed``; otherwise ``verified``. Of a path with
    several texts, one that verifies is enough.

    Citations of one file are put in groups of about ``spans`` different spans,
    as many as the file needs; a group takes the text once and splits it once.
    What goes back to the citations is one narrow row a span.
    """
    keys, span = ["repo_id", "path"], ["start_line", "end_line", "digest_hex"]
    texts = files.where(F.col("path").isNotNull()).select(*keys, "text").distinct()
    different = citations.select(*keys, *span).distinct()
    sizes = different.groupBy(*keys).agg(F.ceil(F.count("*") / spans).alias("groups"))
    spread = different.join(sizes, keys).withColumn("group", F.pmod(F.xxhash64(*span), F.col("groups")))
    groups = spread.groupBy(*keys, "group").agg(F.collect_list(F.struct(*span)).alias("spans"))
    split = groups.join(texts, keys).withColumn("lines", T.lines(F.coalesce("text", F.lit(""))))
    judged = split.select(*keys, F.size("lines").alias("total"), F.col("text").isNull().alias("empty"), F.explode("spans").alias("x"), "lines").select(*keys, "total", "empty", "x.*", "lines")
    outside = F.coalesce((F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")) | (F.col("end_line") > F.col("total")), F.lit(True)) | F.col("empty")
    body = F.array_join(F.slice("lines", F.col("start_line").cast("int"), (F.col("end_line") - F.col("start_line") + 1).cast("int")), "\n")
    same = T.chunk_digest(F.col("path"), F.col("start_line"), T.byte_cut(body, 2400)) == F.col("digest_hex")
    judged = judged.select(*keys, *span, "total", outside.alias("outside"), F.when(~outside, F.coalesce(same, F.lit(False))).otherwise(F.lit(False)).alias("same"))
    best = judged.groupBy(*keys, *span).agg(F.max(F.struct("same", ~F.col("outside"), "total")).alias("x"), F.lit(True).alias("there"))
    best = best.select(*(F.col(c).alias(f"__{c}") for c in (*keys, *span)), "there", F.col("x.same").alias("same"), F.col("x.col2").alias("within"), F.col("x.total").alias("total"))
    on = [citations[c].eqNullSafe(best[f"__{c}"]) for c in (*keys, *span)]
    status = F.when(F.col("there").isNull(), "missing").when(F.col("same"), "verified").otherwise("file_changed")
    detail = (
        F.when(F.col("there") & ~F.col("within"), F.concat(F.lit("file now has "), F.col("total").cast("string"), F.lit(" lines")))
        .when(F.col("there") & ~F.col("same"), F.concat(F.lit("lines "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit(" changed")))
    )
    return citations.join(best, on, "left").select(*(citations[c] for c in citations.columns), status.alias("status"), detail.alias("detail"))


def pack_context(hits: DataFrame, max_bytes: int, header: str, footer: str) -> DataFrame:
    """``(query_id, n_hits, bytes, text)``: hits in rank order until the next would pass ``max_bytes``.

    Each entry is a numbered heading and the fenced content; the first one
    that does not fit ends the packing. ``hits`` is a ranked list and so bounded by its k.
    """
    mark = T.fence(F.col("content"))
    defused = F.replace("content", F.lit(footer), F.lit("[end]"))
    entry = F.concat(F.lit("\n["), F.col("rank").cast("string"), F.lit("] "), F.col("path"), F.lit("\n"), mark, T.fence_tag(F.col("path")), F.lit("\n"), defused, F.lit("\n"), mark, F.lit("\n"))
    running = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = hits.withColumn("entry", entry).withColumn("sum", F.sum(F.octet_length("entry")).over(running))
    frame = len((header + footer).encode())
    fits = F.col("sum") + frame <= max_bytes
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(fits, F.struct("rank", "entry")))), lambda x: x["entry"]), "")
    packed = rows.groupBy("query_id").agg(F.count_if(fits).alias("n_hits"), F.concat(F.lit(header), body, F.lit(footer)).alias("text"))
    return packed.withColumn("bytes", F.octet_length("text"))
