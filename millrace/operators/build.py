"""Building a generation of an index: chunks, vectors by a cache, numbers, report, and what is pruned afterwards.

An encoder is whatever has a ``recipe`` and turns ``(digest, input)`` rows into
vectors; the hashed one below needs no model.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, functions as F

from millrace.functions import text as T
from millrace.operators import index
from millrace.operators.analysis import DIM, analyse
from millrace.operators.chunking import chunk_files
from millrace.session import cut_lineage

INPUT_BYTES, KEEP_GENERATIONS, CACHE_BYTES = 1800, 2, 256 * 1024 * 1024


class Encoder(Protocol):
    recipe: str
    dim: int

    def encode(self, inputs: DataFrame) -> DataFrame:
        """``(digest, vector)`` of ``(digest, input)``."""


@dataclass(frozen=True)
class HashedEncoder:
    """Hashed token counts of unit length."""

    dim: int = DIM
    fingerprint: str = "hashed-tokens"

    @property
    def recipe(self) -> str:
        return f"{self.fingerprint}|search_document|dim{self.dim}|v1"

    def encode(self, inputs: DataFrame) -> DataFrame:
        made = analyse(inputs.select(F.col("digest").alias("id"), "input"), ("input",), dim=self.dim, counted=False)
        return made.select(F.col("id").alias("digest"), F.col("vec").alias("vector"))


@dataclass
class Build:
    """What a build leaves: tables to be written by the caller, generation by generation."""

    generations: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    cache: DataFrame
    manifest: DataFrame
    reports: DataFrame


def build_index(files: DataFrame, generations: DataFrame, cache: DataFrame, encoder: Encoder, now, progress: Callable[[str], None] = lambda stage: None) -> Build:
    """A new generation of every repository in ``files (repo_id, path, size, mtime_ns, text, skip_reason)``.

    ``generations`` as in ``index``, ``cache (recipe, digest, vector, bytes,
    last_used)``. Only digests that the cache lacks are encoded, each once; the
    count of those is ``embedded_new``, all other chunks count as cached. The
    cache is then cut to its budget, and generations to the newest two.

    Chunks and encoded vectors are written to the checkpoint folder, since the
    report, the numbers and the vectors read them; texts are read once.
    """
    progress("chunk")
    readable = files.where(F.col("skip_reason").isNull() & F.col("text").isNotNull())
    keyed = readable.select(F.to_json(F.struct("repo_id", "path")).alias("key"), "path", "text")
    made = chunk_files(keyed, "key").withColumn("repo_id", F.get_json_object("key", "$.repo_id")).drop("key")
    made = made.withColumn("input", T.byte_cut(F.concat_ws("\n", "path", "content"), INPUT_BYTES))
    requests = files.select("repo_id").distinct().select("repo_id", F.concat(F.col("repo_id"), F.lit(".vectors")).alias("vector_file"), F.lit(encoder.recipe).alias("recipe"), F.lit(now).alias("created_at"))
    begun = index.begin_generation(generations, requests)
    fresh = begun.join(files.select("repo_id").distinct(), "repo_id", "left_semi").groupBy("repo_id").agg(F.max("generation").alias("generation"))
    progress("number")
    chunks = cut_lineage(index.number_rows(made.join(fresh, "repo_id"), ["repo_id", "path", "start_line"], "id"))
    progress("encode")
    held = cache.where(F.col("recipe") == encoder.recipe).select("digest").distinct()
    inputs = chunks.groupBy("digest").agg(F.first("input").alias("input")).join(held, "digest", "left_anti")
    encoded = cut_lineage(encoder.encode(inputs))
    size = (F.size("vector") * 4).cast("bigint")
    new = encoded.select(F.lit(encoder.recipe).alias("recipe"), "digest", F.col("vector").cast("array<double>").alias("vector"), size.alias("bytes"), F.lit(now).alias("last_used"))
    _, touched = index.read_cache(cache, chunks.select(F.lit(encoder.recipe).alias("recipe"), "digest"), now)
    whole = touched.unionByName(new)
    vectors = chunks.select("repo_id", "generation", "id", "digest").join(whole.where(F.col("recipe") == encoder.recipe).select("digest", "vector"), "digest")
    progress("report")
    firsts = chunks.groupBy("repo_id", "digest").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    # A digest that several repositories bring is new in the one with the lowest chunk, cached in the others.
    brought = firsts.join(encoded.select("digest", F.lit(1).alias("new")), "digest", "left")
    lowest = brought.groupBy("digest").agg(F.min("id").alias("lowest"))
    counts = brought.join(lowest, "digest").groupBy("repo_id").agg(
        F.sum("n").alias("chunks"), F.coalesce(F.sum(F.when(F.col("id") == F.col("lowest"), F.col("new"))), F.lit(0)).cast("bigint").alias("embedded_new")
    )
    seen = files.groupBy("repo_id").agg(
        F.count("*").alias("files_seen"), F.count_if(F.col("skip_reason").isNull() & F.col("text").isNotNull()).alias("files_indexed"),
        F.array_sort(F.collect_list(F.when(F.col("skip_reason").isNotNull(), F.struct("path", F.col("skip_reason").alias("reason"))))).alias("files_skipped"),
    )
    zero = F.lit(0).cast("bigint")
    reports = seen.join(counts, "repo_id", "left").join(fresh, "repo_id").select(
        "repo_id", "generation", "files_seen", "files_indexed", "files_skipped", F.coalesce("chunks", zero).alias("chunks"), F.coalesce("embedded_new", zero).alias("embedded_new"),
        (F.coalesce("chunks", zero) - F.coalesce("embedded_new", zero)).alias("embedded_cached"),
    )
    done = reports.select("repo_id", "generation", F.lit(now).alias("finished_at"), F.col("chunks").alias("chunk_count"))
    finished, _ = index.finish_generation(begun, done)
    progress("prune")
    kept = index.prune_generations(finished, KEEP_GENERATIONS)
    manifest = files.where(~F.coalesce(F.col("skip_reason").isin("symlink", "secret"), F.lit(False))).join(fresh, "repo_id").select("repo_id", "generation", "path", "size", "mtime_ns")
    trimmed = index.evict_lru(whole.withColumn("used_at", F.timestamp_millis(F.col("last_used").cast("bigint"))), "digest", "used_at", "bytes", CACHE_BYTES).select(*cache.columns)
    return Build(kept, chunks.drop("input"), vectors, trimmed, manifest, reports)


def guard(generations: DataFrame, encoder_recipe: str) -> DataFrame:
    """``(repo_id, generation, error)``: the latest finished generation of each repository, and ``recipe`` where another encoder made it."""
    latest = index.latest_generation(generations)
    return latest.select("repo_id", "generation", F.when(~F.col("recipe").eqNullSafe(F.lit(encoder_recipe)), "recipe").alias("error"))
