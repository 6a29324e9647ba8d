"""Line-level scans over texts: search, reading ranges, listing folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from millrace.functions import text as T

HIT_BYTES, SEARCH_BYTES = 400, 512 * 1024


def numbered_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns but the text, and ``(line_no, line)`` from 1."""
    keep = [c for c in docs.columns if c != text_col]
    return docs.where(F.col(text_col).isNotNull()).select(*keep, F.posexplode(T.lines(F.col(text_col))).alias("at", "line")).select(
        *keep, (F.col("at") + 1).alias("line_no"), "line"
    )


def search_lines(docs: DataFrame, needle: str, ignore_case: bool = False, text_col: str = "text") -> DataFrame:
    """Lines that contain ``needle`` literally; whole texts are tested before they are split."""
    if not needle:
        return numbered_lines(docs, text_col).where(F.lit(False)).withColumn("hit", F.col("line")).drop("line")
    look = (lambda c: F.lower(c).contains(needle.lower())) if ignore_case else (lambda c: c.contains(needle))
    found = numbered_lines(docs.where(look(F.col(text_col))), text_col).where(look(F.col("line")))
    return found.withColumn("hit", T.byte_cut(F.col("line"), HIT_BYTES)).drop("line")


def search_report(files: DataFrame, needle: str, max_hits: int, ignore_case: bool = False, max_bytes: int = SEARCH_BYTES) -> DataFrame:
    """One row ``(hits, truncated, files_scanned, files_skipped)`` of a search over ``files (path, text)`` that stops after ``max_hits``.

    Files are visited in the order of their path's parts. Those with an
    excluded name are not seen; those over ``max_bytes`` or with a zero byte
    are skipped. The search ends at the first hit too many, and the counters
    are of the files visited until then, that one's included. The end is a
    distributed top-k; nothing is ordered as a whole.
    """
    seen = files.where(F.col("path").isNotNull() & ~T.is_hidden_from_tools(F.col("path"))).select(F.split("path", "/").alias("parts"), F.coalesce("text", F.lit("")).alias("text"))
    skipped = (F.octet_length("text") > max_bytes) | (F.instr("text", "\x00") > 0)
    rows = seen.withColumn("skipped", skipped)
    found = search_lines(rows.where(~F.col("skipped")).select("parts", "text"), needle, ignore_case)
    first = found.select("parts", "line_no").orderBy("parts", "line_no").limit(max_hits + 1)
    end = first.agg(F.count("*").alias("found"), F.max(F.struct("parts", "line_no")).alias("last"))
    end = end.select(F.least("found", F.lit(max_hits)).cast("bigint").alias("hits"), (F.col("found") > max_hits).alias("truncated"), F.when(F.col("found") > max_hits, F.col("last.parts")).alias("stop"))
    visited = rows.select("parts", "skipped").crossJoin(F.broadcast(end)).where(F.col("stop").isNull() | (F.col("parts") <= F.col("stop")))
    counts = visited.agg(F.count_if(~F.col("skipped")).alias("files_scanned"), F.count_if("skipped").alias("files_skipped"))
    return end.select("hits", "truncated").crossJoin(counts)


def read_ranges(docs: DataFrame, key: str, first: int, last: int, max_bytes: int, text_col: str = "text") -> DataFrame:
    """Lines ``first``..``last`` (1-based, 0 for either end) of each text, whole lines within ``max_bytes``.

    A first line over the cap by itself is cut; ``truncated`` says whether anything was left out.
    """
    rows = docs.where(F.col(text_col).isNotNull()).select(key, T.lines(F.col(text_col)).alias("lines"), F.sha2(F.col(text_col), 256).alias("sha256"))
    total = F.size("lines")
    low = F.greatest(F.lit(first), F.lit(1))
    high = F.least(total, F.lit(last)) if last else total
    rows = rows.withColumn("part", F.when(high >= low, F.slice("lines", low, F.greatest(high - low + 1, F.lit(0)))).otherwise(F.array().cast("array<string>")))
    sizes = F.transform("part", lambda x: F.octet_length(x))
    state = F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("taken"), F.lit(True).alias("going"))

    def step(s, size):
        need = s["bytes"] + size + F.when(s["taken"] > 0, 1).otherwise(0)
        fits = s["going"] & (need <= max_bytes)
        return F.struct(F.when(fits, need).otherwise(s["bytes"]).alias("bytes"), (s["taken"] + fits.cast("int")).alias("taken"), fits.alias("going"))

    rows = rows.withColumn("taken", F.aggregate(sizes, state, step)["taken"])
    alone = (F.col("taken") == 0) & (F.size("part") > 0)
    content = F.when(alone, T.byte_cut(F.col("part")[0], max_bytes)).otherwise(F.array_join(F.slice("part", 1, F.col("taken")), "\n"))
    return rows.select(key, content.alias("content"), total.alias("total_lines"), (F.col("taken") < F.size("part")).alias("truncated"), "sha256")


def list_folder(files: DataFrame, max_entries: int) -> DataFrame:
    """``(repo_id, folder, name, is_folder, truncated)``: the sorted entries of every folder.

    Excluded names are dropped; of a folder with more than ``max_entries`` only
    the first ones are listed, and it is marked.
    """
    parts = F.split(F.col("path"), "/")
    rows = files.where(F.col("path").isNotNull() & ~T.is_secret(F.col("path")) & ~T.in_pruned_dir(F.col("path"))).select("repo_id", parts.alias("parts")).distinct()
    spread = rows.select("repo_id", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"))
    entries = spread.select(
        "repo_id", F.array_join(F.slice("parts", 1, F.col("depth") - 1), "/").alias("folder"), F.get("parts", F.col("depth") - 1).alias("name"),
        (F.col("depth") < F.size("parts")).alias("is_folder"),
    ).distinct()
    order = Window.partitionBy("repo_id", "folder").orderBy("name", "is_folder")
    sizes = entries.groupBy("repo_id", "folder").agg((F.count("*") > max_entries).alias("truncated"))
    first = entries.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_entries).drop("rank")
    return first.join(sizes, ["repo_id", "folder"])
