"""Reading a folder of files as a corpus, and the binary vector index format."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.functions import text as T
from millrace.session import cut_lineage
from millrace.sources.fnv import fnv1a64

MAX_FILE_BYTES, SNIFF_BYTES = 512 * 1024, 8192


def _opened(root: str):
    """The file system of a folder (local, or any that Arrow knows by its address) and the folder's name in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root else os.path.abspath(root.removeprefix("file:")))


def _listed(root: str):
    """Entries of folders ``(folder)``, of names and sizes only. Links aren't followed; what can't be read is told."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = _opened(root)
        local = isinstance(system, fs.LocalFileSystem)
        real = os.path.realpath(base) if local else base
        for frame in frames:
            out = []
            for folder in frame["folder"]:
                try:
                    entries = system.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"), allow_not_found=True))
                except OSError:
                    out.append((folder.rstrip("/"), False, 0, 0, "unreadable"))
                    continue
                for entry in entries:
                    name, reason = folder + entry.base_name, None
                    if local and os.path.islink(entry.path):
                        reason = "symlink"
                    elif local and not os.path.realpath(entry.path).startswith(real + os.sep):
                        reason = "outside_repository"
                    elif local and not os.access(entry.path, os.R_OK):
                        reason = "unreadable"
                    is_folder = entry.type == fs.FileType.Directory and reason is None
                    if is_folder or reason or entry.type == fs.FileType.File:
                        out.append((name, is_folder, entry.size or 0, entry.mtime_ns or 0, reason))
            yield pd.DataFrame(out, columns=["path", "is_folder", "size", "mtime_ns", "disk_reason"])

    return run


ENTRY = "path string, is_folder boolean, size bigint, mtime_ns bigint, disk_reason string"


def walk(spark: SparkSession, root: str) -> DataFrame:
    """``(path, size, mtime_ns, disk_reason)`` of all files below ``root``, ignore files among them.

    Folders are listed by all tasks, one level of the tree after the other;
    hidden and pruned ones are not entered. Spark's own listing leaves out
    names that start with an underscore, so it can't be used here.
    """
    level = spark.createDataFrame([("",)], "folder string")
    files = None
    while True:
        seen = cut_lineage(level.mapInPandas(_listed(root), ENTRY))
        part = seen.where(~F.col("is_folder")).drop("is_folder")
        files = part if files is None else files.unionByName(part)
        name = F.element_at(F.split("path", "/"), -1)
        level = seen.where(F.col("is_folder") & ~name.startswith(".") & ~name.isin(*T.PRUNED_DIRS)).select(F.concat("path", F.lit("/")).alias("folder"))
        count = level.count()
        if not count:
            return files
        level = level.repartition(max(1, min(count // 64, 1024)))


def _contents(root: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _opened(root)
        for frame in frames:
            out = []
            for path in frame["path"]:
                try:
                    with system.open_input_stream(f"{base}/{path}") as source:
                        out.append(source.read(MAX_FILE_BYTES + 1))
                except OSError:
                    out.append(None)
            yield pd.DataFrame({"path": frame["path"], "content": out})

    return run


def ignore_rules(root: str, files: DataFrame) -> DataFrame:
    """``(folder, place, pattern, keep, folders_only)``: the lines of all ignore files among ``files (path)`` as patterns over paths.

    ``folder`` is where the file lies, with a final slash, empty at the root;
    ``keep`` is true for lines that take an exclusion back.
    """
    found = files.where(F.element_at(F.split("path", "/"), -1) == IGNORE_FILE).select("path").mapInPandas(_contents(root), "path string, content binary")
    rows = found.where(F.col("content").isNotNull()).select(F.regexp_extract("path", r"^(.*/)?[^/]*$", 1).alias("folder"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(folder, place, *rule) for folder, text in zip(frame["folder"], frame["text"]) for place, line in enumerate(text.splitlines()) if (rule := ignore_pattern(line))]
            yield pd.DataFrame(out, columns=["folder", "place", "pattern", "keep", "folders_only"])

    return rows.mapInPandas(run, "folder string, place int, pattern string, keep boolean, folders_only boolean")


IGNORE_FILE = ".gitignore"


def ignore_pattern(line: str) -> tuple[str, bool, bool] | None:
    """``(pattern, keep, folders only)`` of one line of an ignore file, or None for a blank line or comment.

    The pattern is a regular expression over a path relative to the file. A
    line with a slash before its end is bound to the file's folder, others hold
    at any depth; ``**`` spans folders, ``*`` and ``?`` don't.
    """
    rule = line.rstrip("\r\n")
    rule = re.sub(r"(?<!\\)[ \t]+$", "", rule)
    if not rule or rule.startswith("#"):
        return None
    keep = rule.startswith("!")
    rule = rule[1:] if keep else rule
    rule = rule[1:] if rule.startswith(("\\#", "\\!")) else rule
    folders_only = rule.endswith("/")
    rule = rule.rstrip("/")
    if not rule:
        return None
    bound = "/" in rule
    rule = rule.lstrip("/")
    made, i = "", 0
    while i < len(rule):
        if rule.startswith("**/", i) and (i == 0 or rule[i - 1] == "/"):
            made, i = made + "(?:.*/)?", i + 3
        elif rule.startswith("**", i) and i + 2 == len(rule) and i and rule[i - 1] == "/":
            made, i = made + ".*", i + 2
        elif rule[i] == "*":
            made, i = made + "[^/]*", i + 1
        elif rule[i] == "?":
            made, i = made + "[^/]", i + 1
        elif rule[i] == "[" and (end := rule.find("]", i + 2)) > 0:
            body = rule[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            made, i = made + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        elif rule[i] == "\\" and i + 1 < len(rule):
            made, i = made + re.escape(rule[i + 1]), i + 2
        else:
            made, i = made + re.escape(rule[i]), i + 1
    return ("^" if bound else "^(?:.*/)?") + made + "$", keep, folders_only


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """``(path)`` of ``paths (path)`` that the ``rules`` exclude, itself or by a folder above it.

    Every folder on the way and the file itself are tested by the rules of the
    folders above them; the deepest rule that matches, the last of its file,
    decides. What is below an excluded folder can't be taken back. Files meet
    rules by folder name only: no cross join.
    """
    parts = F.split("path", "/")
    steps = paths.select("path", parts.alias("parts"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"))
    steps = steps.select("path", F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("step"), (F.col("depth") < F.size("parts")).alias("is_folder"), "depth", "parts")
    above = steps.select("path", "step", "is_folder", F.explode(F.sequence(F.lit(0), F.col("depth") - 1)).alias("up"), "parts")
    folder = F.when(F.col("up") == 0, "").otherwise(F.concat(F.array_join(F.slice("parts", 1, F.col("up")), "/"), F.lit("/")))
    asked = above.select("path", "step", "is_folder", "up", folder.alias("folder"))
    rest = F.substring(F.col("step"), F.length("folder") + 1, F.length("step"))
    hits = asked.join(rules, "folder").where((~F.col("folders_only") | F.col("is_folder")) & F.regexp_like(rest, F.col("pattern")))
    said = hits.groupBy("path", "step").agg(F.max(F.struct("up", "place", "keep")).alias("x"))
    return said.where(~F.col("x.keep")).select("path").distinct()


def list_folder(spark: SparkSession, root: str) -> DataFrame:
    """``(path, size, mtime_ns, skip_reason)`` of the files under ``root`` that an index takes note of, by names and sizes alone.

    Hidden files, pruned folders and what ignore files exclude are left out.
    Reasons: symlink, outside_repository and unreadable (local disks only),
    secret, too_large.
    """
    met = walk(spark, root)
    shown = met.where(~F.element_at(F.split("path", "/"), -1).startswith("."))
    shown = shown.join(ignored(shown.select("path"), ignore_rules(root, met)), "path", "left_anti")
    reason = F.coalesce("disk_reason", F.when(T.is_secret(F.col("path")), "secret").when(F.col("size") > MAX_FILE_BYTES, "too_large"))
    return shown.select("path", "size", "mtime_ns", reason.alias("skip_reason"))


def read_folder(spark: SparkSession, root: str) -> DataFrame:
    """``(path, size, mtime_ns, text, skip_reason)`` of the same files; the text of a skipped file is null.

    Only files without a reason are opened, so no secret and no large file is
    read. Further reasons by content: unreadable, too_large (a file that has
    grown since), binary, invalid_utf8.
    """
    met = list_folder(spark, root)
    read = met.where(F.col("skip_reason").isNull()).select("path").mapInPandas(_contents(root), "path string, content binary")
    sniffed = F.hex(F.substring("content", 1, SNIFF_BYTES))
    why = (
        F.when(F.col("content").isNull(), "unreadable").when(F.length("content") > MAX_FILE_BYTES, "too_large")
        .when(sniffed.rlike("^(?:..)*00"), "binary").when(~F.is_valid_utf8(F.col("content").cast("string")), "invalid_utf8")
    )
    texts = read.select("path", F.when(why.isNull(), F.col("content").cast("string")).alias("text"), why.alias("why"))
    return met.join(texts, "path", "left").select("path", "size", "mtime_ns", "text", F.coalesce("skip_reason", "why").alias("skip_reason"))


# A vector index file, little-endian: a header of 48 bytes (magic of 8, version,
# dim, count, generation, flags, padding, FNV-1a of the first 40), the ids,
# zeros up to a multiple of 64, and the rows as 32-bit floats.
VERSION, HEADER, HASHED, ALIGN = 1, 48, 40, 64
MAGIC = b"MILLRIDX"


def index_bytes(ids: np.ndarray, vectors: np.ndarray, generation: int, magic: bytes = MAGIC) -> bytes:
    """The bytes of a vector index file; ``magic`` names the writer's format."""
    count, dim = vectors.shape
    head = struct.pack("<8sIIQQII", magic, VERSION, dim, count, generation, 0, 0)
    start = HEADER + 8 * count
    pad = bytes(-start % ALIGN)
    return head + struct.pack("<Q", fnv1a64(head)) + ids.astype("<u8").tobytes() + pad + vectors.astype("<f4").tobytes()


def write_index(path: str, ids: np.ndarray, vectors: np.ndarray, generation: int, magic: bytes = MAGIC) -> None:
    """Write beside ``path`` and rename, so that a reader sees the old file or the new one."""
    with open(f"{path}.tmp", "wb") as out:
        out.write(index_bytes(ids, vectors, generation, magic))
        out.flush()
        os.fsync(out.fileno())
    os.replace(f"{path}.tmp", path)


def parse_index(raw: bytes, magic: bytes = MAGIC) -> tuple[str | None, int, int, int]:
    """``(error, dim, count, generation)``; errors are bad_magic, bad_hash, bad_header and bad_length, in this order."""
    if len(raw) < HEADER:
        return "bad_length", 0, 0, 0
    name, version, dim, count, generation, _, _, digest = struct.unpack("<8sIIQQIIQ", raw[:HEADER])
    if name != magic:
        return "bad_magic", 0, 0, 0
    if fnv1a64(raw[:HASHED]) != digest:
        return "bad_hash", 0, 0, 0
    if version != VERSION or not dim:
        return "bad_header", 0, 0, 0
    start = HEADER + 8 * count
    if len(raw) != start + (-start % ALIGN) + 4 * dim * count:
        return "bad_length", 0, 0, 0
    return None, dim, count, generation


def index_rows(raw: bytes, magic: bytes = MAGIC) -> tuple[np.ndarray, np.ndarray]:
    error, dim, count, _ = parse_index(raw, magic)
    if error:
        raise ValueError(error)
    start = HEADER + 8 * count
    ids = np.frombuffer(raw, "<u8", count, HEADER)
    return ids, np.frombuffer(raw, "<f4", dim * count, start + (-start % ALIGN)).reshape(count, dim)


def parse_vector_indexes(files: DataFrame, magic: bytes = MAGIC) -> DataFrame:
    """``(path, id, vec, generation, error)`` of index files ``(path, content)``; a malformed one gives one row with its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, raw in zip(frame["path"], frame["content"]):
                error, _, _, generation = parse_index(raw, magic)
                if error:
                    yield pd.DataFrame({"path": [path], "id": [None], "vec": [None], "generation": [None], "error": [error]})
                else:
                    ids, vectors = index_rows(raw, magic)
                    yield pd.DataFrame({"path": path, "id": ids.astype(np.int64), "vec": list(vectors), "generation": generation, "error": None})

    return files.select("path", "content").mapInPandas(run, "path string, id bigint, vec array<float>, generation bigint, error string")


def read_vector_indexes(spark: SparkSession, pattern: str, magic: bytes = MAGIC) -> DataFrame:
    """The same of all index files that ``pattern`` names."""
    return parse_vector_indexes(spark.read.format("binaryFile").load(pattern), magic)


FILE_ROWS = 65536


def make_vector_indexes(rows: DataFrame, magic: bytes = MAGIC, most: int = FILE_ROWS) -> DataFrame:
    """``(path, content)`` of index files with the vectors ``(path, generation, id, vec)``, in the order of ids.

    A path with more than about ``most`` vectors becomes several files, so that
    no task holds more: which of them a vector goes to is by its id.
    """
    sizes = rows.groupBy("path").agg(F.ceil(F.count("*") / most).alias("files"))
    spread = rows.join(sizes, "path").withColumn("part", F.pmod(F.xxhash64("id"), F.col("files")))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        path, part = frame["path"].iloc[0], frame["part"].iloc[0]
        raw = index_bytes(frame["id"].to_numpy(np.uint64), np.stack(frame["vec"].to_numpy()).astype(np.float32), int(frame["generation"].iloc[0]), magic)
        return pd.DataFrame({"path": [f"{path}.{part}" if frame["files"].iloc[0] > 1 else path], "content": [raw]})

    return spread.groupBy("path", "part").applyInPandas(run, "path string, content binary")
