"""Tools that a model may call over a workspace of files, all calls of a table at once.

A call is ``(call_id, name, arguments)`` with arguments as JSON, a workspace is
``(path, text)`` with one text a path. Commands are never run here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.functions import text as T
from millrace.operators.textual import HIT_BYTES

MAX_ENTRIES, MAX_HITS, READ_LINES, NEEDLES = 200, 100, 200, 4096
RESULT = "call_id string, name string, error string, items array<string>, truncated boolean"


def _argument(name: str) -> Column:
    return F.get_json_object("arguments", f"$.{name}")


def _placed(calls: DataFrame, default: str | None) -> DataFrame:
    """Calls with the ``place`` that their path names inside the workspace, empty for its root, or why it is refused."""
    given = F.coalesce(_argument("path"), F.lit(default))
    place = T.confined_path(given)
    return calls.withColumn("error", F.when(given.isNull(), "bad_arguments").otherwise(place["error"])).withColumn("place", place["path"])


def _visible(files: DataFrame) -> DataFrame:
    return files.where(F.col("path").isNotNull() & ~T.is_hidden_from_tools(F.col("path")))


def list_files(calls: DataFrame, files: DataFrame) -> DataFrame:
    """Names in a folder (``path``, the root by default), sorted, folders with a slash; at most ``MAX_ENTRIES``."""
    asked = _placed(calls, ".")
    parts = F.split("path", "/")
    spread = _visible(files).select(parts.alias("parts"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"))
    entries = spread.select(F.array_join(F.slice("parts", 1, F.col("depth") - 1), "/").alias("place"), F.concat(F.get("parts", F.col("depth") - 1), F.when(F.col("depth") < F.size("parts"), "/").otherwise("")).alias("entry")).distinct()
    first = Window.partitionBy("place").orderBy("entry")
    kept = entries.withColumn("at", F.row_number().over(first)).where(F.col("at") <= MAX_ENTRIES + 1)
    folders = kept.groupBy("place").agg(F.array_sort(F.collect_list("entry")).alias("all"))
    rows = asked.join(folders, "place", "left")
    error = F.coalesce("error", F.when(F.col("all").isNull(), "not_found"))
    return rows.select("call_id", "name", error.alias("error"), F.when(error.isNull(), F.slice("all", 1, MAX_ENTRIES)).alias("items"), (F.size("all") > MAX_ENTRIES).alias("truncated"))


def read_file(calls: DataFrame, files: DataFrame) -> DataFrame:
    """Lines ``start_line`` (1 by default) to ``end_line`` (``READ_LINES`` more by default) of a file."""
    start = F.greatest(F.coalesce(_argument("start_line").try_cast("int"), F.lit(1)), F.lit(1))
    asked = _placed(calls, None).withColumn("first", start)
    asked = asked.withColumn("last", F.coalesce(_argument("end_line").try_cast("int"), F.col("first") + READ_LINES))
    texts = _visible(files).select(F.col("path").alias("place"), F.coalesce("text", F.lit("")).alias("text"), F.lit(True).alias("there"))
    rows = asked.join(texts, "place", "left").withColumn("lines", T.lines(F.col("text")))
    error = F.coalesce("error", F.when(F.col("there").isNull(), "not_found"))
    part = F.slice("lines", F.col("first"), F.greatest(F.col("last") - F.col("first") + 1, F.lit(0)))
    return rows.select("call_id", "name", error.alias("error"), F.when(error.isNull(), part).alias("items"), (F.size("lines") > F.col("last")).alias("truncated"))


def _hits(needles: list[str], most: int) -> Callable:
    """The first hits of each text a partition holds, for all needles in one pass over a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for i, needle in enumerate(needles):
            machine.add_word(needle, (i, len(needle)))
        machine.make_automaton()
        for batch in batches:
            out = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts: dict[int, int] = {}
                last: dict[int, int] = {}
                number, start, stop = 1, 0, text.find("\n")
                for end, (i, length) in machine.iter(text):
                    while 0 <= stop < end:
                        number, start, stop = number + 1, stop + 1, text.find("\n", stop + 1)
                    if end - length + 1 < start or last.get(i) == number or counts.get(i, 0) > most:
                        continue
                    last[i], counts[i] = number, counts.get(i, 0) + 1
                    line = text[start : stop if stop >= 0 else len(text)].removesuffix("\r")
                    if needles[i] in line:
                        out.append((needles[i], path, number, line.encode()[:HIT_BYTES].decode("utf-8", "ignore")))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string()))], ["needle", "path", "line_no", "hit"])

    return run


def search(calls: DataFrame, files: DataFrame) -> DataFrame:
    """The first ``MAX_HITS`` lines that hold ``query`` literally, as ``path:line:text``, in the order of paths.

    Needles go over the files in blocks of about ``NEEDLES``, each in one pass
    over a text; a text gives no more hits of a needle than a result can hold.
    """
    asked = calls.withColumn("needle", _argument("query")).withColumn("error", F.when(F.coalesce(_argument("query"), F.lit("")) == "", "bad_arguments"))
    wanted = asked.where(F.col("error").isNull()).select("needle").distinct()
    texts = _visible(files).select("path", F.coalesce("text", F.lit("")).alias("text"))
    blocks, found = max(1, -(-wanted.count() // NEEDLES)), None
    for block in range(blocks):
        needles = sorted(r.needle for r in wanted.where(F.pmod(F.xxhash64("needle"), F.lit(blocks)) == block).collect())
        if needles:
            part = texts.mapInArrow(_hits(needles, MAX_HITS), "needle string, path string, line_no bigint, hit string")
            found = part if found is None else found.unionByName(part)
    nothing = F.array().cast("array<string>")
    if found is None:
        return asked.select("call_id", "name", "error", F.when(F.col("error").isNull(), nothing).alias("items"), F.lit(False).alias("truncated"))
    order = Window.partitionBy("needle").orderBy(F.split("path", "/"), "line_no")
    first = found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= MAX_HITS + 1)
    shown = first.groupBy("needle").agg(F.array_sort(F.collect_list(F.struct("at", F.concat_ws(":", "path", F.col("line_no").cast("string"), "hit").alias("line")))).alias("all"))
    rows = asked.join(shown, "needle", "left")
    items = F.coalesce(F.slice(F.col("all.line"), 1, MAX_HITS), nothing)
    return rows.select("call_id", "name", "error", F.when(F.col("error").isNull(), items).alias("items"), F.coalesce(F.size("all") > MAX_HITS, F.lit(False)).alias("truncated"))


TOOLS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {"list_files": list_files, "read_file": read_file, "search": search}
# What a model is told of each tool: its arguments, and whether they must be there.
ARGUMENTS = {"list_files": {"path": False}, "read_file": {"path": True, "start_line": False, "end_line": False}, "search": {"query": True}}


def dispatch(calls: DataFrame, files: DataFrame, tools: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] | None = None) -> DataFrame:
    """``(call_id, name, error, items, truncated)`` of every call by the tool of its name.

    Errors: unknown_tool, bad_arguments, what ``confined_path`` refuses, and
    not_found. Hidden names are not found.
    """
    known = TOOLS if tools is None else tools
    rows = calls.select(F.col("call_id").cast("string").alias("call_id"), "name", "arguments")
    lost = rows.where(~F.coalesce(F.col("name").isin(*known), F.lit(False)))
    out = lost.select("call_id", "name", F.lit("unknown_tool").alias("error"), F.lit(None).cast("array<string>").alias("items"), F.lit(False).alias("truncated"))
    for name, tool in known.items():
        made = tool(rows.where(F.col("name") == name), files)
        out = out.unionByName(made.withColumn("truncated", F.coalesce("truncated", F.lit(False))))
    return out
