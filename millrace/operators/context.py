"""What of a conversation is sent to a model: slices, merges and budgets over ``(conversation_id, seq, role, content, calls)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

JOIN = "\n\n"
TITLE_CHARS = 48


BLOCK = 4096


def _carried(rows: DataFrame, mark: Column, name: str, block: int = BLOCK) -> DataFrame:
    """``rows`` with ``name``: the last non-null ``mark`` at or before each row of its conversation, in the order of ``seq``.

    A running value inside blocks of sequence numbers, and one row a block to
    carry the last mark of the blocks before; so a conversation that holds a
    third of all rows is spread over many tasks. Marks must grow with ``seq``.
    """
    rows = rows.withColumn("__block", F.floor(F.col("seq") / block)).withColumn("__mark", mark)
    inside = Window.partitionBy("conversation_id", "__block").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lasts = rows.groupBy("conversation_id", "__block").agg(F.max("__mark").alias("__last"))
    before = Window.partitionBy("conversation_id").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    lasts = lasts.select("conversation_id", "__block", F.max("__last").over(before).alias("__older"))
    both = rows.withColumn("__mine", F.max("__mark").over(inside)).join(lasts, ["conversation_id", "__block"])
    return both.withColumn(name, F.coalesce("__mine", "__older")).drop("__block", "__mark", "__mine", "__older")


def with_previous(rows: DataFrame, fields: list[str], block: int = BLOCK) -> DataFrame:
    """``rows`` with ``before``: a struct of ``fields`` of the row before in the conversation, null for the first, across blocks."""
    rows = rows.withColumn("__block", F.floor(F.col("seq") / block))
    order = Window.partitionBy("conversation_id", "__block").orderBy("seq")
    ends = rows.groupBy("conversation_id", "__block").agg(F.max_by(F.struct(*fields), "seq").alias("__end"))
    before = Window.partitionBy("conversation_id").orderBy("__block")
    ends = ends.select("conversation_id", "__block", F.lag("__end").over(before).alias("__older"))
    both = rows.withColumn("__near", F.lag(F.struct(*fields)).over(order)).join(ends, ["conversation_id", "__block"])
    return both.withColumn("before", F.coalesce("__near", "__older")).drop("__block", "__near", "__older")


def after_last_marker(messages: DataFrame) -> DataFrame:
    """Rows after the last system row; all of them where there is none."""
    last = messages.where(F.col("role") == "system").groupBy("conversation_id").agg(F.max("seq").alias("mark"))
    return messages.join(last, "conversation_id", "left").where(F.col("mark").isNull() | (F.col("seq") > F.col("mark"))).drop("mark")


def history(messages: DataFrame) -> DataFrame:
    """Without system rows and rows that have neither content nor tool calls."""
    return messages.where((F.col("role") != "system") & ((F.coalesce("content", F.lit("")) != "") | F.col("calls")))


def merge_roles(messages: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(conversation_id, seq, role, content, calls, merged)``: neighbours of one role joined by a blank line.

    Tool rows and rows with tool calls stay by themselves. An island is named
    by the place of its first row.
    """
    alone = (F.col("role") == "tool") | F.col("calls") | F.coalesce("before.calls", F.lit(False))
    starts = F.col("before.role").isNull() | (F.col("before.role") != F.col("role")) | alone
    rows = _carried(with_previous(messages, ["role", "calls"], block), F.when(starts, F.col("seq")), "island", block)
    merged = rows.groupBy("conversation_id", "island").agg(
        F.first("role").alias("role"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("content", F.lit("")).alias("content")))), lambda x: x["content"]), JOIN).alias("content"),
        F.max("calls").alias("calls"), F.count("*").alias("merged"),
    )
    return merged.withColumnRenamed("island", "seq")


def fit_budget(messages: DataFrame, limit: int, block: int = BLOCK) -> DataFrame:
    """``(conversation_id, kept, dropped, tokens, fits)`` after dropping the oldest units until ``limit`` tokens remain.

    Units, oldest first: what precedes the first user row; every later user
    row with all that follows it; within the last of those, each assistant row
    with the tool rows directly after it. The last user row itself is never
    dropped. ``messages`` has a ``tokens`` column. A unit is named by the place
    of its first row; newer units are summed by blocks first, then within one.
    """
    last = messages.groupBy("conversation_id").agg(F.max(F.when(F.col("role") == "user", F.col("seq"))).alias("last_user"))
    rows = messages.select("conversation_id", "seq", "role", "tokens").join(last, "conversation_id")
    starts = (F.col("role") == "user") | ((F.col("role") == "assistant") & (F.col("seq") > F.col("last_user")))
    rows = _carried(rows, F.when(starts, F.col("seq")), "unit", block)
    fixed = F.col("last_user").isNull() | F.coalesce(F.col("unit") == F.col("last_user"), F.lit(False))
    units = rows.groupBy("conversation_id", "unit").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"), F.first(fixed).alias("fixed"))
    units = units.withColumn("block", F.coalesce(F.floor(F.col("unit") / block), F.lit(-1)))
    free = F.when(~F.col("fixed"), F.col("tokens")).otherwise(0)
    blocks = units.groupBy("conversation_id", "block").agg(F.sum(free).alias("free"), F.sum(F.when(F.col("fixed"), F.col("tokens")).otherwise(0)).alias("fixed_tokens"))
    newer = Window.partitionBy("conversation_id").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conversation_id")
    blocks = blocks.select("conversation_id", "block", (F.coalesce(F.sum("free").over(newer), F.lit(0)) + F.sum("fixed_tokens").over(whole)).alias("ahead"))
    inside = Window.partitionBy("conversation_id", "block").orderBy(F.col("unit").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = units.withColumn("mine", F.sum(free).over(inside)).join(blocks, ["conversation_id", "block"]).withColumn("stays", F.col("fixed") | (F.col("ahead") + F.col("mine") <= limit))
    totals = marked.groupBy("conversation_id").agg(
        F.sum(F.when(F.col("stays"), F.col("n")).otherwise(0)).alias("kept"), F.sum(F.when(F.col("stays"), 0).otherwise(F.col("n"))).alias("dropped"),
        F.coalesce(F.sum(F.when(F.col("stays"), F.col("tokens"))), F.lit(0)).alias("tokens"),
    )
    return totals.withColumn("fits", F.col("tokens") <= limit)


def titles(messages: DataFrame) -> DataFrame:
    """``(conversation_id, title)``: the start of the first user message, trimmed."""
    first = messages.where(F.col("role") == "user").groupBy("conversation_id").agg(F.min_by("content", "seq").alias("content"))
    return first.select("conversation_id", F.trim(F.left(F.trim(F.coalesce("content", F.lit(""))), F.lit(TITLE_CHARS))).alias("title"))


def tool_rounds(messages: DataFrame) -> DataFrame:
    """``(conversation_id, rounds)``: assistant rows with tool calls placed after the last user row."""
    last = messages.groupBy("conversation_id").agg(F.coalesce(F.max(F.when(F.col("role") == "user", F.col("seq"))), F.lit(-1)).alias("last_user"))
    counted = F.count_if((F.col("role") == "assistant") & F.col("calls") & (F.col("seq") > F.col("last_user")))
    return messages.join(last, "conversation_id").groupBy("conversation_id").agg(counted.alias("rounds"))


def repairs_used(messages: DataFrame, attempts: DataFrame) -> DataFrame:
    """``(conversation_id, repairs)``: failed or timed-out runs since the last user message, by time."""
    last = messages.where(F.col("role") == "user").groupBy("conversation_id").agg(F.max("created_at").alias("since"))
    runs = attempts.where(F.col("kind").eqNullSafe("run_command") & F.col("status").isin("failed", "timeout"))
    counted = runs.join(last, "conversation_id", "left").where(F.col("since").isNull() | (F.col("created_at") >= F.col("since")))
    return counted.groupBy("conversation_id").agg(F.count("*").alias("repairs"))


def coalesce_deltas(deltas: DataFrame, gap_ms: int = 40) -> DataFrame:
    """``(stream_id, flush, text, n)``: pieces of a stream joined until ``gap_ms`` have passed since the last flush.

    Each flush depends on the one before, so a stream is read in order: rows
    ``(stream_id, at_ms, piece)`` are sorted by stream and time and folded as
    they pass, with nothing held but the text that isn't flushed yet. Streams
    are spread over tasks by name.
    """
    import pyarrow as pa

    def run(batches):
        stream, since, parts, flush = None, None, [], 0
        for batch in batches:
            out = []
            for name, at, piece in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if name != stream:
                    if parts:
                        out.append((stream, flush, "".join(parts), len(parts)))
                    stream, since, parts, flush = name, None, [], 0
                parts.append(piece)
                if since is None:
                    since = at
                elif at - since >= gap_ms:
                    out.append((stream, flush, "".join(parts), len(parts)))
                    since, parts, flush = at, [], flush + 1
            yield _flushes(out)
        if parts:
            yield _flushes([(stream, flush, "".join(parts), len(parts))])

    def _flushes(rows):
        columns = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int32()))], ["stream_id", "flush", "text", "n"])

    rows = deltas.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("at_ms").cast("bigint").alias("at_ms"), F.coalesce("piece", F.lit("")).alias("piece"))
    return rows.repartition("stream_id").sortWithinPartitions("stream_id", "at_ms", "piece").mapInArrow(run, "stream_id string, flush int, text string, n int")
