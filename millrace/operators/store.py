"""Conversation store transitions: each takes tables and returns the tables after the change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

ROLES = ("system", "user", "assistant", "tool")


def truncate_after(messages: DataFrame, attempts: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop messages with a greater ``seq`` than their conversation's in ``points`` and the attempts of those.

    Attempts without a message stay.
    """
    marked = messages.join(points.select("conversation_id", F.col("seq").alias("cut")), "conversation_id", "left")
    gone = marked.where(F.col("seq") > F.col("cut")).select(F.col("id").alias("message_id"))
    left = marked.where(F.col("cut").isNull() | ~(F.col("seq") > F.col("cut"))).drop("cut").select(*messages.columns)
    return left, attempts.join(gone, "message_id", "left_anti").select(*attempts.columns)


def regenerate_points(messages: DataFrame) -> DataFrame:
    """``(conversation_id, seq)`` of each conversation's last user message: where a new reply is made from."""
    return messages.where(F.col("role") == "user").groupBy("conversation_id").agg(F.max("seq").alias("seq"))


def delete_conversations(conversations: DataFrame, messages: DataFrame, attempts: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All three tables without the conversations in ``ids (id)``, their messages and attempts."""
    gone = ids.select(F.col("id").alias("conversation_id"))
    return (
        conversations.join(gone, conversations["id"] == gone["conversation_id"], "left_anti"),
        messages.join(gone, "conversation_id", "left_anti").select(*messages.columns),
        attempts.join(gone, "conversation_id", "left_anti").select(*attempts.columns),
    )


HOUR_MS = 3_600_000


def append_messages(messages: DataFrame, new: DataFrame) -> DataFrame:
    """``messages`` with ``new`` rows put after the last ``seq`` of their conversation, in ``(created_at, id)`` order.

    A row with an unknown role fails the whole append. Rows are counted by the
    hour (``created_at`` in milliseconds), the hours of a conversation are
    summed up, and only rows of one hour are sorted together.
    """
    last = messages.groupBy("conversation_id").agg(F.max("seq").alias("last"))
    rows = new.withColumn("__hour", F.coalesce(F.floor(F.col("created_at") / HOUR_MS), F.lit(-1)))
    hours = rows.groupBy("conversation_id", "__hour").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conversation_id").orderBy("__hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.join(last, "conversation_id", "left").select("conversation_id", "__hour", (F.coalesce("last", F.lit(0)) + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("__base"))
    order = Window.partitionBy("conversation_id", "__hour").orderBy("created_at", "id")
    rows = rows.withColumn("__place", F.row_number().over(order)).join(hours, ["conversation_id", "__hour"]).withColumn("seq", F.col("__base") + F.col("__place"))
    checked = F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise(F.raise_error(F.concat(F.lit("unknown role: "), F.coalesce("role", F.lit("null")))).cast("string"))
    return messages.unionByName(rows.withColumn("role", checked).select(*messages.columns))


def touch_conversations(conversations: DataFrame, new: DataFrame) -> DataFrame:
    """``updated_at`` raised to the newest message of ``new``."""
    times = new.groupBy("conversation_id").agg(F.max("created_at").alias("at")).withColumnRenamed("conversation_id", "id")
    rows = conversations.join(times, "id", "left")
    return rows.withColumn("updated_at", F.greatest("updated_at", F.coalesce("at", F.col("updated_at")))).select(*conversations.columns)


def set_fields(table: DataFrame, keys: list[str], changes: DataFrame) -> DataFrame:
    """Rows of ``table`` with the other fields of ``changes`` put in by ``keys``, nulls too; columns that ``changes`` lacks stay."""
    fields = [c for c in changes.columns if c not in keys]
    new = changes.select(*keys, F.lit(True).alias("__hit"), *(F.col(c).alias(f"__{c}") for c in fields))
    rows = table.join(new, keys, "left")
    return rows.select(*(F.when(F.col("__hit"), F.col(f"__{c}").cast(table.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in table.columns))


def not_found(table: DataFrame, keys: list[str], changes: DataFrame) -> DataFrame:
    """Keys of ``changes`` that no row of ``table`` has: what a caller is told instead of a change."""
    return changes.select(*keys).distinct().join(table.select(*keys), keys, "left_anti").withColumn("error", F.lit("not_found"))


def delete_repos(repos: DataFrame, generations: DataFrame, chunks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All three tables without the repositories in ``ids (repo_id)``, their generations and the chunks of those."""
    gone = ids.select("repo_id").distinct()
    left = generations.join(gone, "repo_id", "left_anti")
    kept = left.select("repo_id", "generation").distinct()
    return repos.join(gone, "repo_id", "left_anti").select(*repos.columns), left.select(*generations.columns), chunks.join(kept, ["repo_id", "generation"], "left_semi").select(*chunks.columns)


NEW_TITLE, TITLE_CHARS = "New chat", 48


def send(conversations: DataFrame, messages: DataFrame, sends: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(conversations, messages, errors)`` after user messages ``sends (id, conversation_id, text, created_at, admitted)``.

    Texts are trimmed. An ``empty`` one, one to a conversation that isn't there
    (``not_found``) and one that was not ``admitted`` (``busy``) leave no trace.
    A first user message gives its start as title where none was set.
    """
    known = conversations.select(F.col("id").alias("conversation_id"), F.lit(True).alias("known")).distinct()
    rows = sends.withColumn("content", F.trim("text")).join(known, "conversation_id", "left")
    error = F.when(F.coalesce("content", F.lit("")) == "", "empty").when(F.col("known").isNull(), "not_found").when(~F.coalesce("admitted", F.lit(False)), "busy")
    rows = rows.withColumn("error", error)
    good = rows.where(F.col("error").isNull()).withColumn("role", F.lit("user"))
    talked = messages.where(F.col("role") == "user").select(F.col("conversation_id").alias("id")).distinct().withColumn("talked", F.lit(True))
    first = good.groupBy("conversation_id").agg(F.min_by("content", F.struct("created_at", "id")).alias("first"), F.max("created_at").alias("at")).withColumnRenamed("conversation_id", "id")
    named = conversations.join(first, "id", "left").join(talked, "id", "left")
    title = F.when(F.col("first").isNotNull() & F.col("talked").isNull() & (F.col("title") == NEW_TITLE), F.trim(F.left(F.col("first"), F.lit(TITLE_CHARS)))).otherwise(F.col("title"))
    named = named.withColumn("title", title).withColumn("updated_at", F.greatest("updated_at", F.coalesce("at", F.col("updated_at")))).select(*conversations.columns)
    new = good.select("id", "conversation_id", "role", "content", "created_at")
    return named, append_messages(messages.select("id", "conversation_id", "seq", "role", "content", "created_at"), new), rows.where(F.col("error").isNotNull()).select("id", "error")


def reusable(entries: DataFrame, requests: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``(key, reusable)`` of each request: whether an entry of its key has the same fingerprint in all ``fields``, nulls included."""
    held = entries.select(key, F.struct(*fields).alias("__made")).distinct().withColumn("__hit", F.lit(True))
    asked = requests.select(key, F.struct(*fields).alias("__asked"))
    return asked.join(held, (asked[key] == held[key]) & asked["__asked"].eqNullSafe(held["__made"]), "left").select(asked[key], F.coalesce("__hit", F.lit(False)).alias("reusable"))


def allowed(candidates: DataFrame, requests: DataFrame, key: str, id_col: str) -> DataFrame:
    """Candidates that their request ``(key, allowed array)`` allows, in any order; a null ``allowed`` allows all, an empty one none."""
    rows = candidates.join(requests.select(key, "allowed"), key)
    return rows.where(F.col("allowed").isNull() | F.array_contains("allowed", F.col(id_col))).select(*candidates.columns)


def zip_positional(left: DataFrame, right: DataFrame, key: str, left_order: list, right_order: list) -> DataFrame:
    """Rows of ``left`` and ``right`` of one ``key`` side by side, first with first, as far as both go, with ``place`` from 1."""
    a = left.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*left_order)))
    b = right.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*right_order)))
    return a.join(b, [key, "place"])


# Tokens of input that each mode of work may take, and how many are read at a time.
INPUT_TOKENS, PREFILL_TOKENS = {"quiet": 512, "balanced": 1024, "performance": 2048}, {"quiet": 256, "balanced": 512, "performance": 1024}


def by_mode(mode: Column, table: dict[str, int]) -> Column:
    """A mode's value in ``table``; that of the quiet mode for a null or unknown one."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(F.trim(mode))), F.lit(table["quiet"]))


def fetch_in_order(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``table (id, ...)`` by ``wanted (pos, id)``, in that order, repeats kept, missing ones left out."""
    return wanted.join(table, "id").orderBy("pos")


def orphans(table: DataFrame, column: str, parent: DataFrame, parent_key: str, more: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose non-null ``column`` has no row in ``parent``; columns in ``more``, where not null, must be equal too."""
    keys = parent.select(F.col(parent_key).alias("__key"), *(F.col(c).alias(f"__{c}") for c in more)).distinct()
    same = table[column] == keys["__key"]
    for c in more:
        same &= table[c].isNull() | (table[c] == keys[f"__{c}"])
    return table.where(F.col(column).isNotNull()).join(keys, same, "left_anti")


def integrity(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """``(table_name, rows, null_keys, repeated_keys)`` of each ``(table, key)``."""
    out = None
    for name, (table, key) in tables.items():
        sizes = table.groupBy(key).agg(F.count("*").alias("n"))
        row = sizes.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).alias("null_keys"),
            F.count_if((F.col("n") > 1) & F.col(key).isNotNull()).alias("repeated_keys"),
        ).select(F.lit(name).alias("table_name"), "rows", "null_keys", "repeated_keys")
        out = row if out is None else out.unionByName(row)
    return out


def finish_reason(pressure: Column, thermal: Column, stop: Column) -> Column:
    """Memory pressure before heat before what the model said."""
    return F.when(pressure, "memory_pressure_deferred").when(thermal.isNotNull(), F.concat(F.lit("thermal_deferred:"), thermal)).otherwise(stop)


def run_status(cancelled: Column, timed_out: Column, exit_code: Column) -> Column:
    return F.when(cancelled, "cancelled").when(timed_out, "timeout").when(exit_code == 0, "passed").otherwise("failed")


def rate(count: Column, millis: Column) -> Column:
    """Items a second, 0 where no time was taken."""
    return F.when(millis > 0, count / (millis / 1000.0)).otherwise(0.0)
