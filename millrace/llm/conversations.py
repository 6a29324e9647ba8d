"""Rebuilding conversations from message rows.

A finite-state automaton judges each conversation. Its transitions are closed
under composition, so a conversation is cut into blocks of sequence numbers,
every block is folded into a *state map* (end state for each start state) on its
own, and only those fixed-size maps meet per conversation. A conversation that
holds a third of all rows is thereby spread over many tasks.

Defined results
- several versions of one message id: the latest ``loaded_at`` counts; rows
  without an id count as one message per distinct row;
- null or unknown roles, and a null ``seq``, break the conversation;
- null, empty or blank content is a message without visible text;
- null or damaged ``meta`` means no tool calls;
- messages without ``conversation_id`` belong to no conversation;
- empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BLOCK = 4096

ROLES = ("system", "user", "assistant", "tool")

# States.
START, PENDING, PENDING_TOOL, DONE, DONE_TOOL, BROKEN = range(6)
# Symbols: system, user, assistant with text, the same with calls, assistant
# without text, the same with calls, tool, anything else.
SYSTEM, USER, TEXT, TEXT_CALLS, MUTE, MUTE_CALLS, TOOL, OTHER = range(8)
N_STATES, N_SYMBOLS = 6, 8

TRANSITIONS = {
    START: {SYSTEM: START, USER: PENDING},
    PENDING: {SYSTEM: PENDING, TEXT: DONE, TEXT_CALLS: DONE_TOOL, MUTE: PENDING, MUTE_CALLS: PENDING_TOOL},
    PENDING_TOOL: {
        SYSTEM: PENDING, TEXT: DONE, TEXT_CALLS: DONE_TOOL, MUTE: PENDING, MUTE_CALLS: PENDING_TOOL, TOOL: PENDING_TOOL,
    },
    DONE: {SYSTEM: DONE, USER: PENDING, TEXT: DONE, TEXT_CALLS: DONE_TOOL, MUTE: DONE, MUTE_CALLS: DONE_TOOL},
    DONE_TOOL: {
        SYSTEM: DONE, USER: PENDING, TEXT: DONE, TEXT_CALLS: DONE_TOOL, MUTE: DONE, MUTE_CALLS: DONE_TOOL, TOOL: DONE_TOOL,
    },
    BROKEN: {},
}
ACCEPTING = (DONE, DONE_TOOL)


def _table() -> Column:
    flat = [TRANSITIONS[s].get(x, BROKEN) for s in range(N_STATES) for x in range(N_SYMBOLS)]
    return F.array(*(F.lit(x) for x in flat))


def clean_role(role: Column) -> Column:
    """Role in lower case without outer blanks; null unless it is one of the four."""
    bare = F.lower(F.regexp_replace(role, r"(?U)^\s+|\s+$", ""))
    return F.when(bare.isin(*ROLES), bare)


def visible(text: Column) -> Column:
    """True if the text has a letter or a digit."""
    return F.coalesce(text.rlike(r"[\p{L}\p{Nd}]"), F.lit(False))


def has_tool_calls(meta: Column) -> Column:
    calls = F.get_json_object(meta, "$.tool_calls")
    return F.coalesce(calls.startswith("[") & ~calls.rlike(r"^\[\s*\]$"), F.lit(False))


def current_messages(messages: DataFrame, *columns: str) -> DataFrame:
    """One row per message: the version with the latest ``loaded_at``; of tied ones the greatest by ``columns`` in their order.

    ``max`` of a struct combines on the map side, so an id with very many
    versions needs no large group. A row without an id is told from others by
    all its fields, however few of them are in ``columns``.
    """
    rest = [c for c in columns if c != "id"]
    fields = [c for c in ("conversation_id", "seq", "role", "content", "created_at", "meta") if c in messages.columns]
    own = F.md5(F.to_json(F.struct(*fields)))
    key = F.when(F.col("id").isNotNull(), F.concat(F.lit("i"), F.col("id"))).otherwise(F.concat(F.lit("n"), own))
    keyed = messages.withColumn("message_key", key)
    best = F.max(F.struct("loaded_at", *rest)).alias("best")
    return keyed.groupBy("message_key").agg(F.first("id").alias("id"), best).select("id", *(F.col(f"best.{c}").alias(c) for c in rest))


def _judged(messages: DataFrame) -> DataFrame:
    """Messages with the automaton's ``symbol``; whoever resolves versions by ``(conversation_id, seq, symbol)`` first gets the same ones."""
    rows = messages.select("id", "loaded_at", "conversation_id", "seq", "role", "content", "meta", *(c for c in ("created_at",) if c in messages.columns))
    return rows.withColumn("symbol", symbol(clean_role(F.col("role")), visible(F.col("content")), has_tool_calls(F.col("meta"))))


def symbol(role: Column, text_visible: Column, calls: Column) -> Column:
    return (
        F.when(role == "system", SYSTEM)
        .when(role == "user", USER)
        .when(role == "assistant", F.when(text_visible, F.when(calls, TEXT_CALLS).otherwise(TEXT)).otherwise(F.when(calls, MUTE_CALLS).otherwise(MUTE)))
        .when(role == "tool", TOOL)
        .otherwise(OTHER)
    )


def judge_conversations(messages: DataFrame, headers: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(conversation_id, has_header, n_messages, intact)`` for every conversation of either table.

    Narrow shuffles: message versions (no content travels, only the
    automaton's symbol), then blocks, then groups of blocks; the last one moves
    one row per group. No task sees more than ``block`` rows of a conversation.
    """
    live = current_messages(_judged(messages), "id", "conversation_id", "seq", "symbol").where(F.col("conversation_id").isNotNull())
    # Equal sequence numbers are counted before rows meet, so that a number
    # repeated a million times is one row, and breaks its conversation.
    slots = live.groupBy("conversation_id", "seq").agg(F.count("*").alias("n"), F.min("symbol").alias("symbol"))
    slots = slots.select(
        "conversation_id", "seq", "n",
        F.when((F.col("n") > 1) | F.col("seq").isNull(), OTHER).otherwise(F.col("symbol")).alias("symbol"),
        F.coalesce(F.floor(F.col("seq") / block), F.lit(-1)).alias("block"),
    )
    table = _table()
    blocks = slots.groupBy("conversation_id", "block").agg(
        F.sum("n").alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high"),
        F.array_sort(F.collect_list(F.struct("seq", "symbol"))).alias("run"),
    ).select(
        "conversation_id", "block", "n", "low", "high",
        F.aggregate(
            "run",
            F.array(*(F.lit(s) for s in range(N_STATES))),
            lambda states, x: F.transform(states, lambda s: F.get(table, s * N_SYMBOLS + x["symbol"])),
        ).alias("map"),
    )
    # Maps compose, so blocks fold into one map per group of blocks before a conversation's maps meet.
    start = F.array(*(F.lit(s) for s in range(N_STATES)))
    groups = blocks.groupBy("conversation_id", F.floor(F.col("block") / block).alias("group")).agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.array_sort(F.collect_list(F.struct("block", "map"))).alias("maps"),
    )
    folded = F.aggregate("maps", start, lambda states, m: F.transform(states, lambda s: F.get(m["map"], s)))
    groups = groups.select("conversation_id", "group", "n", "low", "high", folded.alias("map"))
    known = headers.where(F.col("id").isNotNull()).select(F.col("id").alias("conversation_id")).withColumns(
        {"group": F.lit(None).cast("bigint"), "n": F.lit(0).cast("bigint"), "low": F.lit(None).cast("bigint"),
         "high": F.lit(None).cast("bigint"), "map": F.lit(None).cast("array<int>"), "header": F.lit(True)}
    ).distinct()
    parts = groups.withColumn("header", F.lit(False)).unionByName(known)
    whole = parts.groupBy("conversation_id").agg(
        F.max("header").alias("has_header"), F.sum("n").alias("n_messages"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.array_sort(F.collect_list(F.when(F.col("map").isNotNull(), F.struct("group", "map")))).alias("maps"),
    )
    final = F.aggregate("maps", F.lit(START), lambda s, m: F.get(m["map"], s))
    contiguous = F.coalesce((F.col("low") == 1) & (F.col("high") == F.col("n_messages")), F.lit(False))
    return whole.select(
        "conversation_id", "has_header", "n_messages",
        (F.col("has_header") & contiguous & final.isin(*ACCEPTING)).alias("intact"),
    )


def broken_conversations(messages: DataFrame, headers: DataFrame) -> DataFrame:
    """Ids of the conversations to drop."""
    return judge_conversations(messages, headers).where(~F.col("intact")).select("conversation_id")


def rebuild_conversations(messages: DataFrame, headers: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(conversation_id, seq, role, content)`` of the intact conversations, in order within each.

    Rows are partitioned by conversation and block of sequence numbers and
    sorted by sequence number within; so a long conversation may lie in several
    partitions, and no turn list is ever held in memory. Versions are resolved
    as for the judge, so what was judged is what comes out.
    """
    rows = _judged(messages).withColumn("clean", clean_role(F.col("role")))
    live = current_messages(rows, "id", "conversation_id", "seq", "symbol", "clean", "content")
    intact = judge_conversations(messages, headers, block).where("intact").select("conversation_id")
    turns = live.join(intact, "conversation_id", "left_semi").select("conversation_id", "seq", F.col("clean").alias("role"), "content")
    return turns.repartition("conversation_id", F.floor(F.col("seq") / block)).sortWithinPartitions("conversation_id", "seq")
