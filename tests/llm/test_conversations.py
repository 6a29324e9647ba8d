"""Conversation rebuilding against a plain automaton-free judge, with random and hand-made chats."""

import json
import random
import re

import pytest

from millrace.llm import conversations as C

SCHEMA = "id string, conversation_id string, seq long, role string, content string, created_at long, meta string, loaded_at timestamp, extra string"
HEAD = "id string, title string"
CALLS, NONE = json.dumps({"tool_calls": [{"name": "x"}]}), json.dumps({"tool_calls": []})


def judge(rows):
    """Whether a chat must be dropped, by the rules read one after another."""
    if not rows or any(r[0] is None for r in rows):
        return True
    rows = sorted(rows, key=lambda r: r[0])
    if [r[0] for r in rows] != list(range(1, len(rows) + 1)):
        return True
    roles = [(r[1] or "").strip().lower() for r in rows]
    seen = [bool(re.search(r"[^\W_]", r[2] or "")) for r in rows]
    calls = [r[3] == CALLS for r in rows]
    if any(r not in C.ROLES for r in roles) or not any(s and r in ("user", "assistant") for r, s in zip(roles, seen)):
        return True
    if next(r for r in roles if r != "system") != "user":
        return True
    for i, role in enumerate(roles):
        if role == "tool" and not (i and (roles[i - 1] == "tool" or roles[i - 1] == "assistant" and calls[i - 1])):
            return True
        if role == "user":
            rest = roles[i + 1 :]
            stop = i + 1 + (rest.index("user") if "user" in rest else len(rest))
            if not any(roles[j] == "assistant" and seen[j] for j in range(i + 1, stop)):
                return True
    return False


def build(spark, chats):
    rows = [(f"{c}-{i}", c, *r[:3], 0, r[3], None, "x") for c, chat in chats.items() for i, r in enumerate(chat)]
    return spark.createDataFrame([(a, b, s, r, t, n, m, None, x) for a, b, s, r, t, n, m, _, x in rows], SCHEMA)


@pytest.mark.parametrize("block", [2, 3, 4096])
def test_random_chats(spark, block):
    rng = random.Random(block)
    chats = {}
    for n in range(400):
        chat, seq = [], 1
        for _ in range(rng.randint(0, 7)):
            role = rng.choice(["user", "assistant", "assistant", "tool", "system", " User", "ASSISTANT", "bot" if rng.random() < 0.1 else "user"])
            chat.append((seq, role, rng.choice(["hi", "hi", "hi", "…", None, ""]), rng.choice([CALLS, NONE, None, '{"tool_calls": [{"na'])))
            seq += rng.choice([1] * 20 + [0, 2])
        chats[f"c{n}"] = chat
    heads = spark.createDataFrame([(c, "t") for c in chats if c != "c5"] + [("c7", "t")], HEAD)
    got = {r.conversation_id for r in C.judge_conversations(build(spark, chats), heads, block).where("not intact").collect()}
    assert got == {c for c, chat in chats.items() if judge(chat) or c == "c5"}


def test_versions_ties_and_dirt(spark):
    at = lambda s: __import__("datetime").datetime(2024, 1, 1, 0, 0, s)
    rows = [
        ("m1", "c", 1, "user", "old", 0, None, at(1), None), ("m1", "c", 1, "user", "new", 0, None, at(2), None), ("m1", "c", 1, "user", "new", 0, None, at(2), None),
        ("m2", "c", 2, "assistant", "yes", 0, NONE, at(1), None), (None, "d", 1, "user", "a", 0, None, at(1), None), (None, "d", 1, "user", "a", 0, None, at(1), None),
        (None, "d", 2, "assistant", "b", 0, None, at(1), None), ("m9", None, 1, "user", "x", 0, None, at(1), None), ("n1", "e", None, "user", "x", 0, None, at(1), None),
    ]
    messages = spark.createDataFrame(rows, SCHEMA)
    heads = spark.createDataFrame([("c", "t"), ("c", "t"), ("d", "t"), ("e", "t"), ("f", None), (None, "t")], HEAD)
    assert {r.conversation_id for r in C.broken_conversations(messages, heads).collect()} == {"e", "f"}
    turns = [(r.conversation_id, r.seq, r.content) for r in C.rebuild_conversations(messages, heads).collect()]
    assert turns == [("c", 1, "new"), ("c", 2, "yes"), ("d", 1, "a"), ("d", 2, "b")]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.broken_conversations(none, spark.createDataFrame([], HEAD)).count() == 0
    assert C.broken_conversations(none, spark.createDataFrame([("a", "t")], HEAD)).count() == 1


def test_one_very_long_chat(spark):
    from pyspark.sql import functions as F

    rows = spark.range(1, 20001).select(
        F.col("id").cast("string").alias("id"), F.lit("c").alias("conversation_id"), F.col("id").alias("seq"), F.when(F.col("id") % 2 == 1, "user").otherwise("assistant").alias("role"),
        F.lit("text").alias("content"), F.lit(0).alias("created_at"), F.lit(None).cast("string").alias("meta"), F.lit(None).cast("timestamp").alias("loaded_at"),
    )
    assert C.judge_conversations(rows, spark.createDataFrame([("c", "t")], HEAD)).first().intact


def test_rows_without_id_and_ties_are_judged_as_they_come_out(spark):
    at = __import__("datetime").datetime(2024, 1, 1)
    rows = [
        (None, "a", 1, "user", "one", 0, None, at, None), (None, "a", 1, "user", "other", 0, None, at, None), (None, "a", 2, "assistant", "yes", 0, None, at, None),
        (None, "b", 1, "user", "hi", 0, None, at, None), (None, "b", 1, "user", "hi", 0, None, None, None), (None, "b", 2, "assistant", "yes", 0, None, at, None),
        ("x", "c", 1, "user", "hi", 0, None, at, None), ("y", "c", 2, "assistant", "", 0, None, at, None), ("y", "c", 2, "assistant", "yes", 0, None, at, None), ("z", "c", 3, "system", None, 0, None, at, None),
    ]
    table, heads = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("a", ""), ("b", ""), ("c", "")], HEAD)
    judged = {r.conversation_id: (r.intact, r.n_messages) for r in C.judge_conversations(table, heads).collect()}
    turns = C.rebuild_conversations(table, heads).collect()
    out = {}
    for r in turns:
        out.setdefault(r.conversation_id, []).append((r.seq, r.content))
    assert judged["a"] == (False, 3) and judged["b"] == (True, 2) and out["b"] == [(1, "hi"), (2, "yes")] and "a" not in out
    kept = ("yes" if judged["c"][0] else None)
    assert (("c" in out) == judged["c"][0]) and (kept is None or out["c"][1] == (2, "yes"))


def test_long_conversation_in_small_blocks(spark):
    rows = [("c", i, "user" if i % 2 else "assistant", f"t{i}") for i in range(1, 101)]
    table = spark.createDataFrame([(f"{c}{i}", c, i, r, t, 0, None, None, None) for c, i, r, t in rows], SCHEMA)
    heads = spark.createDataFrame([("c", "")], HEAD)
    assert C.judge_conversations(table, heads, 3).collect()[0].intact
    turns = C.rebuild_conversations(table, heads, 3)
    seqs = turns.rdd.mapPartitions(lambda part: [[r.seq for r in part]]).collect()
    assert all(x == sorted(x) for x in seqs) and sorted(s for x in seqs for s in x) == list(range(1, 101))
