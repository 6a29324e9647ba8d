"""Proposed patches and commands: their states, the decisions on them and what an evaluation counts.

``attempts (id, conversation_id, message_id, kind, status, exit_code,
created_at, updated_at)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.operators.store import not_found, set_fields

KINDS = ("propose_diff", "run_command")
STATES = ("proposed", "approved", "denied", "applied", "passed", "failed", "timeout", "cancelled", "stale", "reverted")


def insert(attempts: DataFrame, new: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``attempts`` with ``new (id, conversation_id, message_id, kind, created_at)`` as proposed ones, and those whose conversation isn't there."""
    there = conversations.select(F.col("id").alias("conversation_id")).distinct()
    rows = new.join(there, "conversation_id", "left_semi").withColumn("status", F.lit("proposed")).withColumn("updated_at", F.col("created_at"))
    lost = new.join(there, "conversation_id", "left_anti").select("id").withColumn("error", F.lit("not_found"))
    return attempts.unionByName(rows, allowMissingColumns=True).select(*attempts.columns), lost


def pending(attempts: DataFrame) -> DataFrame:
    return attempts.where(F.col("status") == "proposed")


def decide(attempts: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attempts after ``decisions (id, approve, at)``, and the decisions refused: only a proposed attempt can be decided."""
    open_ = pending(attempts).select("id")
    new = decisions.join(open_, "id", "left_semi").select("id", F.when(F.col("approve"), "approved").otherwise("denied").alias("status"), F.col("at").alias("updated_at"))
    refused = decisions.join(open_, "id", "left_anti").select("id").withColumn("error", F.lit("not_proposed"))
    return set_fields(attempts, ["id"], new), refused


def finish(attempts: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attempts with the ``status``, ``exit_code`` and ``updated_at`` of ``results (id, ...)``, and the results without an attempt."""
    return set_fields(attempts, ["id"], results.select("id", "status", "exit_code", "updated_at")), not_found(attempts, ["id"], results)


def evaluation(attempts: DataFrame, calls: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row a conversation of ``verdicts (conversation_id, held_out_pass)``: what was tried and whether it helped.

    ``calls (conversation_id, n)`` are tool calls by message. The first attempt
    passes if the held-out test does, one patch was applied and the first run
    passed; a later success is a repair. The plumbing is sound if a patch was
    applied and a command run. All counts combine on the map side.
    """
    runs = F.col("kind") == "run_command"
    tried = attempts.groupBy("conversation_id").agg(
        F.count_if((F.col("kind") == "propose_diff") & (F.col("status") == "applied")).alias("patches_applied"), F.count_if(runs).alias("commands_run"),
        (F.min(F.when(runs, F.struct("created_at", "id", "status")))["status"] == "passed").alias("first_run_passed"),
    )
    called = calls.groupBy("conversation_id").agg(F.sum("n").alias("tool_calls_total"))
    rows = verdicts.join(tried, "conversation_id", "left").join(called, "conversation_id", "left")
    patches, commands = F.coalesce("patches_applied", F.lit(0)), F.coalesce("commands_run", F.lit(0))
    passed = F.coalesce("held_out_pass", F.lit(False))
    first = passed & (patches == 1) & F.coalesce("first_run_passed", F.lit(False))
    return rows.select(
        "conversation_id", patches.cast("bigint").alias("patches_applied"), commands.cast("bigint").alias("commands_run"), F.coalesce("tool_calls_total", F.lit(0)).cast("bigint").alias("tool_calls_total"),
        first.alias("first_attempt_pass"), (passed & ~first).alias("repaired_pass"), ((patches >= 1) & (commands >= 1)).alias("plumbing_ok"),
    )
