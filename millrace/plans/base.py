"""Views of the driver's tables that several queries share, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.sources import read_table

QUESTIONS = {
    1: "why does the chunk cache drop stale entries after a restart",
    2: "lexical ranker embedding_cache",
    3: "Speicher und Manifest",
    4: "search results on slow machines",
    5: "readSession patch validator",
}


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(QUESTIONS.items()), "query_id int, text string")


QUESTIONS_SQL = "questions AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in QUESTIONS.items()) + ") AS t(query_id, text))"


def chunks(spark: SparkSession, root: str) -> DataFrame:
    """Documents as one chunk each; the file name without its ending is the symbol."""
    docs = read_table(spark, root, "documents")
    return docs.select(
        F.col("doc_id").alias("id"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce("text", F.lit("")).alias("content"),
        F.regexp_extract(F.coalesce("path", F.lit("")), r"([^/]+)\.[^./]+$", 1).alias("symbol"),
    )


CHUNKS_SQL = r"""chunks AS (SELECT doc_id AS id, coalesce(path, '') AS path, coalesce(text, '') AS content,
  regexp_extract(coalesce(path, ''), '([^/]+)\.[^./]+$', 1) AS symbol FROM documents)"""


def tokens_sql(text: str) -> str:
    """DuckDB expression for the search tokens of ``text``."""
    words = f"list_filter(list_transform(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_replace(w, '^_+|_+$', '', 'g')), lambda w: length(w) >= 2)"
    humped = "regexp_replace(regexp_replace(w, '([\\p{Ll}0-9])(\\p{Lu})', '\\1_\\2', 'g'), '(\\p{Lu})(\\p{Lu}\\p{Ll})', '\\1_\\2', 'g')"
    parts = f"list_filter(string_split({humped}, '_'), lambda p: length(p) >= 2 AND length(p) < length(w))"
    return f"flatten(list_transform({words}, lambda w: list_concat([lower(w)], list_transform({parts}, lambda p: lower(p)))))"


def byte_cut_sql(text: str, limit: int) -> str:
    """DuckDB expression for the longest prefix of whole characters of ``text`` within ``limit`` bytes."""
    return f"CASE WHEN strlen({text}) <= {limit} THEN {text} ELSE left({text}, list_max(list_filter(range({limit // 4}, {limit + 1}), lambda k: strlen(left({text}, k)) <= {limit}))) END"


def current(spark: SparkSession, root: str) -> DataFrame:
    """Current versions of the messages that have a place, with clean roles."""
    rows = read_table(spark, root, "messages").where(F.col("conversation_id").isNotNull() & F.col("seq").isNotNull())
    calls = F.get_json_object("meta", "$.tool_calls")
    rows = rows.select(
        "id", "loaded_at", "conversation_id", "seq", F.lower(F.trim("role")).alias("role"), F.coalesce("content", F.lit("")).alias("content"), "created_at", "meta",
        F.coalesce(calls.startswith("[") & ~calls.rlike(r"^\[\s*\]$"), F.lit(False)).alias("calls"),
    )
    fields = ["conversation_id", "seq", "role", "content", "created_at", "meta", "calls"]
    return rows.groupBy("id").agg(F.max(F.struct("loaded_at", *fields)).alias("x")).select("id", *(f"x.{c}" for c in fields))


def thread(spark: SparkSession, root: str) -> DataFrame:
    """Current messages, one per place of a conversation (the smallest id; ``thread_clashes`` tells the others)."""
    one = current(spark, root).groupBy("conversation_id", "seq").agg(F.min(F.struct("id", "role", "content", "created_at", "meta", "calls")).alias("x"))
    return one.select("conversation_id", "seq", "x.*")


THREAD_SQL = """live AS (
  SELECT id, conversation_id, seq, lower(trim(role)) AS role, coalesce(content, '') AS content, created_at, meta,
    CASE WHEN json_valid(meta) THEN coalesce(json_array_length(json_extract(meta, '$.tool_calls')), 0) > 0 ELSE false END AS calls
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) AS rn FROM messages WHERE conversation_id IS NOT NULL AND seq IS NOT NULL) WHERE rn = 1),
thread AS (SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id, seq ORDER BY id) AS place FROM live) WHERE place = 1)"""
