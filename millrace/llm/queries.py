"""Named queries of this subpackage over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm import conversations, langid, neighbours, packing, pairs, sourcefiles, splitting, tokens
from millrace.sources import read_table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return conversations.broken_conversations(read_table(spark, root, "messages"), read_table(spark, root, "conversations"))


def p1_turns(spark: SparkSession, root: str) -> DataFrame:
    return conversations.rebuild_conversations(read_table(spark, root, "messages"), read_table(spark, root, "conversations"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return neighbours.similar_pairs(read_table(spark, root, "index_vectors"), read_table(spark, root, "index_meta"))


def p2_neighbours(spark: SparkSession, root: str) -> DataFrame:
    lists = neighbours.neighbour_lists(read_table(spark, root, "index_vectors"), read_table(spark, root, "index_meta"))
    return lists.select("vector_file", "chunk_id", F.transform("neighbours", lambda x: x["id"]).alias("neighbours"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return pairs.defective_pairs(read_table(spark, root, "messages"))


def p3_verdicts(spark: SparkSession, root: str) -> DataFrame:
    return pairs.judge_pairs(read_table(spark, root, "messages"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return sourcefiles.foreign_files(read_table(spark, root, "source_files"), read_table(spark, root, "thirdparty_files")).select("file_id")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return splitting.oversized_cuts(read_table(spark, root, "source_files"))


def p5_pieces(spark: SparkSession, root: str) -> DataFrame:
    return splitting.split_oversized(read_table(spark, root, "source_files"))


def p6_ids(spark: SparkSession, root: str) -> DataFrame:
    return tokens.encode_corpus(read_table(spark, root, "documents"))


def p7_containers(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, root, "documents"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return langid.mislabelled(read_table(spark, root, "documents"))


def p8_segments(spark: SparkSession, root: str) -> DataFrame:
    return langid.language_segments(read_table(spark, root, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        p1_found, p1_turns, p2_found, p2_neighbours, p3_found, p3_verdicts, p4_found, p5_found, p5_pieces, p6_ids, p7_containers, p8_found, p8_segments,
    )
    return {f.__name__: f for f in named}


_LIVE = """
live AS (
  SELECT id, conversation_id, seq, content, meta,
         CASE WHEN regexp_replace(lower(role), '^\\s+|\\s+$', '', 'g') IN ('system', 'user', 'assistant', 'tool')
              THEN regexp_replace(lower(role), '^\\s+|\\s+$', '', 'g') END AS role
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) AS rn FROM messages)
  WHERE rn = 1 AND conversation_id IS NOT NULL),
flags AS (
  SELECT *, coalesce(regexp_matches(content, '[\\p{L}\\p{Nd}]'), false) AS visible,
         CASE WHEN json_valid(meta) THEN coalesce(json_array_length(json_extract(meta, '$.tool_calls')), 0) > 0 ELSE false END AS calls
  FROM live),
near AS (
  SELECT *, lag(role) OVER w AS before, lag(calls) OVER w AS before_calls,
         sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w AS turn,
         sum(CASE WHEN role <> 'system' THEN 1 ELSE 0 END) OVER w AS talk
  FROM flags WINDOW w AS (PARTITION BY conversation_id ORDER BY seq)),
chained AS (
  SELECT *, max(CASE WHEN role <> 'tool' THEN seq END) OVER (PARTITION BY conversation_id ORDER BY seq) AS opener FROM near),
tools AS (
  SELECT t.conversation_id FROM chained t LEFT JOIN flags o ON o.conversation_id = t.conversation_id AND o.seq = t.opener
  WHERE t.role = 'tool' AND NOT coalesce(o.role = 'assistant' AND o.calls, false)),
turns AS (
  SELECT conversation_id, turn, max(CASE WHEN role = 'assistant' AND visible THEN 1 ELSE 0 END) AS answered
  FROM near WHERE turn > 0 GROUP BY 1, 2),
shape AS (
  SELECT conversation_id, count(*) AS n, count(DISTINCT seq) AS seqs, min(seq) AS low, max(seq) AS high,
         sum(CASE WHEN role IS NULL THEN 1 ELSE 0 END) AS odd,
         sum(CASE WHEN role IN ('user', 'assistant') AND visible THEN 1 ELSE 0 END) AS seen,
         sum(CASE WHEN talk = 1 AND role <> 'system' AND role <> 'user' THEN 1 ELSE 0 END) AS wrong_start
  FROM near GROUP BY 1),
heads AS (SELECT DISTINCT id AS conversation_id FROM conversations WHERE id IS NOT NULL),
everyone AS (SELECT conversation_id FROM shape UNION SELECT conversation_id FROM heads),
broken AS (
  SELECT e.conversation_id FROM everyone e LEFT JOIN shape s USING (conversation_id) LEFT JOIN heads h ON h.conversation_id = e.conversation_id
  WHERE h.conversation_id IS NULL OR s.n IS NULL OR s.odd > 0 OR s.seqs <> s.n OR s.low <> 1 OR s.high <> s.n OR s.seen = 0 OR s.wrong_start > 0
     OR e.conversation_id IN (SELECT conversation_id FROM turns WHERE answered = 0)
     OR e.conversation_id IN (SELECT conversation_id FROM tools))
"""

_P1_FOUND = f"WITH {_LIVE} SELECT conversation_id FROM broken"
_P1_TURNS = f"""WITH {_LIVE}
SELECT conversation_id, seq, role, content FROM live
WHERE conversation_id NOT IN (SELECT conversation_id FROM broken)"""

_P5_FOUND = """
WITH plain AS (
  SELECT DISTINCT file_id, replace(regexp_replace(text, '\\r?\\n$', ''), chr(13) || chr(10), chr(10)) AS body
  FROM source_files WHERE text IS NOT NULL),
lines AS (SELECT file_id, body, string_split(body, chr(10)) AS parts FROM plain)
SELECT file_id, CASE WHEN list_max(list_transform(parts, lambda x: strlen(x))) > 2400 THEN 'inside_line' ELSE 'between_lines' END AS cut
FROM lines WHERE strlen(body) > 2400 OR len(parts) > 60
"""


# Every pair of a file: exact, and so only for small tables. The search itself may miss a few pairs on large ones.
_P2_FOUND = """
WITH v AS (SELECT DISTINCT i.vector_file, i.chunk_id, list_transform(i.embedding, lambda x: x::DOUBLE) AS e FROM index_vectors i JOIN index_meta m USING (vector_file)
  WHERE len(i.embedding) = m.dim AND len(list_filter(i.embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(i.embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vector_file, chunk_id, e, sqrt(list_dot_product(e, e)) AS size FROM v),
s AS (SELECT a.chunk_id AS a, b.chunk_id AS b, round(list_dot_product(a.e, b.e) / (a.size * b.size), 8) AS sim FROM n a JOIN n b ON a.vector_file = b.vector_file AND a.chunk_id <> b.chunk_id),
k AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS place FROM s) WHERE place <= 10)
SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM k
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": _P1_FOUND, "p1_turns": _P1_TURNS, "p2_found": _P2_FOUND, "p5_found": _P5_FOUND}
