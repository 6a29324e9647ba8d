"""Queries over file formats, streams of text and what is shown or sent."""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions import vectors as V
from millrace.operators import context, prompting, tensors
from millrace.plans.base import THREAD_SQL, thread
from millrace.sources import read_table
from millrace.sources.files import make_vector_indexes, parse_vector_indexes

GAP_MS = 6 * 3_600_000


def _stored(spark: SparkSession, root: str) -> DataFrame:
    """Finite vectors of the right width, once each."""
    meta = read_table(spark, root, "index_meta").groupBy("vector_file").agg(F.max("dim").alias("dim"), F.max("generation").alias("generation"))
    rows = read_table(spark, root, "index_vectors").where(F.col("embedding").isNotNull() & V.all_finite(F.col("embedding"))).distinct().join(meta, "vector_file")
    return rows.where((F.size("embedding") == F.col("dim")) & F.col("chunk_id").isNotNull())


def stored_vectors(spark: SparkSession, root: str) -> DataFrame:
    """Vectors written as index files and read back."""
    rows = _stored(spark, root).select(F.col("vector_file").alias("path"), "generation", F.col("chunk_id").alias("id"), F.col("embedding").alias("vec"))
    back = parse_vector_indexes(make_vector_indexes(rows))
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return back.select("path", "id", "generation", "error", F.round(total, 5).alias("total"))


def unit_vectors(spark: SparkSession, root: str) -> DataFrame:
    """First and last component of every finite vector at unit length; vectors of zeros stay."""
    rows = read_table(spark, root, "index_vectors").where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & V.all_finite(F.col("embedding")))
    made = rows.select("vector_file", "chunk_id", V.normalized(F.col("embedding")).alias("x"))
    return made.select("vector_file", "chunk_id", F.round(F.element_at("x", 1), 6).alias("first"), F.round(F.element_at("x", -1), 6).alias("last")).distinct()


def tensor_headers(spark: SparkSession, root: str) -> DataFrame:
    """Tensors of a model in as many files as there are vector files; a name in several of them counts in the first."""

    def run(frames):
        for frame in frames:
            out = []
            for path, dim, rows, generation in zip(frame["path"], frame["dim"], frame["rows"], frame["generation"]):
                end = int(rows) * int(dim) * 4
                header = {
                    f"weights.{dim}": {"dtype": "F32", "shape": [int(rows), int(dim)], "data_offsets": [0, end]},
                    f"bias.{generation}": {"dtype": "BF16", "shape": [int(dim)], "data_offsets": [end, end + 2 * int(dim)]},
                }
                raw = json.dumps(header).encode()
                out.append((path, struct.pack("<Q", len(raw)) + raw + bytes(end + 2 * int(dim))))
            yield pd.DataFrame(out, columns=["path", "content"])

    meta = read_table(spark, root, "index_meta").select(F.col("vector_file").alias("path"), "dim", (F.col("count") % 7).alias("rows"), "generation")
    files = meta.mapInPandas(run, "path string, content binary")
    return tensors.first_shard(tensors.tensor_catalog(files)).select("name", "path", "dtype", F.array_join(F.transform("shape", lambda x: x.cast("string")), "x").alias("shape"), "start", "end")


def flushed_deltas(spark: SparkSession, root: str) -> DataFrame:
    """Each user's events as pieces of a stream that is flushed every six hours."""
    at = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    rows = read_table(spark, root, "events").select(F.col("user_id").cast("string").alias("stream_id"), at.alias("at_ms"), F.col("event_type").alias("piece"))
    return context.coalesce_deltas(rows, GAP_MS)


def shown_blocks(spark: SparkSession, root: str) -> DataFrame:
    """Blocks that each document is shown as, by kind."""
    return prompting.blocks(read_table(spark, root, "documents").select("doc_id", "text"), "doc_id", "text").groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


def prompts(spark: SparkSession, root: str) -> DataFrame:
    """Prompts of all chats: how many segments, and their control ids and texts as one digest."""
    calls = F.from_json(F.get_json_object("meta", "$.tool_calls"), "array<struct<name:string,arguments:string>>")
    rows = thread(spark, root).select("conversation_id", "seq", "role", "content", F.when(F.col("calls"), calls).alias("calls"))
    systems = read_table(spark, root, "conversations").groupBy(F.col("id").alias("conversation_id")).agg(F.max("system_prompt").alias("system")).withColumn("tools", F.lit(None).cast("string"))
    made = prompting.prompt_segments(rows, systems)
    plain = F.transform("segments", lambda s: F.coalesce(s["control"].cast("string"), s["text"], F.lit("")))
    return made.select("conversation_id", F.size("segments").alias("n"), F.md5(F.array_join(plain, "\x1f")).alias("digest"))


def parsed_outputs(spark: SparkSession, root: str) -> DataFrame:
    """Each vector's components as generated ids: what of them is text, and which tools they call."""
    ids = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 100).cast("int"))
    rows = read_table(spark, root, "embeddings").select("vec_id", ids.alias("ids"))
    made = prompting.parse_outputs(rows, "vec_id", lambda ids: " ".join(str(i) for i in ids))
    spelled = F.array_join(F.transform("calls", lambda c: F.concat(c["name"], F.lit(">"), c["arguments"])), "|")
    return made.select("vec_id", "text", F.size("calls").alias("n_calls"), spelled.alias("calls"))


def spelled_titles(spark: SparkSession, root: str) -> DataFrame:
    """Titles as one token a byte, read back: a character comes with its last byte."""
    letters = [F.lit(x) for char, byte in prompting.byte_alphabet().items() for x in (f"{byte:02X}", char)]
    raw = F.hex(F.encode("title", "UTF-8"))
    rows = read_table(spark, root, "conversations").groupBy("id").agg(F.max("title").alias("title")).where(F.length("title") > 0)
    rows = rows.select(F.col("id").alias("stream_id"), F.posexplode(F.transform(F.sequence(F.lit(1), F.length(raw), F.lit(2)), lambda i: F.substr(raw, i, F.lit(2)))).alias("at", "byte"))
    return prompting.detokenize(rows.select("stream_id", (F.col("at") + 1).cast("bigint").alias("seq"), F.element_at(F.create_map(*letters), F.col("byte")).alias("token")))


SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789"
WHOLE = ("the", "what", "does")
PIECES = {x: i for i, x in enumerate(["[CLS]", "[SEP]", "[UNK]", *SIGNS, *(f"##{c}" for c in SIGNS), *WHOLE])}


def title_pieces(spark: SparkSession, root: str) -> DataFrame:
    """Titles as word pieces of a vocabulary of letters and three words, at most 40 ids each."""
    rows = read_table(spark, root, "conversations").groupBy("id").agg(F.max("title").alias("title"))
    made = prompting.encode_word_pieces(rows, "id", "title", PIECES, 40)
    return made.select("id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"

ORACLE = {
    "stored_vectors": f"""WITH m AS (SELECT vector_file, max(dim) AS dim, max(generation) AS generation FROM index_meta GROUP BY 1)
      SELECT vector_file AS path, chunk_id AS id, generation, NULL::VARCHAR AS error, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total
      FROM (SELECT DISTINCT vector_file, chunk_id, embedding FROM index_vectors WHERE {_FINITE} AND chunk_id IS NOT NULL) JOIN m USING (vector_file) WHERE len(embedding) = dim""",
    "unit_vectors": f"""WITH v AS (SELECT vector_file, chunk_id, embedding AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS size FROM index_vectors WHERE {_FINITE} AND len(embedding) > 0)
      SELECT DISTINCT vector_file, chunk_id, round(CASE WHEN size > 0 THEN e[1]::DOUBLE / size ELSE e[1]::DOUBLE END, 6) AS first, round(CASE WHEN size > 0 THEN e[-1]::DOUBLE / size ELSE e[-1]::DOUBLE END, 6) AS last FROM v""",
    "tensor_headers": """WITH f AS (SELECT vector_file AS path, dim, "count" % 7 AS rows, generation FROM index_meta),
      t AS (SELECT 'weights.' || dim AS name, path, 'F32' AS dtype, rows || 'x' || dim AS shape, 0::BIGINT AS start, (rows * dim * 4)::BIGINT AS "end" FROM f
        UNION ALL SELECT 'bias.' || generation, path, 'BF16', dim::VARCHAR, (rows * dim * 4)::BIGINT, (rows * dim * 4 + 2 * dim)::BIGINT FROM f)
      SELECT name, path, dtype, shape, start, "end" FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY path) AS k FROM t) WHERE k = 1""",
    "flushed_deltas": f"""WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS s, epoch_ms(ts) AS ms, event_type AS piece, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_type) AS k FROM events),
      f AS (SELECT s, k, ms AS since, 0 AS flush, false AS due FROM e WHERE k = 1
        UNION ALL SELECT e.s, e.k, CASE WHEN e.ms - f.since >= {GAP_MS} THEN e.ms ELSE f.since END, f.flush + CASE WHEN f.due THEN 1 ELSE 0 END, e.ms - f.since >= {GAP_MS} FROM f JOIN e ON e.s = f.s AND e.k = f.k + 1)
      SELECT f.s AS stream_id, flush, string_agg(piece, '' ORDER BY f.k) AS text, count(*)::INT AS n FROM f JOIN e ON e.s = f.s AND e.k = f.k GROUP BY 1, 2""",
    "shown_blocks": """WITH d AS (SELECT doc_id, string_split(CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END, chr(10)) AS ls FROM documents WHERE text IS NOT NULL AND text <> ''),
      l AS (SELECT doc_id, i, trim(ls[i], ' ' || chr(9)) AS b FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
      c AS (SELECT *, starts_with(b, '```') AS fence, sum(CASE WHEN starts_with(b, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS fences, min(CASE WHEN b <> '' THEN i END) OVER (PARTITION BY doc_id) AS first FROM l),
      k AS (SELECT doc_id, CASE WHEN fence THEN CASE WHEN fences % 2 = 1 THEN 'code' END WHEN fences % 2 = 1 THEN NULL WHEN b = '' THEN CASE WHEN first < i THEN 'gap' END WHEN regexp_matches(b, '^#{1,3} ') THEN 'heading'
        WHEN starts_with(b, '- ') OR starts_with(b, '* ') THEN 'bullet' ELSE 'text' END AS kind FROM c)
      SELECT doc_id, kind, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY 1, 2""",
    "parsed_outputs": """WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(abs(x::DOUBLE) * 100)::INT) AS ids FROM embeddings),
      r AS (SELECT vec_id, ids, 0 AS i, 't' AS sink, '' AS text, '' AS spelled FROM v
        UNION ALL SELECT vec_id, ids, i + 1, CASE WHEN ids[i + 1] = 9 THEN 'n' WHEN ids[i + 1] = 2 THEN 't' WHEN ids[i + 1] = 32 AND sink = 'n' THEN 'a' ELSE sink END,
          CASE WHEN ids[i + 1] NOT IN (2, 9) AND sink = 't' THEN text || ' ' || ids[i + 1] ELSE text END,
          CASE WHEN ids[i + 1] = 9 THEN spelled || '|' WHEN ids[i + 1] = 2 OR sink = 't' THEN spelled WHEN ids[i + 1] = 32 AND sink = 'n' THEN spelled || '>' ELSE spelled || ' ' || ids[i + 1] END FROM r WHERE i < len(ids)),
      e AS (SELECT vec_id, trim(text) AS text, string_split(spelled, '|')[2:] AS cs FROM r WHERE i = len(ids))
      SELECT vec_id, text, len(cs)::INT AS n_calls, array_to_string(list_transform(cs, lambda c: trim(string_split(c, '>')[1]) || '>' || coalesce(trim(string_split(c, '>')[2]), '')), '|') AS calls FROM e""",
    "spelled_titles": """WITH t AS (SELECT id, max(title) AS title FROM conversations GROUP BY 1), c AS (SELECT id, title, i, substr(title, i, 1) AS ch FROM (SELECT id, title, unnest(range(1, length(title) + 1)) AS i FROM t)),
      e AS (SELECT id, ch, sum(strlen(ch)) OVER (PARTITION BY id ORDER BY i)::BIGINT AS seq FROM c), s AS (SELECT id, unnest(range(1, strlen(title) + 1)) AS seq FROM t)
      SELECT s.id AS stream_id, s.seq, coalesce(ch, '') AS text FROM s LEFT JOIN e ON e.id = s.id AND e.seq = s.seq""",
    "title_pieces": rf"""WITH t AS (SELECT id, regexp_extract_all(lower(coalesce(max(title), '')), '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]') AS words FROM conversations GROUP BY 1),
      w AS (SELECT id, list_transform(words, lambda w: CASE WHEN NOT regexp_full_match(w, '[a-z0-9]+') OR length(w) > 100 THEN [2]
        ELSE list_transform(range(1, length(w) + 1), lambda i: CASE WHEN starts_with(w, 'the') AND i <= 3 THEN CASE WHEN i = 1 THEN {PIECES['the']} END WHEN starts_with(w, 'what') AND i <= 4 THEN CASE WHEN i = 1 THEN {PIECES['what']} END
          WHEN starts_with(w, 'does') AND i <= 4 THEN CASE WHEN i = 1 THEN {PIECES['does']} END ELSE instr('{SIGNS}', w[i]) + CASE WHEN i = 1 THEN 2 ELSE {2 + len(SIGNS)} END END) END) AS ps FROM t)
      SELECT id, array_to_string(list_concat([0], list_concat(list_filter(flatten(ps), lambda x: x IS NOT NULL)[1:38], [1])), ' ') AS ids FROM w""",
    "prompts": f"""WITH {THREAD_SQL},
      s AS (SELECT *, CASE WHEN lag(role) OVER w IS NULL OR lag(role) OVER w <> role OR role = 'tool' OR calls OR coalesce(lag(calls) OVER w, false) THEN 1 ELSE 0 END AS starts FROM thread WINDOW w AS (PARTITION BY conversation_id ORDER BY seq)),
      i AS (SELECT *, sum(starts) OVER (PARTITION BY conversation_id ORDER BY seq) AS island FROM s),
      g AS (SELECT conversation_id, min(seq) AS seq, min(role) AS role, string_agg(content, chr(10) || chr(10) ORDER BY seq) AS content, any_value(CASE WHEN calls THEN meta END) AS meta FROM i GROUP BY conversation_id, island),
      p AS (SELECT conversation_id, seq, CASE role WHEN 'user' THEN ['3', content, '4'] WHEN 'tool' THEN ['7', content, '8'] WHEN 'assistant' THEN list_concat([content],
          list_concat(coalesce(flatten(list_transform(from_json(json_extract(meta, '$.tool_calls'), '[{{"name":"VARCHAR","arguments":"VARCHAR"}}]'), lambda c: ['9', coalesce(c.name, ''), '32', coalesce(c.arguments, '')])), []::VARCHAR[]), ['2']))
          ELSE []::VARCHAR[] END AS part FROM g),
      t AS (SELECT conversation_id, flatten(list(part ORDER BY seq)) AS turns FROM p GROUP BY 1),
      w AS (SELECT c.id AS conversation_id, list_concat(['1', '17', coalesce(system, ''), '18'], coalesce(turns, []::VARCHAR[])) AS segments FROM (SELECT id, max(system_prompt) AS system FROM conversations GROUP BY 1) c LEFT JOIN t ON t.conversation_id = c.id)
      SELECT conversation_id, len(segments)::INT AS n, md5(array_to_string(segments, chr(31))) AS digest FROM w""",
}

QUERIES = (stored_vectors, unit_vectors, tensor_headers, flushed_deltas, shown_blocks, parsed_outputs, spelled_titles, title_pieces, prompts)
