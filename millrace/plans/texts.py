"""Queries over texts and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions import text as T
from millrace.functions.hashing import set_hash
from millrace.operators import textual
from millrace.operators.chunking import chunk_files
from millrace.plans.base import THREAD_SQL, byte_cut_sql, thread, tokens_sql
from millrace.sources import read_table

LINES_SQL = r"CASE WHEN {t} = '' THEN []::VARCHAR[] ELSE string_split_regex(regexp_replace({t}, '\r?\n$', ''), '\r?\n') END"
DOC_LINES = "SELECT doc_id, path, " + LINES_SQL.format(t="text") + " AS ls FROM documents WHERE text IS NOT NULL"


def identifier_tokens(spark: SparkSession, root: str) -> DataFrame:
    rows = read_table(spark, root, "documents").where(F.col("text").isNotNull()).select("doc_id", T.tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


def line_split(spark: SparkSession, root: str) -> DataFrame:
    rows = read_table(spark, root, "documents").where(F.col("text").isNotNull()).select("doc_id", T.lines(F.col("text")).alias("ls"))
    longest = F.coalesce(F.array_max(F.transform("ls", F.octet_length)), F.lit(0))
    return rows.select("doc_id", F.size("ls").alias("n_lines"), longest.alias("longest"))



def substring_search(spark: SparkSession, root: str) -> DataFrame:
    docs = read_table(spark, root, "documents").select("doc_id", "path", "text")
    return textual.search_lines(docs, "restart").select("doc_id", "path", "line_no", "hit")


def substring_search_ci(spark: SparkSession, root: str) -> DataFrame:
    docs = read_table(spark, root, "documents").select("doc_id", "text")
    return textual.search_lines(docs, "MANIFEST", True).groupBy("doc_id").agg(F.count("*").alias("n_hits"), F.min("line_no").alias("first_line"))


def substring_top_hits(spark: SparkSession, root: str) -> DataFrame:
    """The first hundred hits by path and line, as a search page shows them."""
    docs = read_table(spark, root, "documents").where(F.col("path").isNotNull()).select("doc_id", "path", "text")
    return textual.search_lines(docs, "cache").select("path", "doc_id", "line_no").orderBy("path", "doc_id", "line_no").limit(100)


def search_report(spark: SparkSession, root: str) -> DataFrame:
    """A search over all repositories that ends at the 200th hit, and what it visited."""
    files = read_table(spark, root, "source_files").where(F.col("path").isNotNull()).select(F.concat_ws("/", "repo_id", "path").alias("path"), "text").distinct()
    return textual.search_report(files, "return", 200)


def read_range(spark: SparkSession, root: str) -> DataFrame:
    """Lines 2 to 6, as many of them as 300 bytes hold."""
    return textual.read_ranges(read_table(spark, root, "documents"), "doc_id", 2, 6, 300).select("doc_id", "content", "total_lines", "truncated", "sha256")


def read_range_capped(spark: SparkSession, root: str) -> DataFrame:
    return textual.read_ranges(read_table(spark, root, "documents"), "doc_id", 1, 0, 600)


def list_folders(spark: SparkSession, root: str) -> DataFrame:
    return textual.list_folder(read_table(spark, root, "source_files"), 10)


def secret_files(spark: SparkSession, root: str) -> DataFrame:
    reports = read_table(spark, root, "index_reports").select(F.explode("files_skipped").alias("x")).select("x.path", "x.reason").where(F.col("path").isNotNull())
    return reports.select("reason", T.is_secret(F.col("path")).alias("secret")).groupBy("reason", "secret").agg(F.count("*").alias("n"))


def excluded_files(spark: SparkSession, root: str) -> DataFrame:
    files = read_table(spark, root, "source_files").where(F.col("path").isNotNull())
    return files.groupBy(T.in_pruned_dir(F.col("path")).alias("pruned")).agg(F.countDistinct("file_id").alias("n_files"))


def confined_paths(spark: SparkSession, root: str) -> DataFrame:
    rows = read_table(spark, root, "citations").where(F.col("path").isNotNull()).select("path").distinct()
    return rows.select("path", T.confined_path(F.col("path")).alias("x")).select("path", F.col("x.path").alias("clean"), F.col("x.error").alias("error"))


def file_sha256(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "source_files").where(F.col("text").isNotNull()).select("file_id", F.sha2("text", 256).alias("sha256")).distinct()


def file_languages(spark: SparkSession, root: str) -> DataFrame:
    files = read_table(spark, root, "source_files").where(F.col("path").isNotNull())
    return files.groupBy(T.language_of(F.col("path")).alias("language"), T.fence_tag(F.col("path")).alias("tag")).agg(F.countDistinct("file_id").alias("n_files"))


def _case(column: str, table: dict[str, str], otherwise: str) -> str:
    arms = " ".join(f"WHEN {column} IN ({', '.join(repr(x) for x in endings.split())}) THEN '{name}'" for name, endings in table.items())
    return f"CASE {arms} ELSE '{otherwise}' END"


def longest_fences(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "documents").where(F.col("text").isNotNull()).select("doc_id", T.longest_run(F.col("text"), "`").alias("run"), F.length(T.fence(F.col("text"))).alias("fence"))


def chunk_windows(spark: SparkSession, root: str) -> DataFrame:
    """Plain windows: every document as a file without a known language."""
    docs = read_table(spark, root, "documents").select("doc_id", F.lit("plain").alias("path"), "text")
    return chunk_files(docs, "doc_id").select("doc_id", "start_line", "end_line")


def code_chunks(spark: SparkSession, root: str) -> DataFrame:
    return chunk_files(read_table(spark, root, "source_files").select("file_id", "path", "text").distinct(), "file_id")


def chunk_digests(spark: SparkSession, root: str) -> DataFrame:
    rows = read_table(spark, root, "documents").where(F.col("text").isNotNull())
    return rows.select("doc_id", T.chunk_digest(F.coalesce("path", F.lit("")), F.lit(1).cast("bigint"), F.col("text")).alias("digest"))


def short_ids(spark: SparkSession, root: str) -> DataFrame:
    """Cited digests as a reader is shown them, with how many share one."""
    rows = read_table(spark, root, "citations").where(F.col("digest_hex").isNotNull()).select("digest_hex").distinct()
    return rows.groupBy(T.short_digest(F.col("digest_hex")).alias("short")).agg(F.count("*").alias("n"))


def embed_inputs(spark: SparkSession, root: str) -> DataFrame:
    """What an encoder is given of each document: its path and text, whole characters within 1,800 bytes."""
    rows = read_table(spark, root, "documents").where(F.col("text").isNotNull())
    return rows.select("doc_id", T.byte_cut(F.concat(F.coalesce("path", F.lit("")), F.lit("\n"), F.col("text")), 1800).alias("input")).select("doc_id", F.octet_length("input").alias("bytes"), F.md5("input").alias("digest"))


def task_inputs(spark: SparkSession, root: str) -> DataFrame:
    rows = read_table(spark, root, "documents").where(F.col("text").isNotNull())
    return rows.select("doc_id", *(F.md5(T.task_input(task, F.col("text"))).alias(task) for task in T.TASK_PREFIXES))


def capped_results(spark: SparkSession, root: str) -> DataFrame:
    """Results of tools, cut to about 60 bytes."""
    rows = thread(spark, root).where(F.col("role") == "tool")
    return rows.select("id", T.capped(F.col("content"), 60).alias("result"))


def captured_outputs(spark: SparkSession, root: str) -> DataFrame:
    """Head and tail of every document as if a command had printed it, 500 bytes each."""
    rows = read_table(spark, root, "documents").where(F.col("text").isNotNull()).select("doc_id", T.captured(F.col("text"), 1000).alias("x"))
    return rows.select("doc_id", F.col("x.dropped").alias("dropped"), F.md5("x.bytes").alias("digest"))


def guarded_paths(spark: SparkSession, root: str) -> DataFrame:
    """Files by what keeps them from a model: tests held out by their name, and names that tools never show."""
    files = read_table(spark, root, "source_files").where(F.col("path").isNotNull()).select("repo_id", "path").distinct()
    skipped = read_table(spark, root, "index_reports").select("repo_id", F.explode("files_skipped.path").alias("path")).where(F.col("path").isNotNull()).distinct()
    rows = files.union(skipped).distinct()
    return rows.groupBy(T.is_held_out(F.col("path"), "test").alias("held_out"), T.is_hidden_from_tools(F.col("path")).alias("hidden")).agg(F.count("*").alias("n"))


def markdown_headings(spark: SparkSession, root: str) -> DataFrame:
    rows = textual.numbered_lines(read_table(spark, root, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "line_no", T.heading(F.col("line")).alias("h")).where(F.col("h").isNotNull()).select("doc_id", "line_no", "h.level", "h.title")


def slugs(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "conversations").select("id", T.slugify(F.coalesce("title", F.lit(""))).alias("slug")).distinct()


def rle_codes(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "conversations").select("id", T.run_lengths(F.lower(F.regexp_replace("id", "[0-9]", "0"))).alias("code")).distinct()


def key_values(spark: SparkSession, root: str) -> DataFrame:
    rows = textual.numbered_lines(read_table(spark, root, "source_files").select("file_id", "text").distinct())
    return rows.select("file_id", "line_no", T.key_value(F.col("line")).alias("kv")).where(F.col("kv").isNotNull()).select("file_id", "line_no", "kv.key", "kv.value")


def diff_classes(spark: SparkSession, root: str) -> DataFrame:
    rows = textual.numbered_lines(read_table(spark, root, "documents").select("doc_id", "text"))
    return rows.groupBy("doc_id", T.diff_class(F.col("line")).alias("class")).agg(F.count("*").alias("n"))


def set_hashes(spark: SparkSession, root: str) -> DataFrame:
    high, low = set_hash(F.col("id"))
    ids = read_table(spark, root, "conversations").select("mode", "id").distinct()
    return ids.groupBy("mode").agg(high.alias("high"), low.alias("low"), F.count("*").alias("n"))


_FNV = """list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, length(id) + 1), lambda i: ascii(substr(id, i, 1))::HUGEINT)),
  lambda h, b: ((h - h % 256 + xor((h % 256)::BIGINT, b::BIGINT)::HUGEINT) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"""
_EXT = r"lower(regexp_extract(path, '[^/]\.([^./]+)$', 1))"
_SECRET = """(n = '.env' OR starts_with(n, '.env.') OR starts_with(n, 'id_rsa') OR starts_with(n, 'id_ed25519') OR contains(n, 'credentials') OR contains(n, 'secret')
  OR string_split(n, '.')[-1] IN ({}))""".format(", ".join(repr(x) for x in T.SECRET_EXTENSIONS))
_PRUNED = "len(list_filter(string_split(path, '/')[:-2], lambda p: p IN ({}))) > 0".format(", ".join(repr(x) for x in T.PRUNED_DIRS))



def _read_sql(part: str, cap: int) -> str:
    return f"""WITH p AS (SELECT doc_id, text, len(ls) AS total, {part} AS part FROM (SELECT doc_id, text, {LINES_SQL.format(t='text')} AS ls FROM documents WHERE text IS NOT NULL)),
      l AS (SELECT doc_id, i, strlen(part[i]) AS z FROM (SELECT doc_id, part, unnest(range(1, len(part) + 1)) AS i FROM p)),
      c AS (SELECT doc_id, i, sum(z + CASE WHEN i > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS used FROM l),
      t AS (SELECT doc_id, count(*) AS taken FROM c WHERE used <= {cap} GROUP BY 1)
      SELECT doc_id, CASE WHEN coalesce(taken, 0) = 0 AND len(part) > 0 THEN {byte_cut_sql('part[1]', cap)} ELSE array_to_string(part[1:coalesce(taken, 0)], chr(10)) END AS content,
        total AS total_lines, coalesce(taken, 0) < len(part) AS truncated, sha256(text) AS sha256 FROM p LEFT JOIN t USING (doc_id)"""


ORACLE = {
    "chunk_windows": f"""WITH RECURSIVE l AS (SELECT doc_id, i, strlen(ls[i]) AS z, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM ({DOC_LINES}))),
      d AS (SELECT doc_id, count(*) AS n, list_prepend(0, list(c ORDER BY i)) AS cs FROM (SELECT doc_id, i, sum(z) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS c FROM l) GROUP BY doc_id),
      w AS (SELECT doc_id, n, cs, 0::BIGINT AS a, 0::BIGINT AS b FROM d UNION ALL
        SELECT doc_id, n, cs, b AS a, CASE WHEN stop < n AND n - stop < 3 THEN greatest(stop - (3 - (n - stop)), b + 1) ELSE stop END AS b FROM (
          SELECT *, coalesce(list_max(list_filter(range(b + 1, least(b + 60, n) + 1), lambda s: s = b + 1 OR cs[s + 1] - cs[b + 1] + s - b - 1 <= 2400)), b + 1) AS stop FROM w WHERE b < n))
      SELECT w.doc_id, a + 1 AS start_line, b AS end_line FROM w JOIN l ON l.doc_id = w.doc_id AND l.i BETWEEN a + 1 AND b WHERE b > 0
      GROUP BY ALL HAVING bool_or(regexp_matches(line, '[^\\s\\p{{Z}}]'))""",
    "identifier_tokens": f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents WHERE text IS NOT NULL)",
    "line_split": f"SELECT doc_id, len(ls) AS n_lines, coalesce(list_max(list_transform(ls, lambda x: strlen(x))), 0) AS longest FROM ({DOC_LINES})",
    "substring_search": f"""SELECT doc_id, path, line_no, {byte_cut_sql('hit', 400)} AS hit FROM (
      SELECT doc_id, path, i AS line_no, ls[i] AS hit FROM (SELECT doc_id, path, ls, unnest(range(1, len(ls) + 1)) AS i FROM ({DOC_LINES})) WHERE contains(ls[i], 'restart'))""",
    "search_report": f"""WITH f AS (SELECT DISTINCT concat_ws('/', repo_id, path) AS path, text FROM source_files WHERE path IS NOT NULL),
      v AS (SELECT string_split(path, '/') AS parts, coalesce(text, '') AS text FROM f
        WHERE len(list_filter(string_split(lower(path), '/'), lambda p: p IN ('.git', 'target', 'node_modules') OR starts_with(p, '.env') OR starts_with(p, 'id_rsa') OR ends_with(p, '.pem')
          OR ends_with(p, '.key') OR ends_with(p, '.sqlite') OR contains(p, 'credentials') OR contains(p, 'secret'))) = 0),
      k AS (SELECT *, strlen(text) > 524288 OR contains(text, chr(0)) AS skipped FROM v),
      h AS (SELECT parts, i, row_number() OVER (ORDER BY parts, i) AS k FROM (SELECT parts, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT parts, {LINES_SQL.format(t='text')} AS ls FROM k WHERE NOT skipped)) WHERE contains(ls[i], 'return')),
      e AS (SELECT least(count(*), 200) AS hits, count(*) > 200 AS truncated, max(CASE WHEN k = 201 THEN parts END) AS stop FROM h)
      SELECT any_value(hits) AS hits, any_value(truncated) AS truncated, sum(CASE WHEN NOT skipped THEN 1 ELSE 0 END)::BIGINT AS files_scanned, sum(CASE WHEN skipped THEN 1 ELSE 0 END)::BIGINT AS files_skipped
      FROM k, e WHERE stop IS NULL OR parts <= stop""",
    "substring_search_ci": f"""SELECT doc_id, count(*) AS n_hits, min(i) AS first_line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM ({DOC_LINES}))
      WHERE contains(lower(ls[i]), 'manifest') GROUP BY doc_id""",
    "substring_top_hits": f"""SELECT path, doc_id, i AS line_no FROM (SELECT doc_id, path, ls, unnest(range(1, len(ls) + 1)) AS i FROM ({DOC_LINES}))
      WHERE path IS NOT NULL AND contains(ls[i], 'cache') ORDER BY path, doc_id, i LIMIT 100""",
    "read_range": _read_sql("ls[2:6]", 300),
    "read_range_capped": _read_sql("ls", 600),
    "list_folders": f"""WITH f AS (SELECT DISTINCT repo_id, string_split(path, '/') AS p FROM (SELECT *, lower(string_split(path, '/')[-1]) AS n FROM source_files WHERE path IS NOT NULL)
        WHERE NOT {_SECRET} AND NOT {_PRUNED}),
      e AS (SELECT DISTINCT repo_id, array_to_string(p[1:d - 1], '/') AS folder, p[d] AS name, d < len(p) AS is_folder FROM (SELECT *, unnest(range(1, len(p) + 1)) AS d FROM f)),
      r AS (SELECT *, row_number() OVER (PARTITION BY repo_id, folder ORDER BY name, is_folder) AS k, count(*) OVER (PARTITION BY repo_id, folder) > 10 AS truncated FROM e)
      SELECT repo_id, folder, name, is_folder, truncated FROM r WHERE k <= 10""",
    "secret_files": f"""SELECT reason, {_SECRET} AS secret, count(*) AS n FROM (SELECT x.reason AS reason, lower(string_split(x.path, '/')[-1]) AS n
      FROM (SELECT unnest(files_skipped) AS x FROM index_reports) WHERE x.path IS NOT NULL) GROUP BY 1, 2""",
    "excluded_files": f"SELECT {_PRUNED} AS pruned, count(DISTINCT file_id) AS n_files FROM source_files WHERE path IS NOT NULL GROUP BY 1",
    "confined_paths": """SELECT path, CASE WHEN error IS NULL THEN array_to_string(list_filter(string_split(path, '/'), lambda p: p <> '.' AND p <> ''), '/') END AS clean, error
      FROM (SELECT path, CASE WHEN contains(path, chr(0)) THEN 'nul_byte' WHEN starts_with(path, '/') THEN 'absolute' WHEN list_contains(string_split(path, '/'), '..') THEN 'outside' END AS error
      FROM (SELECT DISTINCT path FROM citations WHERE path IS NOT NULL))""",
    "file_sha256": "SELECT DISTINCT file_id, sha256(text) AS sha256 FROM source_files WHERE text IS NOT NULL",
    "file_languages": f"""SELECT {_case('e', T.LANGUAGES, 'other')} AS language, {_case('e', T.FENCE_TAGS, '')} AS tag, count(DISTINCT file_id) AS n_files
      FROM (SELECT file_id, {_EXT} AS e FROM source_files WHERE path IS NOT NULL) GROUP BY 1, 2""",
    "longest_fences": """SELECT doc_id, r AS run, greatest(r, 2) + 1 AS fence FROM (SELECT doc_id, coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda x: length(x))), 0) AS r
      FROM documents WHERE text IS NOT NULL)""",
    "chunk_digests": r"""SELECT doc_id, sha256(encode(coalesce(path, '')) || '\x00'::BLOB || encode('1') || '\x00'::BLOB || encode(text)) AS digest FROM documents WHERE text IS NOT NULL""",
    "short_ids": "SELECT left(digest_hex, 8) AS short, count(*) AS n FROM (SELECT DISTINCT digest_hex FROM citations WHERE digest_hex IS NOT NULL) GROUP BY 1",
    "embed_inputs": f"""SELECT doc_id, strlen(input) AS bytes, md5(input) AS digest FROM (SELECT doc_id, {byte_cut_sql('body', 1800)} AS input
      FROM (SELECT doc_id, coalesce(path, '') || chr(10) || text AS body FROM documents WHERE text IS NOT NULL))""",
    "task_inputs": "SELECT doc_id, " + ", ".join(f"md5('{v}' || text) AS {k}" for k, v in T.TASK_PREFIXES.items()) + " FROM documents WHERE text IS NOT NULL",
    "capped_results": f"""WITH {THREAD_SQL}, r AS (SELECT id, content, left(content, list_min(list_filter(range(15, 61), lambda k: strlen(left(content, k)) >= 60))) AS cut FROM thread WHERE role = 'tool')
      SELECT id, CASE WHEN strlen(content) <= 60 THEN content ELSE cut || chr(10) || '…[truncated ' || (strlen(content) - strlen(cut)) || ' bytes]' END AS result FROM r""",
    "captured_outputs": """WITH d AS (SELECT doc_id, encode(text) AS raw, strlen(text) AS n, greatest(strlen(text) - 1000, 0) AS dropped FROM documents WHERE text IS NOT NULL)
      SELECT doc_id, dropped, md5(CASE WHEN dropped > 0 THEN raw[1:500] || encode(chr(10) || '…[truncated ' || dropped || ' bytes]…' || chr(10)) || raw[n - 499:n] ELSE raw END) AS digest FROM d""",
    "guarded_paths": """WITH r AS (SELECT repo_id, path FROM source_files WHERE path IS NOT NULL UNION SELECT repo_id, x.path FROM (SELECT repo_id, unnest(files_skipped) AS x FROM index_reports) WHERE x.path IS NOT NULL)
      SELECT contains(path, 'test') AS held_out, len(list_filter(string_split(lower(path), '/'), lambda p: p IN ('.git', 'target', 'node_modules') OR starts_with(p, '.env') OR starts_with(p, 'id_rsa') OR ends_with(p, '.pem')
          OR ends_with(p, '.key') OR ends_with(p, '.sqlite') OR contains(p, 'credentials') OR contains(p, 'secret'))) > 0 AS hidden, count(*) AS n FROM r GROUP BY 1, 2""",
    "markdown_headings": rf"""SELECT doc_id, i AS line_no, length(regexp_extract(line, '^(#{{1,6}}) ', 1)) AS level, regexp_replace(regexp_replace(line, '^#{{1,6}} ', ''), '^\s+|\s+$', '', 'g') AS title
      FROM (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM ({DOC_LINES}))) WHERE regexp_matches(line, '^#{{1,6}} ')""",
    "slugs": "SELECT DISTINCT id, regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM conversations",
    "rle_codes": """WITH c AS (SELECT DISTINCT id, lower(regexp_replace(id, '[0-9]', '0', 'g')) AS s FROM conversations),
      x AS (SELECT id, i, substr(s, i, 1) AS ch FROM (SELECT id, s, unnest(range(1, length(s) + 1)) AS i FROM c)),
      g AS (SELECT *, i - row_number() OVER (PARTITION BY id, ch ORDER BY i) AS island FROM x),
      r AS (SELECT id, min(i) AS i, ch, count(*) AS n FROM g GROUP BY id, ch, island)
      SELECT id, string_agg(repeat('255' || ch, (n // 255)::INT) || CASE WHEN n % 255 > 0 THEN (n % 255)::VARCHAR || ch ELSE '' END, '' ORDER BY i) AS code FROM r GROUP BY id""",
    "key_values": rf"""WITH l AS (SELECT file_id, {LINES_SQL.format(t='text')} AS ls FROM (SELECT DISTINCT file_id, text FROM source_files WHERE text IS NOT NULL)),
      x AS (SELECT file_id, i AS line_no, ls[i] AS b FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM l)),
      k AS (SELECT file_id, line_no, substr(b, 1, instr(b, '=') - 1) AS key, substr(b, instr(b, '=') + 1) AS value FROM (SELECT file_id, line_no, regexp_replace(b, '[\r\n]+$', '') AS b FROM x) WHERE instr(b, '=') > 1)
      SELECT file_id, line_no, key, value FROM k WHERE strlen(key) <= 15 AND strlen(value) <= 63""",
    "diff_classes": f"""SELECT doc_id, CASE WHEN starts_with(l, '+++') OR starts_with(l, '---') OR starts_with(l, 'diff --git') THEN 'header' WHEN starts_with(l, '@@') THEN 'meta'
      WHEN starts_with(l, '+') THEN 'added' WHEN starts_with(l, '-') THEN 'removed' ELSE 'plain' END AS class, count(*) AS n
      FROM (SELECT doc_id, unnest(ls) AS l FROM ({DOC_LINES})) GROUP BY 1, 2""",
    "set_hashes": f"""SELECT mode, bit_xor((h // 4294967296)::BIGINT) AS high, bit_xor((h % 4294967296)::BIGINT) AS low, count(*) AS n
      FROM (SELECT mode, {_FNV} AS h FROM (SELECT DISTINCT mode, id FROM conversations)) GROUP BY mode""",
}

QUERIES = (
    identifier_tokens, line_split, substring_search, substring_search_ci, substring_top_hits, search_report, short_ids, task_inputs, capped_results, captured_outputs, guarded_paths, read_range, read_range_capped, list_folders, secret_files, excluded_files,
    confined_paths, file_sha256, file_languages, longest_fences, chunk_windows, code_chunks, chunk_digests, embed_inputs, markdown_headings, slugs, rle_codes, key_values, diff_classes, set_hashes,
)
