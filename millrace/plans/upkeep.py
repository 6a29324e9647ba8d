"""Queries over index upkeep, the conversation store and context building."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators import context, index, store
from millrace.operators.chunking import chunk_files
from millrace.plans.base import THREAD_SQL, byte_cut_sql, current, thread
from millrace.sources import read_table


def _current(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "source_files").select("repo_id", "path", "size", "mtime_ns").where(F.col("path").isNotNull()).distinct()


def _manifest(spark: SparkSession, root: str) -> DataFrame:
    """An older manifest made from the files: those of 'docs/' are missing, '.sh' files had another size, a file is gone since."""
    rows = _current(spark, root).where(~F.col("path").startswith("docs/"))
    rows = rows.withColumn("size", F.when(F.col("path").endswith(".sh"), F.col("size") + 1).otherwise(F.col("size")))
    gone = rows.select("repo_id").distinct().select("repo_id", F.lit("old/removed.txt").alias("path"), F.lit(1).cast("bigint").alias("size"), F.lit(1).cast("bigint").alias("mtime_ns"))
    return rows.unionByName(gone)


def changed_files(spark: SparkSession, root: str) -> DataFrame:
    return index.changed_files(_current(spark, root), _manifest(spark, root))


def unchanged_repos(spark: SparkSession, root: str) -> DataFrame:
    """Against a manifest in which only shell scripts differ."""
    now = _current(spark, root)
    then = now.withColumn("size", F.when(F.col("path").endswith(".sh"), F.col("size") + 1).otherwise(F.col("size")))
    return index.unchanged_repos(now, then)


def latest_generations(spark: SparkSession, root: str) -> DataFrame:
    return index.latest_generation(read_table(spark, root, "index_generations")).select("repo_id", "generation", "finished_at", "vector_file", "chunk_count")


def prune_generations(spark: SparkSession, root: str) -> DataFrame:
    return index.prune_generations(read_table(spark, root, "index_generations"), 2).select("repo_id", "generation", "vector_file")


def next_generations(spark: SparkSession, root: str) -> DataFrame:
    return index.next_generation(read_table(spark, root, "index_generations"))


def lru_evict(spark: SparkSession, root: str) -> DataFrame:
    events = read_table(spark, root, "events").withColumn("bytes", F.octet_length("props").cast("bigint"))
    return index.evict_lru(events, "event_id", "ts", "bytes", 40_000).select("event_id", "bytes", "running")


def cache_hits(spark: SparkSession, root: str) -> DataFrame:
    """How many cited digests of each repository another repository's citations would already have embedded."""
    cited = read_table(spark, root, "citations").where(F.col("digest_hex").isNotNull()).select("repo_id", F.col("digest_hex").alias("digest"), F.lit("r").alias("recipe")).distinct()
    busiest = read_table(spark, root, "citations").groupBy("repo_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "repo_id").limit(1).select("repo_id")
    cache = cited.join(busiest, "repo_id", "left_semi")
    found = index.cache_lookup(cited, cache)
    return found.groupBy("repo_id").agg(F.count_if("hit").alias("cached"), F.count_if(~F.col("hit")).alias("new"))


def report_totals(spark: SparkSession, root: str) -> DataFrame:
    reports = read_table(spark, root, "index_reports").dropDuplicates(["repo_id", "generation"])
    return reports.groupBy("repo_id").agg(
        F.count("*").alias("runs"), F.coalesce(F.sum("files_indexed"), F.lit(0)).alias("indexed"), F.sum(F.coalesce(F.size("files_skipped"), F.lit(0))).alias("skipped"),
        F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.sum("embedded_new").alias("embedded_new"), F.sum("embedded_cached").alias("embedded_cached"),
    )


def skip_histogram(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "index_reports").select(F.explode("files_skipped").alias("x")).groupBy(F.col("x.reason").alias("reason")).agg(F.count("*").alias("n"))


def latency_percentiles(spark: SparkSession, root: str) -> DataFrame:
    reports = read_table(spark, root, "index_reports").where(F.col("elapsed_ms").isNotNull())
    return reports.agg(F.min("elapsed_ms").alias("least"), F.percentile("elapsed_ms", 0.5).alias("p50"), F.percentile("elapsed_ms", 0.95).alias("p95"), F.max("elapsed_ms").alias("most"))


def citation_verify(spark: SparkSession, root: str) -> DataFrame:
    cited = read_table(spark, root, "citations").where(F.col("path").isNotNull()).distinct()
    return index.verify_citations(cited, read_table(spark, root, "source_files")).select("message_id", "n", "repo_id", "path", "start_line", "end_line", "digest_hex", "status")


def citation_status(spark: SparkSession, root: str) -> DataFrame:
    return citation_verify(spark, root).groupBy("repo_id", "status").agg(F.count("*").alias("n"))


def cited_chunks(spark: SparkSession, root: str) -> DataFrame:
    """How many of a repository's chunks are cited, by digest."""
    files = read_table(spark, root, "source_files").select("repo_id", "path", "text").where(F.col("path").isNotNull()).distinct()
    made = chunk_files(files, "repo_id").select("repo_id", "digest").distinct()
    cited = read_table(spark, root, "citations").select("repo_id", F.col("digest_hex").alias("digest")).distinct().withColumn("cited", F.lit(1))
    return made.join(cited, ["repo_id", "digest"], "left").groupBy("repo_id").agg(F.count("*").alias("chunks"), F.count("cited").alias("cited"))


def orphan_check(spark: SparkSession, root: str) -> DataFrame:
    m, c = read_table(spark, root, "messages"), read_table(spark, root, "conversations")
    r, g = read_table(spark, root, "index_reports"), read_table(spark, root, "index_generations")
    f = read_table(spark, root, "citations")
    parts = {
        "messages_without_conversation": store.orphans(m, "conversation_id", c, "id"),
        "citations_without_message": store.orphans(f, "message_id", m, "id"),
        "reports_without_generation": store.orphans(r, "repo_id", g, "repo_id", ("generation",)),
    }
    out = None
    for name, rows in parts.items():
        row = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def integrity_check(spark: SparkSession, root: str) -> DataFrame:
    keys = {"documents": "doc_id", "source_files": "file_id", "conversations": "id", "messages": "id", "orders": "o_orderkey", "events": "event_id"}
    return store.integrity({name: (read_table(spark, root, name), key) for name, key in keys.items()})


def latest_messages(spark: SparkSession, root: str) -> DataFrame:
    rows = read_table(spark, root, "messages").groupBy("id").agg(F.max(F.struct("loaded_at", "conversation_id", "seq", "content")).alias("x"))
    return rows.select("id", "x.conversation_id", "x.seq", F.md5(F.coalesce("x.content", F.lit(""))).alias("content"))


def upsert_customers(spark: SparkSession, root: str) -> DataFrame:
    """Customers after a load in which every German customer has a new balance and one is new."""
    old = read_table(spark, root, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    new = old.where(F.col("c_nationkey") == 7).withColumn("c_acctbal", F.round(F.col("c_acctbal") + 1, 2))
    extra = old.agg((F.max("c_custkey") + 1).alias("c_custkey")).select("c_custkey", F.lit(1).alias("c_nationkey"), F.lit(0.0).alias("c_acctbal"))
    return index.upsert(old, new.unionByName(extra), ["c_custkey"])


def conversations_ordered(spark: SparkSession, root: str) -> DataFrame:
    """All conversations, newest first."""
    rows = read_table(spark, root, "conversations").groupBy("id").agg(F.max("updated_at").alias("updated_at"))
    return rows.orderBy(F.col("updated_at").desc(), F.col("id").desc())


def messages_ordered(spark: SparkSession, root: str) -> DataFrame:
    """Messages in the order of their conversations."""
    return thread(spark, root).select("conversation_id", "seq", "id").orderBy("conversation_id", "seq")


def generations_ordered(spark: SparkSession, root: str) -> DataFrame:
    """Generations in the order in which they were begun."""
    return read_table(spark, root, "index_generations").select("created_at", "repo_id", "generation").distinct().orderBy("created_at", "repo_id", "generation")


def thread_clashes(spark: SparkSession, root: str) -> DataFrame:
    """Messages that share their place with one of a smaller id, which the other queries over conversations take."""
    kept = thread(spark, root).select("conversation_id", "seq", F.col("id").alias("kept"))
    return current(spark, root).join(kept, ["conversation_id", "seq"]).where(F.col("id") != F.col("kept")).select("id", "kept")


def last_messages(spark: SparkSession, root: str) -> DataFrame:
    return thread(spark, root).groupBy("conversation_id").agg(F.max_by("id", "seq").alias("id"), F.max("seq").alias("seq"))


def next_sequence(spark: SparkSession, root: str) -> DataFrame:
    return thread(spark, root).groupBy("conversation_id").agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("next_seq"))


def _attempts(spark: SparkSession, root: str) -> DataFrame:
    """Attempts made from citations: one a cited message, some without a message."""
    rows = read_table(spark, root, "citations").select("message_id", "repo_id", "n").distinct()
    return rows.select(
        F.concat_ws(":", F.coalesce("message_id", F.lit("-")), F.coalesce("repo_id", F.lit("-")), F.coalesce(F.col("n").cast("string"), F.lit("-"))).alias("id"),
        F.when(F.col("n") != 3, F.col("message_id")).alias("message_id"), "n",
    ).distinct()


def truncate_after(spark: SparkSession, root: str) -> DataFrame:
    """Messages and attempts left in each conversation after everything behind its fourth place is dropped."""
    messages = thread(spark, root)
    points = messages.select("conversation_id").distinct().withColumn("seq", F.lit(4))
    left, attempts = store.truncate_after(messages, _attempts(spark, root), points)
    kept = attempts.join(left.select(F.col("id").alias("message_id"), "conversation_id"), "message_id", "left")
    a = left.groupBy("conversation_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit("message"))
    b = kept.groupBy("conversation_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit("attempt"))
    return a.unionByName(b)


def regenerate_branch(spark: SparkSession, root: str) -> DataFrame:
    messages = thread(spark, root)
    left, _ = store.truncate_after(messages, _attempts(spark, root), store.regenerate_points(messages))
    return left.groupBy("conversation_id").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"))


def cascade_delete(spark: SparkSession, root: str) -> DataFrame:
    """Rows left in each table after the conversations without a repository are deleted."""
    conversations = read_table(spark, root, "conversations").dropDuplicates(["id"])
    messages = thread(spark, root)
    attempts = _attempts(spark, root).join(messages.select(F.col("id").alias("message_id"), "conversation_id"), "message_id", "left").select("id", "conversation_id")
    left = store.delete_conversations(conversations, messages, attempts, conversations.where(F.col("repo_path").isNull()).select("id"))
    out = None
    for name, rows in zip(("conversations", "messages", "attempts"), left):
        row = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def multiget_ordered(spark: SparkSession, root: str) -> DataFrame:
    """Customers asked for by each order, in the orders' order, repeats kept."""
    wanted = read_table(spark, root, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("id"))
    table = read_table(spark, root, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment")
    return store.fetch_in_order(table, wanted).select("pos", "id", "c_mktsegment")


def append_messages(spark: SparkSession, root: str) -> DataFrame:
    """Places that a closing note gets in each conversation."""
    messages = thread(spark, root).select("id", "conversation_id", "seq", "role", "content", "created_at")
    new = messages.groupBy("conversation_id").agg(F.max("created_at").alias("created_at")).select(
        F.concat(F.lit("note-"), "conversation_id").alias("id"), "conversation_id", F.lit("system").alias("role"), F.lit("closed").alias("content"), "created_at"
    )
    known = messages.where(F.col("role").isin(*store.ROLES))
    return store.append_messages(known, new).where(F.col("id").startswith("note-")).select("id", "conversation_id", "seq")


def context_slice(spark: SparkSession, root: str) -> DataFrame:
    return context.after_last_marker(thread(spark, root)).groupBy("conversation_id").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def history_filter(spark: SparkSession, root: str) -> DataFrame:
    return context.history(thread(spark, root)).select("conversation_id", "seq", "role", "calls")


def merge_roles(spark: SparkSession, root: str) -> DataFrame:
    rows = context.merge_roles(context.history(thread(spark, root)))
    return rows.select("conversation_id", "seq", "role", "merged", F.md5("content").alias("content"))


def context_budget(spark: SparkSession, root: str) -> DataFrame:
    """Tokens are counted as runs of non-blank characters."""
    rows = context.history(context.after_last_marker(thread(spark, root)))
    return context.fit_budget(rows.withColumn("tokens", F.size(F.regexp_extract_all("content", F.lit("([^ \\n]+)"), 1))), 200)


def conversation_titles(spark: SparkSession, root: str) -> DataFrame:
    return context.titles(thread(spark, root))


def tool_rounds(spark: SparkSession, root: str) -> DataFrame:
    return context.tool_rounds(thread(spark, root))


def repairs_used(spark: SparkSession, root: str) -> DataFrame:
    messages = thread(spark, root)
    attempts = messages.where(F.col("role") == "tool").select("conversation_id", "created_at", F.lit("run_command").alias("kind"), F.when(F.col("content").contains("error"), "failed").otherwise("passed").alias("status"))
    return context.repairs_used(messages, attempts)


def finish_reasons(spark: SparkSession, root: str) -> DataFrame:
    rows = thread(spark, root).where(F.col("role") == "assistant").select(
        F.get_json_object("meta", "$.finish").alias("finish"), F.get_json_object("meta", "$.new_tokens").cast("bigint").alias("new_tokens")
    )
    reason = store.finish_reason(F.coalesce(F.col("finish") == "memory_pressure_deferred", F.lit(False)), F.when(F.col("finish").startswith("thermal"), F.lit("any")), F.col("finish"))
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.coalesce(F.sum("new_tokens"), F.lit(0)).alias("new_tokens"))


def generation_rates(spark: SparkSession, root: str) -> DataFrame:
    reports = read_table(spark, root, "index_reports").dropDuplicates(["repo_id", "generation"])
    return reports.select("repo_id", "generation", F.round(store.rate(F.coalesce("chunks", F.lit(0)), F.coalesce("elapsed_ms", F.lit(0))), 6).alias("chunks_a_second"))


_NOW = "now AS (SELECT DISTINCT repo_id, path, size, mtime_ns FROM source_files WHERE path IS NOT NULL)"
_THEN = """old AS (SELECT repo_id, path, CASE WHEN ends_with(path, '.sh') THEN size + 1 ELSE size END AS size, mtime_ns FROM now WHERE NOT starts_with(path, 'docs/')),
manifest AS (SELECT * FROM old UNION ALL SELECT DISTINCT repo_id, 'old/removed.txt', 1, 1 FROM old)"""
_ATTEMPTS = """attempts AS (SELECT DISTINCT concat_ws(':', coalesce(message_id, '-'), coalesce(repo_id, '-'), coalesce(n::VARCHAR, '-')) AS id,
  CASE WHEN n <> 3 THEN message_id END AS message_id, n FROM citations)"""
_HISTORY = "history AS (SELECT * FROM thread WHERE role <> 'system' AND (content <> '' OR calls))"
_LINES = r"CASE WHEN text = '' THEN []::VARCHAR[] ELSE string_split_regex(regexp_replace(text, '\r?\n$', ''), '\r?\n') END"
_CITED = rf"""files AS (SELECT DISTINCT repo_id, path, text FROM source_files WHERE path IS NOT NULL),
cited AS (SELECT DISTINCT * FROM citations WHERE path IS NOT NULL),
body AS (SELECT c.*, f.path IS NOT NULL AS there, f.text, {_LINES} AS ls FROM cited c LEFT JOIN files f ON f.repo_id = c.repo_id AND f.path = c.path),
seen AS (SELECT *, coalesce(start_line < 1 OR end_line < start_line OR end_line > len(ls), true) AS outside, array_to_string(ls[start_line:end_line], chr(10)) AS span FROM body),
judged AS (SELECT *, CASE WHEN NOT there THEN 'missing' WHEN text IS NULL OR outside THEN 'file_changed'
    WHEN coalesce(sha256(encode(path) || '\x00'::BLOB || encode(start_line::VARCHAR) || '\x00'::BLOB || encode({byte_cut_sql('span', 2400)})) = digest_hex, false) THEN 'verified'
    ELSE 'file_changed' END AS status FROM seen),
checked AS (SELECT message_id, n, repo_id, path, start_line, end_line, digest_hex, chunk_id, max(status) AS status FROM judged GROUP BY ALL)"""

ORACLE = {
    "changed_files": f"""WITH {_NOW}, {_THEN} SELECT * FROM (SELECT coalesce(n.repo_id, m.repo_id) AS repo_id, coalesce(n.path, m.path) AS path,
      CASE WHEN m.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN n.size IS DISTINCT FROM m.size OR n.mtime_ns IS DISTINCT FROM m.mtime_ns THEN 'modified' END AS change
      FROM now n FULL JOIN manifest m ON n.repo_id = m.repo_id AND n.path = m.path) WHERE change IS NOT NULL""",
    "unchanged_repos": f"WITH {_NOW} SELECT repo_id, NOT bool_or(ends_with(path, '.sh') AND size IS NOT NULL) AS unchanged FROM now GROUP BY repo_id",
    "latest_generations": """SELECT repo_id, generation, finished_at, vector_file, chunk_count FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY generation DESC) AS k
      FROM index_generations WHERE finished_at IS NOT NULL) WHERE k = 1""",
    "prune_generations": """WITH d AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY generation DESC) AS k FROM index_generations WHERE finished_at IS NOT NULL),
      l AS (SELECT repo_id, max(generation) AS latest FROM d GROUP BY repo_id)
      SELECT repo_id, generation, vector_file FROM d WHERE k <= 2 UNION ALL
      SELECT g.repo_id, g.generation, g.vector_file FROM index_generations g LEFT JOIN l USING (repo_id) WHERE g.finished_at IS NULL AND (latest IS NULL OR g.generation > latest)""",
    "next_generations": "SELECT repo_id, coalesce(max(generation), 0) + 1 AS next_generation FROM index_generations GROUP BY repo_id",
    "lru_evict": """SELECT event_id, bytes, running FROM (SELECT event_id, strlen(props) AS bytes, sum(strlen(props)) OVER (ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM events)
      WHERE running <= 40000""",
    "cache_hits": """WITH c AS (SELECT DISTINCT repo_id, digest_hex AS digest FROM citations WHERE digest_hex IS NOT NULL),
      b AS (SELECT repo_id FROM citations GROUP BY repo_id ORDER BY count(*) DESC, repo_id LIMIT 1), h AS (SELECT DISTINCT digest FROM c JOIN b USING (repo_id))
      SELECT repo_id, sum(CASE WHEN h.digest IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS cached, sum(CASE WHEN h.digest IS NULL THEN 1 ELSE 0 END)::BIGINT AS new FROM c LEFT JOIN h USING (digest) GROUP BY repo_id""",
    "report_totals": """WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, generation) AS k FROM index_reports) WHERE k = 1)
      SELECT repo_id, count(*) AS runs, coalesce(sum(files_indexed), 0)::BIGINT AS indexed, sum(coalesce(len(files_skipped), 0))::BIGINT AS skipped, coalesce(sum(chunks), 0)::BIGINT AS chunks,
      sum(embedded_new)::BIGINT AS embedded_new, sum(embedded_cached)::BIGINT AS embedded_cached FROM r GROUP BY repo_id""",
    "skip_histogram": "SELECT x.reason AS reason, count(*) AS n FROM (SELECT unnest(files_skipped) AS x FROM index_reports) GROUP BY 1",
    "latency_percentiles": "SELECT min(elapsed_ms) AS least, quantile_cont(elapsed_ms, 0.5) AS p50, quantile_cont(elapsed_ms, 0.95) AS p95, max(elapsed_ms) AS most FROM index_reports WHERE elapsed_ms IS NOT NULL",
    "citation_verify": f"WITH {_CITED} SELECT message_id, n, repo_id, path, start_line, end_line, digest_hex, status FROM checked",
    "citation_status": f"WITH {_CITED} SELECT repo_id, status, count(*) AS n FROM checked GROUP BY 1, 2",
    "orphan_check": """SELECT 'messages_without_conversation' AS problem, count(*) AS n FROM messages WHERE conversation_id IS NOT NULL AND conversation_id NOT IN (SELECT id FROM conversations WHERE id IS NOT NULL)
      UNION ALL SELECT 'citations_without_message', count(*) FROM citations WHERE message_id IS NOT NULL AND message_id NOT IN (SELECT id FROM messages WHERE id IS NOT NULL)
      UNION ALL SELECT 'reports_without_generation', count(*) FROM index_reports r WHERE r.repo_id IS NOT NULL
        AND NOT EXISTS (SELECT 1 FROM index_generations g WHERE g.repo_id = r.repo_id AND (r.generation IS NULL OR g.generation = r.generation))""",
    "integrity_check": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS rows, count(*) - count({k}) AS null_keys, (SELECT count(*) FROM (SELECT {k} FROM {t} WHERE {k} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) AS repeated_keys FROM {t}"
        for t, k in {"documents": "doc_id", "source_files": "file_id", "conversations": "id", "messages": "id", "orders": "o_orderkey", "events": "event_id"}.items()
    ),
    "latest_messages": """SELECT id, conversation_id, seq, md5(coalesce(content, '')) AS content FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) AS k FROM messages) WHERE k = 1""",
    "upsert_customers": """SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey = 7 THEN round(c_acctbal + 1, 2) ELSE c_acctbal END AS c_acctbal FROM customer
      UNION ALL SELECT max(c_custkey) + 1, 1, 0.0 FROM customer""",
    "conversations_ordered": "SELECT id, max(updated_at) AS updated_at FROM conversations GROUP BY id ORDER BY updated_at DESC, id DESC",
    "messages_ordered": f"WITH {THREAD_SQL} SELECT conversation_id, seq, id FROM thread ORDER BY conversation_id, seq",
    "generations_ordered": "SELECT DISTINCT created_at, repo_id, generation FROM index_generations ORDER BY created_at, repo_id, generation",
    "thread_clashes": f"WITH {THREAD_SQL} SELECT l.id, t.id AS kept FROM live l JOIN thread t ON t.conversation_id = l.conversation_id AND t.seq = l.seq WHERE l.id <> t.id",
    "last_messages": f"WITH {THREAD_SQL} SELECT conversation_id, max_by(id, seq) AS id, max(seq) AS seq FROM thread GROUP BY 1",
    "next_sequence": f"WITH {THREAD_SQL} SELECT conversation_id, max(seq) + 1 AS next_seq FROM thread GROUP BY 1",
    "truncate_after": f"""WITH {THREAD_SQL}, {_ATTEMPTS}, kept AS (SELECT * FROM thread WHERE seq <= 4),
      a AS (SELECT * FROM attempts WHERE message_id IS NULL OR message_id NOT IN (SELECT id FROM thread WHERE seq > 4))
      SELECT conversation_id, count(*) AS n, 'message' AS kind FROM kept GROUP BY 1 UNION ALL
      SELECT k.conversation_id, count(*), 'attempt' FROM a LEFT JOIN kept k ON k.id = a.message_id GROUP BY 1""",
    "regenerate_branch": f"""WITH {THREAD_SQL}, p AS (SELECT conversation_id, max(seq) AS cut FROM thread WHERE role = 'user' GROUP BY 1)
      SELECT conversation_id, count(*) AS n, max(seq) AS last_seq FROM thread LEFT JOIN p USING (conversation_id) WHERE cut IS NULL OR seq <= cut GROUP BY 1""",
    "cascade_delete": f"""WITH {THREAD_SQL}, {_ATTEMPTS}, c AS (SELECT DISTINCT id, repo_path FROM conversations), gone AS (SELECT id FROM c WHERE repo_path IS NULL)
      SELECT 'conversations' AS table_name, count(*) AS n FROM c WHERE id NOT IN (SELECT id FROM gone) UNION ALL
      SELECT 'messages', count(*) FROM thread WHERE conversation_id NOT IN (SELECT id FROM gone) UNION ALL
      SELECT 'attempts', count(*) FROM attempts a LEFT JOIN thread t ON t.id = a.message_id WHERE t.conversation_id IS NULL OR t.conversation_id NOT IN (SELECT id FROM gone)""",
    "multiget_ordered": "SELECT o_orderkey AS pos, c_custkey AS id, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey",
    "append_messages": f"WITH {THREAD_SQL} SELECT 'note-' || conversation_id AS id, conversation_id, coalesce(max(CASE WHEN role IN ('system', 'user', 'assistant', 'tool') THEN seq END), 0) + 1 AS seq FROM thread GROUP BY conversation_id",
    "context_slice": f"""WITH {THREAD_SQL}, l AS (SELECT conversation_id, max(seq) AS mark FROM thread WHERE role = 'system' GROUP BY 1)
      SELECT conversation_id, count(*) AS n, min(seq) AS first_seq FROM thread LEFT JOIN l USING (conversation_id) WHERE mark IS NULL OR seq > mark GROUP BY 1""",
    "history_filter": f"WITH {THREAD_SQL}, {_HISTORY} SELECT conversation_id, seq, role, calls FROM history",
    "merge_roles": f"""WITH {THREAD_SQL}, {_HISTORY},
      s AS (SELECT *, CASE WHEN lag(role) OVER w IS NULL OR lag(role) OVER w <> role OR role = 'tool' OR calls OR coalesce(lag(calls) OVER w, false) THEN 1 ELSE 0 END AS starts FROM history WINDOW w AS (PARTITION BY conversation_id ORDER BY seq)),
      i AS (SELECT *, sum(starts) OVER (PARTITION BY conversation_id ORDER BY seq) AS island FROM s)
      SELECT conversation_id, min(seq) AS seq, min(role) AS role, count(*) AS merged, md5(string_agg(content, chr(10) || chr(10) ORDER BY seq)) AS content FROM i GROUP BY conversation_id, island""",
    "context_budget": f"""WITH {THREAD_SQL}, mk AS (SELECT conversation_id, max(seq) AS mark FROM thread WHERE role = 'system' GROUP BY 1),
      h AS (SELECT t.* FROM thread t LEFT JOIN mk USING (conversation_id) WHERE (mark IS NULL OR seq > mark) AND role <> 'system' AND (content <> '' OR calls)),
      a AS (SELECT *, len(regexp_extract_all(content, '[^ \\n]+')) AS tokens, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conversation_id ORDER BY seq) AS turn FROM h),
      b AS (SELECT *, max(turn) OVER (PARTITION BY conversation_id) AS last_turn, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conversation_id, turn ORDER BY seq) AS round FROM a),
      u AS (SELECT conversation_id, turn, CASE WHEN turn = last_turn AND turn > 0 THEN round ELSE 0 END AS part, (turn = last_turn AND turn > 0 AND round = 0) OR last_turn = 0 AS fixed, sum(tokens) AS tokens, count(*) AS n FROM b GROUP BY ALL),
      s AS (SELECT *, coalesce(sum(CASE WHEN fixed THEN tokens END) OVER (PARTITION BY conversation_id), 0) + coalesce(sum(CASE WHEN NOT fixed THEN tokens END) OVER (PARTITION BY conversation_id ORDER BY turn DESC, part DESC), 0) AS total FROM u)
      SELECT conversation_id, sum(CASE WHEN fixed OR total <= 200 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN fixed OR total <= 200 THEN 0 ELSE n END)::BIGINT AS dropped,
        coalesce(sum(CASE WHEN fixed OR total <= 200 THEN tokens END), 0)::BIGINT AS tokens, coalesce(sum(CASE WHEN fixed OR total <= 200 THEN tokens END), 0) <= 200 AS fits FROM s GROUP BY 1""",
    "conversation_titles": f"""WITH {THREAD_SQL} SELECT conversation_id, trim(left(trim(min_by(content, seq), ' '), 48), ' ') AS title FROM thread WHERE role = 'user' GROUP BY 1""",
    "tool_rounds": f"""WITH {THREAD_SQL}, l AS (SELECT *, coalesce(max(CASE WHEN role = 'user' THEN seq END) OVER (PARTITION BY conversation_id), -1) AS u FROM thread)
      SELECT conversation_id, sum(CASE WHEN role = 'assistant' AND calls AND seq > u THEN 1 ELSE 0 END)::BIGINT AS rounds FROM l GROUP BY 1""",
    "repairs_used": f"""WITH {THREAD_SQL}, u AS (SELECT conversation_id, max(created_at) AS since FROM thread WHERE role = 'user' GROUP BY 1)
      SELECT conversation_id, count(*) AS repairs FROM thread LEFT JOIN u USING (conversation_id) WHERE role = 'tool' AND contains(content, 'error') AND (since IS NULL OR created_at >= since) GROUP BY 1""",
    "finish_reasons": f"""WITH {THREAD_SQL}, f AS (SELECT CASE WHEN json_valid(meta) THEN json_extract_string(meta, '$.finish') END AS finish, CASE WHEN json_valid(meta) THEN json_extract_string(meta, '$.new_tokens')::BIGINT END AS t FROM thread WHERE role = 'assistant')
      SELECT CASE WHEN finish = 'memory_pressure_deferred' THEN finish WHEN starts_with(finish, 'thermal') THEN 'thermal_deferred:any' ELSE finish END AS reason, count(*) AS n, coalesce(sum(t), 0)::BIGINT AS new_tokens FROM f GROUP BY 1""",
    "generation_rates": """SELECT DISTINCT repo_id, generation, round(CASE WHEN coalesce(elapsed_ms, 0) > 0 THEN coalesce(chunks, 0) / (elapsed_ms / 1000.0) ELSE 0.0 END, 6) AS chunks_a_second FROM index_reports""",
}

QUERIES = (
    changed_files, unchanged_repos, latest_generations, prune_generations, next_generations, lru_evict, cache_hits, report_totals, skip_histogram, latency_percentiles, citation_verify,
    citation_status, cited_chunks, orphan_check, integrity_check, latest_messages, upsert_customers, conversations_ordered, messages_ordered, generations_ordered, thread_clashes, last_messages, next_sequence, truncate_after, regenerate_branch,
    cascade_delete, multiget_ordered, append_messages, context_slice, history_filter, merge_roles, context_budget, conversation_titles, tool_rounds, repairs_used, finish_reasons, generation_rates,
)
