"""Queries over attempts, store changes, generations of an index and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.functions import arrays, text as T
from millrace.operators import attempts as A, build, context, index, store, tools
from millrace.plans.base import THREAD_SQL, byte_cut_sql, thread
from millrace.plans.texts import DOC_LINES, LINES_SQL
from millrace.sources import read_table
from millrace.sources.schemas import migrate

NOW = 1_767_225_600_000


def _attempts(spark: SparkSession, root: str) -> DataFrame:
    """Tool messages as attempts, their kind and state by their place."""
    states = F.array(*(F.lit(x) for x in A.STATES))
    rows = thread(spark, root).where(F.col("role") == "tool")
    kind = F.when(F.col("seq") % 2 == 0, A.KINDS[0]).otherwise(A.KINDS[1])
    return rows.select("id", "conversation_id", F.col("id").alias("message_id"), kind.alias("kind"), F.get(states, (F.col("seq") * 7 % len(A.STATES)).cast("int")).alias("status"), F.lit(None).cast("int").alias("exit_code"), "created_at", F.col("created_at").alias("updated_at"))


def pending_attempts(spark: SparkSession, root: str) -> DataFrame:
    return A.pending(_attempts(spark, root)).select("id", "conversation_id", "kind")


def decided_attempts(spark: SparkSession, root: str) -> DataFrame:
    """Every attempt is decided: even places are approved. Those that weren't open are told as refused."""
    table = _attempts(spark, root)
    decisions = table.join(thread(spark, root).select("id", "seq"), "id").select("id", (F.col("seq") % 2 == 0).alias("approve"), F.lit(NOW).alias("at"))
    after, refused = A.decide(table, decisions)
    return after.join(refused, "id", "left").select("id", "status", "updated_at", "error")


def finished_attempts(spark: SparkSession, root: str) -> DataFrame:
    """Approved commands get a result by how they ended; a result for an attempt that isn't there is told."""
    table = _attempts(spark, root)
    mine = table.where((F.col("kind") == A.KINDS[1]) & (F.col("status") == "approved"))
    exit_code = (F.length("id") + F.ascii(F.right("id", F.lit(1)))) % 3
    status = store.run_status(exit_code == 2, F.lit(False), exit_code)
    results = mine.select("id", status.alias("status"), exit_code.cast("int").alias("exit_code"), F.lit(NOW).alias("updated_at"))
    lost = spark.createDataFrame([("nobody", "passed", 0, NOW)], "id string, status string, exit_code int, updated_at bigint")
    after, missing = A.finish(table, results.unionByName(lost))
    return after.select("id", "status", "exit_code").unionByName(missing.select("id", F.col("error").alias("status"), F.lit(None).cast("int").alias("exit_code")))


def inserted_attempts(spark: SparkSession, root: str) -> DataFrame:
    """One proposal for every assistant message with tool calls; those in chats without a header are refused."""
    table = _attempts(spark, root)
    new = thread(spark, root).where((F.col("role") == "assistant") & F.col("calls")).select(F.concat(F.lit("a-"), "id").alias("id"), "conversation_id", F.col("id").alias("message_id"), F.lit(A.KINDS[0]).alias("kind"), "created_at")
    after, lost = A.insert(table, new, read_table(spark, root, "conversations"))
    kept = after.groupBy("conversation_id").agg(F.count("*").alias("n")).select(F.col("conversation_id").alias("key"), F.lit("kept").alias("what"), "n")
    return kept.unionByName(lost.groupBy("error").agg(F.count("*").alias("n")).select(F.lit("").alias("key"), F.col("error").alias("what"), "n"))


def evaluation(spark: SparkSession, root: str) -> DataFrame:
    """What was tried in every chat; the held-out test counts as passed where the last message is not from a tool."""
    rows = thread(spark, root)
    calls = rows.select("conversation_id", F.coalesce(F.json_array_length(F.get_json_object("meta", "$.tool_calls")), F.lit(0)).alias("n"))
    verdicts = rows.groupBy("conversation_id").agg((~F.max_by(F.col("role").eqNullSafe("tool"), "seq")).alias("held_out_pass"))
    return A.evaluation(_attempts(spark, root), calls, verdicts)


def run_statuses(spark: SparkSession, root: str) -> DataFrame:
    """How runs ended: by a caller's stop, by time, or by the exit code."""
    e = read_table(spark, root, "events")
    status = store.run_status(F.col("event_type") == "refund", F.col("value") > 90, F.when(F.col("event_id") % 5 > 0, F.lit(0)).otherwise(1))
    return e.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def renamed_conversations(spark: SparkSession, root: str) -> DataFrame:
    """Chats of one mode lose their repository and get a title; a chat that isn't there is told."""
    table = read_table(spark, root, "conversations").groupBy("id").agg(F.max("title").alias("title"), F.max("mode").alias("mode"), F.max("repo_path").alias("repo_path"))
    changes = table.where(F.col("mode") == "balanced").select("id", F.concat(F.lit("About "), "title").alias("title"), F.lit(None).cast("string").alias("repo_path"))
    changes = changes.unionByName(spark.createDataFrame([("nobody", "x", None)], "id string, title string, repo_path string"))
    after = store.set_fields(table, ["id"], changes)
    return after.select("id", "title", "repo_path").unionByName(store.not_found(table, ["id"], changes).select("id", F.col("error").alias("title"), F.lit(None).cast("string").alias("repo_path")))


def touched_conversations(spark: SparkSession, root: str) -> DataFrame:
    """Times of change after the messages of the assistant are taken for new ones."""
    table = read_table(spark, root, "conversations").groupBy("id").agg(F.max("updated_at").alias("updated_at"))
    return store.touch_conversations(table, thread(spark, root).where(F.col("role") == "assistant"))


def sent_messages(spark: SparkSession, root: str) -> DataFrame:
    """A message is sent to every chat; blank ones and those that find the engine busy leave no trace."""
    table = read_table(spark, root, "conversations").groupBy("id").agg(F.max("updated_at").alias("updated_at"), F.max("mode").alias("mode")).withColumn("title", F.lit(store.NEW_TITLE))
    text = F.when(F.col("mode") == "quiet", F.lit("  ")).otherwise(F.concat(F.lit("  what about "), "id", F.lit("  ")))
    sends = table.select(F.concat(F.lit("s-"), "id").alias("id"), F.col("id").alias("conversation_id"), text.alias("text"), F.lit(NOW).alias("created_at"), (F.col("mode") != "performance").alias("admitted"))
    known = thread(spark, root).where(F.col("role").isin(*store.ROLES))
    named, messages, errors = store.send(table.drop("mode"), known, sends)
    new = messages.where(F.col("created_at") == NOW).groupBy("conversation_id").agg(F.max("seq").alias("seq"), F.max("content").alias("content")).withColumnRenamed("conversation_id", "id")
    told = errors.select(F.substring("id", F.lit(3), F.length("id")).alias("id"), "error")
    return named.join(new, "id", "left").join(told, "id", "left").select("id", "title", "updated_at", "seq", "content", "error")


def deleted_repos(spark: SparkSession, root: str) -> DataFrame:
    """Rows left after the repositories without a finished generation are deleted, with their generations and chunks."""
    g = read_table(spark, root, "index_generations").select("repo_id", "generation", "finished_at", "vector_file").distinct()
    repos = g.select("repo_id").distinct()
    v = read_table(spark, root, "index_vectors").select("vector_file", "chunk_id").distinct()
    chunks = g.where(F.col("vector_file").isNotNull()).join(v, "vector_file").select("repo_id", "generation", "chunk_id")
    few = g.groupBy("repo_id").agg(F.count("finished_at").alias("n")).where(F.col("n") < 3).select("repo_id")
    out = None
    for name, rows in zip(("repos", "generations", "chunks"), store.delete_repos(repos, g, chunks, few)):
        row = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def digest_finds(spark: SparkSession, root: str) -> DataFrame:
    """Chunks of all finished generations with a digest that several messages cite, newest generation first."""
    cited = read_table(spark, root, "citations").where(F.col("digest_hex").isNotNull() & F.col("chunk_id").isNotNull())
    done = read_table(spark, root, "index_generations").where(F.col("finished_at").isNotNull()).select("repo_id", "generation").distinct()
    chunks = cited.select("repo_id", F.col("chunk_id").alias("id"), F.col("digest_hex").alias("digest")).distinct().join(done, "repo_id")
    often = cited.groupBy("repo_id", F.col("digest_hex").alias("digest")).agg(F.countDistinct("message_id").alias("n")).where(F.col("n") > 1)
    return index.find_by_digest(chunks, often).select("repo_id", "digest", "generation", "id", "place")


def citation_zip(spark: SparkSession, root: str) -> DataFrame:
    """Citations of a message beside the chunks it was given, first with first."""
    cited = read_table(spark, root, "citations").where(F.col("message_id").isNotNull()).select("message_id", "n", "path", "start_line").distinct()
    hits = read_table(spark, root, "citations").where(F.col("message_id").isNotNull() & F.col("chunk_id").isNotNull()).select("message_id", "chunk_id").distinct()
    order = [F.col(c).asc_nulls_first() for c in ("n", "path", "start_line")]
    return store.zip_positional(cited, hits, "message_id", order, ["chunk_id"]).select("message_id", "place", "n", "chunk_id")


def reply_metas(spark: SparkSession, root: str) -> DataFrame:
    """What is stored with a reply, as JSON: how it ended, what it took and which places it cites."""
    cited = read_table(spark, root, "citations").where(F.col("message_id").isNotNull() & F.col("n").isNotNull()).select("message_id", "n").distinct()
    cites = cited.groupBy("message_id").agg(F.array_sort(F.collect_list("n")).alias("cites"))
    rows = thread(spark, root).where(F.col("role") == "assistant").join(cites.withColumnRenamed("message_id", "id"), "id", "left")
    fields = F.struct(
        F.lit("done").alias("status"), F.get_json_object("meta", "$.finish").alias("finish"), F.get_json_object("meta", "$.new_tokens").cast("bigint").alias("new_tokens"),
        F.col("calls").alias("called"), F.coalesce("cites", F.array().cast("array<int>")).alias("citations"),
    )
    return rows.select("id", F.to_json(fields, {"ignoreNullFields": "false"}).alias("meta"))


def reusable_generations(spark: SparkSession, root: str) -> DataFrame:
    """Whether a generation's settings are those of the one before it, so that what was decided with it still holds."""
    g = read_table(spark, root, "index_generations").join(read_table(spark, root, "index_meta").select("vector_file", "dim"), "vector_file", "left")
    g = g.groupBy("repo_id", "generation").agg(F.max("recipe").alias("recipe"), F.max("dim").alias("dim"))
    key = F.concat_ws("#", "repo_id", "generation")
    before = g.select(F.concat_ws("#", "repo_id", F.col("generation") + 1).alias("key"), "recipe", "dim")
    return store.reusable(before, g.select(key.alias("key"), "recipe", "dim"), "key", ["recipe", "dim"])


def recipe_guard(spark: SparkSession, root: str) -> DataFrame:
    """Repositories whose latest index another encoder made than the one of the first generation of all."""
    g = read_table(spark, root, "index_generations")
    return build.guard(g, RECIPE)


RECIPE = "hashed-tokens|search_document|dim256|v1"


def recipes(spark: SparkSession, root: str) -> DataFrame:
    rows = read_table(spark, root, "index_meta")
    return rows.groupBy(T.recipe(F.lit("hashed-tokens"), F.col("dim")).alias("recipe")).agg(F.count("*").alias("n"))


def allowed_candidates(spark: SparkSession, root: str) -> DataFrame:
    """Customers that each nation's request allows by segment: all where it names none."""
    nations = read_table(spark, root, "nation")
    some = F.when(F.col("n_regionkey") == 0, F.lit(None)).when(F.col("n_regionkey") == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("BUILDING"), F.lit("MACHINERY")))
    requests = nations.select(F.col("n_nationkey").alias("c_nationkey"), some.cast("array<string>").alias("allowed"))
    candidates = read_table(spark, root, "customer").select("c_nationkey", "c_custkey", "c_mktsegment")
    return store.allowed(candidates, requests, "c_nationkey", "c_mktsegment").groupBy("c_nationkey").agg(F.count("*").alias("n"))


def mode_budgets(spark: SparkSession, root: str) -> DataFrame:
    rows = read_table(spark, root, "conversations").groupBy("id").agg(F.max("mode").alias("mode"))
    return rows.groupBy("mode", store.by_mode(F.col("mode"), store.INPUT_TOKENS).alias("input_tokens"), store.by_mode(F.col("mode"), store.PREFILL_TOKENS).alias("prefill_tokens")).agg(F.count("*").alias("n"))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \n]+"), lambda w: w != "")


def prefix_reuse(spark: SparkSession, root: str) -> DataFrame:
    """What of each user message the one before it in its chat has cached, by words, 16 of them read at a time."""
    rows = thread(spark, root).where(F.col("role") == "user").select("conversation_id", "seq", _words(F.col("content")).alias("ids"))
    pairs = context.with_previous(rows, ["ids"]).withColumn("cached", F.coalesce("before.ids", F.array().cast("array<string>")))
    return pairs.where(F.size("ids") > 0).select("conversation_id", "seq", arrays.prefix_reuse(F.col("cached"), F.col("ids"), 16).alias("x")).select("conversation_id", "seq", "x.*")


def control_ids(spark: SparkSession, root: str) -> DataFrame:
    """Control ids among the ids that each vector's components stand for."""
    rows = read_table(spark, root, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 6000)).alias("ids"))
    return rows.select("vec_id", F.size("ids").alias("n"), arrays.control_count(F.col("ids")).alias("control"))


def migrated_conversations(spark: SparkSession, root: str) -> DataFrame:
    """Chats of the first version of their table, brought to the third: the title cut to what a list shows, then the mode in lower case."""
    steps = [
        lambda t: t.withColumn("repo_path", F.coalesce("repo_path", F.lit(""))),
        lambda t: t.withColumn("shown", F.left("title", F.lit(20))).drop("title"),
        lambda t: t.withColumn("mode", F.lower("mode")),
    ]
    table = read_table(spark, root, "conversations").select("id", "title", "repo_path", "mode").distinct()
    return migrate(table, 1, steps[:3])


def begun_generations(spark: SparkSession, root: str) -> DataFrame:
    """A generation more for every repository, finished for half of them by name; one that isn't there is told."""
    g = read_table(spark, root, "index_generations").distinct()
    requests = g.select("repo_id").distinct().select("repo_id", F.concat("repo_id", F.lit(".new")).alias("vector_file"), F.lit(RECIPE).alias("recipe"), F.lit(NOW).alias("created_at"))
    begun = index.begin_generation(g, requests)
    new = begun.where(F.col("created_at") == NOW).where(F.col("repo_id") < "m").select("repo_id", "generation", F.lit(NOW).alias("finished_at"), F.lit(7).cast("bigint").alias("chunk_count"))
    lost = spark.createDataFrame([("nobody", 1, NOW, 0)], "repo_id string, generation bigint, finished_at bigint, chunk_count bigint")
    after, missing = index.finish_generation(begun, new.unionByName(lost))
    rows = after.where(F.col("created_at") == NOW).select("repo_id", "generation", "finished_at", "chunk_count", F.lit(None).cast("string").alias("error"))
    return rows.unionByName(missing.select("repo_id", "generation", F.lit(None).cast("bigint").alias("finished_at"), F.lit(None).cast("bigint").alias("chunk_count"), "error"))


def numbered_files(spark: SparkSession, root: str) -> DataFrame:
    """Files with consecutive numbers in the order of repository, path and id."""
    rows = read_table(spark, root, "source_files").select("repo_id", F.coalesce("path", F.lit("")).alias("path"), "file_id").distinct()
    return index.number_rows(rows, ["repo_id", "path", "file_id"], "number", 101).select("file_id", "number")


def cache_touches(spark: SparkSession, root: str) -> DataFrame:
    """A cache after it was asked for what the busiest repository cites: hits are as good as new."""
    cited = read_table(spark, root, "citations").where(F.col("digest_hex").isNotNull() & F.col("chunk_id").isNotNull())
    cache = cited.groupBy(F.lit("r").alias("recipe"), F.col("digest_hex").alias("digest")).agg(F.min("chunk_id").alias("last_used")).withColumn("vector", F.array(F.lit(0.0)))
    busiest = cited.groupBy("repo_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "repo_id").limit(1).select("repo_id")
    asked = cited.join(busiest, "repo_id", "left_semi").select(F.lit("r").alias("recipe"), F.col("digest_hex").alias("digest")).distinct()
    found, touched = index.read_cache(cache, asked, NOW)
    hits = found.select(F.count("vector").alias("hits"))
    return touched.groupBy((F.col("last_used") == NOW).alias("fresh")).agg(F.count("*").alias("n")).crossJoin(hits)


def refresh_reasons(spark: SparkSession, root: str) -> DataFrame:
    """Why each repository has to be indexed again: manifests are of the last report, files of one ending were changed."""
    now = read_table(spark, root, "source_files").select("repo_id", "path", "size", "mtime_ns").where(F.col("path").isNotNull()).distinct()
    g = read_table(spark, root, "index_generations").distinct()
    usual = g.groupBy("recipe").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "recipe").limit(1).first()
    of_report = read_table(spark, root, "index_reports").groupBy("repo_id").agg(F.max("generation").alias("generation"))
    was = now.withColumn("size", F.when(F.col("path").endswith(".rs"), F.col("size") + 1).otherwise(F.col("size")))
    manifest = was.join(of_report, "repo_id")
    repos = now.select("repo_id").union(g.select("repo_id"))
    return index.refresh_reason(repos, now, manifest, g, read_table(spark, root, "index_meta"), usual.recipe if usual else "")


def index_build(spark: SparkSession, root: str) -> DataFrame:
    """A new generation over all documents, a repository for every source; documents of one source were indexed before."""
    docs = read_table(spark, root, "documents").select(
        F.coalesce("source", F.lit("-")).alias("repo_id"), F.concat(F.coalesce("path", F.lit("")), F.lit("#"), F.col("doc_id").cast("string")).alias("path"), "text",
        F.octet_length("text").cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("mtime_ns"), F.when(F.octet_length("text") > 100_000, "too_large").alias("skip_reason"),
    )
    encoder = build.HashedEncoder()
    first = docs.groupBy("repo_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "repo_id").limit(1).select("repo_id")
    empty_g = spark.createDataFrame([], "repo_id string, generation bigint, created_at bigint, finished_at bigint, vector_file string, chunk_count bigint, recipe string")
    empty_c = spark.createDataFrame([], "recipe string, digest string, vector array<double>, bytes bigint, last_used bigint")
    before = build.build_index(docs.join(first, "repo_id", "left_semi"), empty_g, empty_c, encoder, NOW)
    return build.build_index(docs, before.generations, before.cache, encoder, NOW + 1).reports.select(
        "repo_id", "generation", "files_seen", "files_indexed", F.size("files_skipped").alias("skipped"), "chunks", "embedded_new", "embedded_cached"
    )


def tool_results(spark: SparkSession, root: str) -> DataFrame:
    """All tool calls of all chats, made over one workspace of the files of all repositories."""
    rows = thread(spark, root).where("calls")
    calls = F.from_json(F.get_json_object("meta", "$.tool_calls"), "array<struct<name:string,arguments:string>>")
    made = rows.select("id", F.posexplode(calls).alias("k", "c")).select(F.concat_ws("#", "id", F.col("k").cast("string")).alias("call_id"), "c.name", "c.arguments")
    files = read_table(spark, root, "source_files").where(F.col("path").isNotNull()).groupBy("path").agg(F.min_by(F.coalesce("text", F.lit("")), "file_id").alias("text"))
    done = tools.dispatch(made, files)
    return done.select("call_id", "name", "error", F.size(F.coalesce("items", F.array().cast("array<string>"))).alias("n"), F.md5(F.array_join("items", "\n")).alias("digest"), "truncated")


_ATTEMPT = f"""att AS (SELECT id, conversation_id, CASE WHEN seq % 2 = 0 THEN 'propose_diff' ELSE 'run_command' END AS kind, [{', '.join(repr(x) for x in A.STATES)}][seq * 7 % {len(A.STATES)} + 1] AS status, seq, created_at FROM thread WHERE role = 'tool')"""
_PLAIN = """l AS (SELECT repo_id, doc, i, strlen(ls[i]) AS z, ls[i] AS line FROM (SELECT repo_id, doc, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
  n AS (SELECT repo_id, doc, count(*) AS n, list_prepend(0, list(c ORDER BY i)) AS cs FROM (SELECT repo_id, doc, i, sum(z) OVER (PARTITION BY doc ORDER BY i)::BIGINT AS c FROM l) GROUP BY ALL),
  w AS (SELECT repo_id, doc, n, cs, 0::BIGINT AS a, 0::BIGINT AS b FROM n UNION ALL
    SELECT repo_id, doc, n, cs, b AS a, CASE WHEN stop < n AND n - stop < 3 THEN greatest(stop - (3 - (n - stop)), b + 1) ELSE stop END AS b FROM (
      SELECT *, coalesce(list_max(list_filter(range(b + 1, least(b + 60, n) + 1), lambda s: s = b + 1 OR cs[s + 1] - cs[b + 1] + s - b - 1 <= 2400)), b + 1) AS stop FROM w WHERE b < n)),
  made AS (SELECT repo_id, doc, a FROM (SELECT w.repo_id, w.doc, a, line FROM w JOIN l ON l.doc = w.doc AND l.i BETWEEN a + 1 AND b WHERE b > 0) GROUP BY ALL HAVING bool_or(regexp_matches(line, '[^\\s\\p{Z}]')))"""

ORACLE = {
    "tool_results": f"""WITH {THREAD_SQL}, k AS (SELECT id, from_json(json_extract(meta, '$.tool_calls'), '[{{"name":"VARCHAR","arguments":"VARCHAR"}}]') AS cs FROM thread WHERE calls),
      a AS (SELECT id || '#' || (i - 1) AS call_id, cs[i].name AS name, cs[i].arguments AS args FROM (SELECT id, cs, unnest(range(1, len(cs) + 1)) AS i FROM k)),
      f AS (SELECT path, min_by(coalesce(text, ''), file_id) AS text FROM source_files WHERE path IS NOT NULL GROUP BY 1),
      v AS (SELECT path, string_split(path, '/') AS p, {LINES_SQL.format(t='text')} AS ls FROM f WHERE len(list_filter(string_split(lower(path), '/'), lambda p: p IN ('.git', 'target', 'node_modules') OR starts_with(p, '.env') OR starts_with(p, 'id_rsa')
        OR ends_with(p, '.pem') OR ends_with(p, '.key') OR ends_with(p, '.sqlite') OR contains(p, 'credentials') OR contains(p, 'secret'))) = 0),
      e AS (SELECT DISTINCT array_to_string(p[1:d - 1], '/') AS place, p[d] || CASE WHEN d < len(p) THEN '/' ELSE '' END AS entry FROM (SELECT p, unnest(range(1, len(p) + 1)) AS d FROM v)),
      g AS (SELECT place, list(entry ORDER BY entry) AS every FROM e GROUP BY 1),
      r AS (SELECT *, CASE WHEN json_valid(args) THEN json_extract_string(args, '$.path') END AS path, CASE WHEN json_valid(args) THEN json_extract_string(args, '$.query') END AS query FROM a),
      pl AS (SELECT *, coalesce(path, CASE WHEN name = 'list_files' THEN '.' END) AS given FROM r),
      q AS (SELECT *, CASE WHEN name IN ('list_files', 'read_file') THEN CASE WHEN given IS NULL THEN 'bad_arguments' WHEN contains(given, chr(0)) THEN 'nul_byte' WHEN starts_with(given, '/') THEN 'absolute' WHEN list_contains(string_split(given, '/'), '..') THEN 'outside' END
        WHEN name = 'search' THEN CASE WHEN coalesce(query, '') = '' THEN 'bad_arguments' END ELSE 'unknown_tool' END AS wrong, array_to_string(list_filter(string_split(given, '/'), lambda x: x NOT IN ('.', '')), '/') AS place FROM pl),
      h AS (SELECT query, path || ':' || i || ':' || {byte_cut_sql('line', 400)} AS item, row_number() OVER (PARTITION BY query ORDER BY p, i) AS k FROM (SELECT query, v.path, p, i, ls[i] AS line FROM (SELECT DISTINCT query FROM q WHERE name = 'search' AND wrong IS NULL), (SELECT path, p, ls, unnest(range(1, len(ls) + 1)) AS i FROM v) v WHERE contains(ls[i], query))),
      s AS (SELECT query, list(item ORDER BY k) FILTER (k <= 100) AS items, count(*) > 100 AS more FROM h GROUP BY 1),
      o AS (SELECT call_id, name, coalesce(wrong, CASE WHEN g.every IS NULL THEN 'not_found' END) AS error, g.every[1:200] AS items, coalesce(len(g.every) > 200, false) AS truncated FROM q LEFT JOIN g USING (place) WHERE name = 'list_files'
        UNION ALL SELECT call_id, name, coalesce(wrong, CASE WHEN v.path IS NULL THEN 'not_found' END), v.ls[1:201], coalesce(len(v.ls) > 201, false) FROM q LEFT JOIN v ON v.path = q.place WHERE name = 'read_file'
        UNION ALL SELECT call_id, name, wrong, CASE WHEN wrong IS NULL THEN coalesce(s.items, []) END, coalesce(s.more, false) FROM q LEFT JOIN s ON s.query = q.query WHERE name = 'search'
        UNION ALL SELECT call_id, name, wrong, NULL, false FROM q WHERE wrong = 'unknown_tool')
      SELECT call_id, name, error, coalesce(len(items), 0)::INT AS n, CASE WHEN error IS NULL THEN md5(array_to_string(items, chr(10))) END AS digest, truncated FROM o""",
    "pending_attempts": f"WITH {THREAD_SQL}, {_ATTEMPT} SELECT id, conversation_id, kind FROM att WHERE status = 'proposed'",
    "decided_attempts": f"""WITH {THREAD_SQL}, {_ATTEMPT} SELECT id, CASE WHEN status <> 'proposed' THEN status WHEN seq % 2 = 0 THEN 'approved' ELSE 'denied' END AS status,
      CASE WHEN status = 'proposed' THEN {NOW} ELSE created_at END AS updated_at, CASE WHEN status <> 'proposed' THEN 'not_proposed' END AS error FROM att""",
    "finished_attempts": f"""WITH {THREAD_SQL}, {_ATTEMPT}, r AS (SELECT *, kind = 'run_command' AND status = 'approved' AS mine, (length(id) + ascii(right(id, 1))) % 3 AS code FROM att)
      SELECT id, CASE WHEN NOT mine THEN status WHEN code = 2 THEN 'cancelled' WHEN code = 0 THEN 'passed' ELSE 'failed' END AS status, CASE WHEN mine THEN code END AS exit_code FROM r UNION ALL SELECT 'nobody', 'not_found', NULL""",
    "inserted_attempts": f"""WITH {THREAD_SQL}, {_ATTEMPT}, new AS (SELECT conversation_id, conversation_id IN (SELECT id FROM conversations WHERE id IS NOT NULL) AS there FROM thread WHERE role = 'assistant' AND calls)
      SELECT conversation_id AS key, 'kept' AS what, count(*) AS n FROM (SELECT conversation_id FROM att UNION ALL SELECT conversation_id FROM new WHERE there) GROUP BY 1
      UNION ALL SELECT '', 'not_found', count(*) FROM new WHERE NOT there HAVING count(*) > 0""",
    "evaluation": f"""WITH {THREAD_SQL}, {_ATTEMPT}, t AS (SELECT conversation_id, sum(CASE WHEN kind = 'propose_diff' AND status = 'applied' THEN 1 ELSE 0 END) AS patches, sum(CASE WHEN kind = 'run_command' THEN 1 ELSE 0 END) AS runs FROM att GROUP BY 1),
      f AS (SELECT conversation_id, status = 'passed' AS passed FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, id) AS k FROM att WHERE kind = 'run_command') WHERE k = 1),
      c AS (SELECT conversation_id, sum(CASE WHEN json_valid(meta) THEN coalesce(json_array_length(json_extract(meta, '$.tool_calls')), 0) ELSE 0 END)::BIGINT AS calls, max_by(role IS DISTINCT FROM 'tool', seq) AS pass FROM thread GROUP BY 1),
      a AS (SELECT c.conversation_id, coalesce(patches, 0)::BIGINT AS patches_applied, coalesce(runs, 0)::BIGINT AS commands_run, calls AS tool_calls_total, coalesce(pass, false) AS pass, coalesce(pass, false) AND coalesce(patches, 0) = 1 AND coalesce(passed, false) AS first
        FROM c LEFT JOIN t USING (conversation_id) LEFT JOIN f USING (conversation_id))
      SELECT conversation_id, patches_applied, commands_run, tool_calls_total, first AS first_attempt_pass, pass AND NOT first AS repaired_pass, patches_applied >= 1 AND commands_run >= 1 AS plumbing_ok FROM a""",
    "run_statuses": """SELECT CASE WHEN event_type = 'refund' THEN 'cancelled' WHEN value > 90 THEN 'timeout' WHEN event_id % 5 > 0 THEN 'passed' ELSE 'failed' END AS status, count(*) AS n FROM events GROUP BY 1""",
    "renamed_conversations": """WITH c AS (SELECT id, max(title) AS title, max(mode) AS mode, max(repo_path) AS repo_path FROM conversations GROUP BY 1)
      SELECT id, CASE WHEN mode = 'balanced' THEN 'About ' || title ELSE title END AS title, CASE WHEN mode = 'balanced' THEN NULL ELSE repo_path END AS repo_path FROM c UNION ALL SELECT 'nobody', 'not_found', NULL""",
    "touched_conversations": f"""WITH {THREAD_SQL}, t AS (SELECT conversation_id, max(created_at) AS moment FROM thread WHERE role = 'assistant' GROUP BY 1)
      SELECT c.id, greatest(c.updated_at, coalesce(moment, c.updated_at)) AS updated_at FROM (SELECT id, max(updated_at) AS updated_at FROM conversations GROUP BY 1) c LEFT JOIN t ON t.conversation_id = c.id""",
    "sent_messages": f"""WITH {THREAD_SQL}, c AS (SELECT id, max(updated_at) AS updated_at, max(mode) AS mode FROM conversations GROUP BY 1),
      e AS (SELECT *, CASE WHEN mode = 'quiet' THEN 'empty' WHEN NOT coalesce(mode <> 'performance', false) THEN 'busy' END AS error, 'what about ' || id AS body FROM c),
      t AS (SELECT conversation_id, max(seq) AS last, bool_or(role = 'user') AS talked FROM thread WHERE role IN ('system', 'user', 'assistant', 'tool') GROUP BY 1)
      SELECT e.id, CASE WHEN error IS NULL AND NOT coalesce(talked, false) THEN trim(left(body, 48)) ELSE 'New chat' END AS title, CASE WHEN error IS NULL THEN greatest(updated_at, {NOW}) ELSE updated_at END AS updated_at,
        CASE WHEN error IS NULL THEN coalesce(last, 0) + 1 END AS seq, CASE WHEN error IS NULL THEN body END AS content, error FROM e LEFT JOIN t ON t.conversation_id = e.id""",
    "deleted_repos": """WITH g AS (SELECT DISTINCT repo_id, generation, finished_at, vector_file FROM index_generations), few AS (SELECT repo_id FROM g GROUP BY 1 HAVING count(finished_at) < 3),
      v AS (SELECT DISTINCT vector_file, chunk_id FROM index_vectors)
      SELECT 'repos' AS table_name, count(DISTINCT repo_id) AS n FROM g WHERE repo_id NOT IN (SELECT repo_id FROM few) UNION ALL SELECT 'generations', count(*) FROM g WHERE repo_id NOT IN (SELECT repo_id FROM few)
      UNION ALL SELECT 'chunks', count(*) FROM g JOIN v USING (vector_file) WHERE repo_id NOT IN (SELECT repo_id FROM few)""",
    "digest_finds": """WITH c AS (SELECT repo_id, chunk_id AS id, digest_hex AS digest, message_id FROM citations WHERE digest_hex IS NOT NULL AND chunk_id IS NOT NULL),
      o AS (SELECT repo_id, digest FROM c GROUP BY 1, 2 HAVING count(DISTINCT message_id) > 1), g AS (SELECT DISTINCT repo_id, generation FROM index_generations WHERE finished_at IS NOT NULL)
      SELECT repo_id, digest, generation, id, row_number() OVER (PARTITION BY repo_id, digest ORDER BY generation DESC, id) AS place FROM (SELECT DISTINCT repo_id, id, digest FROM c) JOIN o USING (repo_id, digest) JOIN g USING (repo_id)""",
    "citation_zip": """WITH a AS (SELECT message_id, n, row_number() OVER (PARTITION BY message_id ORDER BY n NULLS FIRST, path NULLS FIRST, start_line NULLS FIRST) AS place FROM (SELECT DISTINCT message_id, n, path, start_line FROM citations WHERE message_id IS NOT NULL)),
      b AS (SELECT message_id, chunk_id, row_number() OVER (PARTITION BY message_id ORDER BY chunk_id) AS place FROM (SELECT DISTINCT message_id, chunk_id FROM citations WHERE message_id IS NOT NULL AND chunk_id IS NOT NULL))
      SELECT message_id, place, n, chunk_id FROM a JOIN b USING (message_id, place)""",
    "reply_metas": f"""WITH {THREAD_SQL}, c AS (SELECT message_id AS id, list(n ORDER BY n) AS cites FROM (SELECT DISTINCT message_id, n FROM citations WHERE message_id IS NOT NULL AND n IS NOT NULL) GROUP BY 1)
      SELECT t.id, to_json(struct_pack(status := 'done', finish := CASE WHEN json_valid(meta) THEN json_extract_string(meta, '$.finish') END, new_tokens := CASE WHEN json_valid(meta) THEN json_extract_string(meta, '$.new_tokens')::BIGINT END,
        called := calls, citations := coalesce(cites, []::INT[])))::VARCHAR AS meta FROM thread t LEFT JOIN c ON c.id = t.id WHERE role = 'assistant'""",
    "reusable_generations": """WITH g AS (SELECT repo_id, generation, max(recipe) AS recipe, max(dim) AS dim FROM index_generations LEFT JOIN (SELECT vector_file, dim FROM index_meta) USING (vector_file) GROUP BY 1, 2)
      SELECT concat_ws('#', a.repo_id, a.generation) AS key, b.repo_id IS NOT NULL AND a.recipe IS NOT DISTINCT FROM b.recipe AND a.dim IS NOT DISTINCT FROM b.dim AS reusable FROM g a LEFT JOIN g b ON b.repo_id = a.repo_id AND b.generation + 1 = a.generation""",
    "recipe_guard": f"""SELECT repo_id, generation, CASE WHEN recipe IS DISTINCT FROM '{RECIPE}' THEN 'recipe' END AS error FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY generation DESC) AS k FROM index_generations WHERE finished_at IS NOT NULL) WHERE k = 1""",
    "recipes": "SELECT 'hashed-tokens|search_document|dim' || dim || '|v1' AS recipe, count(*) AS n FROM index_meta GROUP BY 1",
    "allowed_candidates": """SELECT c_nationkey, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 0 OR (n_regionkey > 1 AND c_mktsegment IN ('BUILDING', 'MACHINERY')) GROUP BY 1""",
    "mode_budgets": """SELECT mode, CASE lower(trim(mode)) WHEN 'balanced' THEN 1024 WHEN 'performance' THEN 2048 ELSE 512 END AS input_tokens, CASE lower(trim(mode)) WHEN 'balanced' THEN 512 WHEN 'performance' THEN 1024 ELSE 256 END AS prefill_tokens, count(*) AS n
      FROM (SELECT id, max(mode) AS mode FROM conversations GROUP BY 1) GROUP BY 1""",
    "prefix_reuse": f"""WITH {THREAD_SQL}, u AS (SELECT conversation_id, seq, list_filter(string_split_regex(content, '[ \n]+'), lambda w: w <> '') AS ids FROM thread WHERE role = 'user'),
      p AS (SELECT conversation_id, seq, ids, coalesce(lag(ids) OVER (PARTITION BY conversation_id ORDER BY seq), []) AS cached FROM u),
      s AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(ids), len(cached)) + 1), lambda i: ids[i] <> cached[i])) - 1, least(len(ids), len(cached))) AS same FROM p WHERE len(ids) > 0),
      r AS (SELECT conversation_id, seq, len(ids) AS n, CASE WHEN same = len(ids) THEN same - 1 ELSE same END AS reused FROM s)
      SELECT conversation_id, seq, reused, n - reused AS fed, ceil((n - reused) / 16.0)::INT AS chunks FROM r""",
    "control_ids": "SELECT vec_id, len(embedding) AS n, len(list_filter(embedding, lambda x: floor(abs(x::DOUBLE) * 6000) < 1000)) AS control FROM embeddings",
    "migrated_conversations": "SELECT id, repo_path, lower(mode) AS mode, left(title, 20) AS shown FROM (SELECT DISTINCT id, title, repo_path, mode FROM conversations)",
    "begun_generations": f"""WITH n AS (SELECT repo_id, coalesce(max(generation), 0) + 1 AS generation FROM index_generations GROUP BY 1)
      SELECT repo_id, generation, CASE WHEN repo_id < 'm' THEN {NOW} END AS finished_at, CASE WHEN repo_id < 'm' THEN 7 END AS chunk_count, NULL::VARCHAR AS error FROM n UNION ALL SELECT 'nobody', 1, NULL, NULL, 'not_found'""",
    "numbered_files": "SELECT file_id, row_number() OVER (ORDER BY repo_id, path, file_id) + 100 AS number FROM (SELECT DISTINCT repo_id, coalesce(path, '') AS path, file_id FROM source_files)",
    "cache_touches": f"""WITH c AS (SELECT * FROM citations WHERE digest_hex IS NOT NULL AND chunk_id IS NOT NULL), b AS (SELECT repo_id FROM c GROUP BY 1 ORDER BY count(*) DESC, repo_id LIMIT 1),
      a AS (SELECT DISTINCT digest_hex FROM c WHERE repo_id IN (SELECT repo_id FROM b)), d AS (SELECT DISTINCT digest_hex FROM c)
      SELECT digest_hex IN (SELECT digest_hex FROM a) AS fresh, count(*) AS n, (SELECT count(*) FROM a) AS hits FROM d GROUP BY 1""",
    "refresh_reasons": """WITH now AS (SELECT DISTINCT repo_id, path, size, mtime_ns FROM source_files WHERE path IS NOT NULL), u AS (SELECT recipe FROM (SELECT DISTINCT * FROM index_generations) GROUP BY 1 ORDER BY count(*) DESC, recipe LIMIT 1),
      l AS (SELECT repo_id, generation, recipe, vector_file FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY generation DESC) AS k FROM index_generations WHERE finished_at IS NOT NULL) WHERE k = 1),
      r AS (SELECT repo_id, max(generation) AS listed FROM index_reports GROUP BY 1), m AS (SELECT DISTINCT repo_id FROM now WHERE repo_id IN (SELECT repo_id FROM r)),
      t AS (SELECT repo_id, bool_or(ends_with(path, '.rs') AND size IS NOT NULL) AS touched FROM now GROUP BY 1), everyone AS (SELECT repo_id FROM now UNION SELECT repo_id FROM index_generations)
      SELECT e.repo_id, CASE WHEN l.generation IS NULL THEN 'no_index' WHEN l.recipe IS DISTINCT FROM (SELECT recipe FROM u) THEN 'recipe' WHEN m.repo_id IS NULL OR r.listed IS DISTINCT FROM l.generation THEN 'generation'
          WHEN l.vector_file IS NULL OR l.vector_file NOT IN (SELECT vector_file FROM index_meta) THEN 'missing_file' WHEN t.touched IS NULL OR t.touched THEN 'files' END AS reason
      FROM everyone e LEFT JOIN l USING (repo_id) LEFT JOIN r USING (repo_id) LEFT JOIN m ON m.repo_id = e.repo_id LEFT JOIN t ON t.repo_id = e.repo_id""",
    "index_build": f"""WITH RECURSIVE s AS (SELECT coalesce(source, '-') AS repo_id, doc_id AS doc, text, coalesce(strlen(text) > 100000, false) AS large FROM documents),
      first AS (SELECT repo_id FROM s GROUP BY 1 ORDER BY count(*) DESC, repo_id LIMIT 1),
      d AS (SELECT repo_id, s.doc, ls FROM s JOIN ({DOC_LINES}) x ON x.doc_id = s.doc WHERE NOT large), {_PLAIN},
      c AS (SELECT repo_id, count(*) AS chunks FROM made GROUP BY 1)
      SELECT s.repo_id, CASE WHEN s.repo_id IN (SELECT repo_id FROM first) THEN 2 ELSE 1 END AS generation, count(*) AS files_seen, sum(CASE WHEN NOT large AND text IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS files_indexed,
        sum(CASE WHEN large THEN 1 ELSE 0 END)::INT AS skipped, coalesce(any_value(chunks), 0) AS chunks, CASE WHEN s.repo_id IN (SELECT repo_id FROM first) THEN 0 ELSE coalesce(any_value(chunks), 0) END AS embedded_new,
        CASE WHEN s.repo_id IN (SELECT repo_id FROM first) THEN coalesce(any_value(chunks), 0) ELSE 0 END AS embedded_cached FROM s LEFT JOIN c USING (repo_id) GROUP BY 1""",
}

QUERIES = (
    pending_attempts, decided_attempts, finished_attempts, inserted_attempts, evaluation, run_statuses, renamed_conversations, touched_conversations, sent_messages, deleted_repos, digest_finds, citation_zip,
    reply_metas, reusable_generations, recipe_guard, recipes, allowed_candidates, mode_budgets, prefix_reuse, control_ids, migrated_conversations, begun_generations, numbered_files, cache_touches, refresh_reasons, index_build, tool_results,
)
