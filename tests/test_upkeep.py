"""Index upkeep, store transitions and context building on small cases."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import context, index, store

MESSAGE = "id string, conversation_id string, seq long, role string, content string, created_at long, calls boolean"


def messages(spark, roles, calls=()):
    return spark.createDataFrame([(f"m{i}", "c", i, r, f"t{i}", 10 * i, i in calls) for i, r in enumerate(roles, 1)], MESSAGE)


def test_changed_files(spark):
    schema = "repo_id string, path string, size long, mtime_ns long"
    new = spark.createDataFrame([("r", "a", 1, 1), ("r", "b", 2, None), ("r", "n", 1, 1)], schema)
    old = spark.createDataFrame([("r", "a", 1, 2), ("r", "b", 2, None), ("r", "o", 1, 1)], schema)
    assert {(r.path, r.change) for r in index.changed_files(new, old).collect()} == {("a", "modified"), ("n", "added"), ("o", "removed")}
    assert index.unchanged_repos(new, new).first().unchanged


def test_generations(spark):
    rows = [("r", g, g * 10 if g < 5 else None) for g in range(1, 6)] + [("s", 1, None)]
    table = spark.createDataFrame(rows, "repo_id string, generation long, finished_at long")
    kept = {(r.repo_id, r.generation) for r in index.prune_generations(table, 2).collect()}
    assert kept == {("r", 3), ("r", 4), ("r", 5), ("s", 1)}
    assert [(r.repo_id, r.generation) for r in index.latest_generation(table).collect()] == [("r", 4)]
    assert {r.repo_id: r.next_generation for r in index.next_generation(table).collect()} == {"r": 6, "s": 2}


def test_lru(spark):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00", 16), ("b", "2024-01-01 00:00:01", 16), ("c", "2024-01-02 00:00:00", 16)], "k string, at string, bytes long")
    rows = rows.withColumn("at", rows["at"].cast("timestamp"))
    kept = lambda budget: {r.k for r in index.evict_lru(rows, "k", "at", "bytes", budget).collect()}
    assert kept(32) == {"b", "c"} and kept(0) == set() and kept(100) == {"a", "b", "c"} and kept(16) == {"c"}


def test_upsert_and_cache(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (2, "y"), (3, "z")], "k int, v string")
    assert {tuple(r) for r in index.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "y"), (3, "z")}
    wanted = spark.createDataFrame([("r", "d1"), ("r", "d2")], "recipe string, digest string")
    assert {r.digest: r.hit for r in index.cache_lookup(wanted, wanted.limit(0).unionByName(spark.createDataFrame([("r", "d1")], wanted.schema))).collect()} == {"d1": True, "d2": False}


def test_citations(spark):
    import hashlib

    good = hashlib.sha256(b"p\x001\x00a\nb").hexdigest()
    files = spark.createDataFrame([("r", "p", "a\nb\nc\n"), ("r", "e", None)], "repo_id string, path string, text string")
    rows = [("r", "p", 1, 2, good), ("r", "p", 2, 3, good), ("r", "p", 3, 9, good), ("r", "q", 1, 1, good), ("r", "p", 2, 1, good), ("r", "e", 1, 1, good), ("r", "p", 1, 2, None)]
    cited = spark.createDataFrame(rows, "repo_id string, path string, start_line long, end_line long, digest_hex string")
    got = sorted((r.path, r.start_line, r.end_line, r.digest_hex is None, r.status) for r in index.verify_citations(cited, files).collect())
    assert [x[-1] for x in got] == ["file_changed", "verified", "file_changed", "file_changed", "file_changed", "file_changed", "missing"]


def test_context_block(spark):
    hits = spark.createDataFrame([(1, 1, "a.rs", "fn x() {}"), (1, 2, "b.md", "has ``` inside [end]")], "query_id int, rank int, path string, content string")
    whole = index.pack_context(hits, 10_000, "H\n", "\n[end]").first()
    assert whole.n_hits == 2 and whole.text.startswith("H\n\n[1] a.rs\n```rust\nfn x() {}\n```\n") and "````markdown" in whole.text and whole.bytes == len(whole.text.encode())
    assert index.pack_context(hits, 40, "H\n", "\n[end]").first().n_hits == 1
    assert index.pack_context(hits, 10, "H\n", "\n[end]").first().text == "H\n\n[end]"


def test_truncate_regenerate_delete(spark):
    rows = messages(spark, ["system", "user", "assistant", "user", "assistant"])
    attempts = spark.createDataFrame([("x", "m3", "c"), ("y", "m5", "c"), ("z", None, "c")], "id string, message_id string, conversation_id string")
    left, kept = store.truncate_after(rows, attempts, spark.createDataFrame([("c", 3)], "conversation_id string, seq long"))
    assert left.count() == 3 and {r.id for r in kept.collect()} == {"x", "z"}
    assert store.regenerate_points(rows).first().seq == 4
    heads = spark.createDataFrame([("c",), ("d",)], "id string")
    assert [t.count() for t in store.delete_conversations(heads, rows, attempts, heads.where("id = 'c'"))] == [1, 0, 0]


def test_all_conversations_are_listed(spark, tmp_path):
    from millrace.plans import upkeep

    rows = [(f"c{i:03}", i * 7 % 50) for i in range(230)]
    spark.createDataFrame([*rows, rows[3]], "id string, updated_at long").write.parquet(f"{tmp_path}/conversations.parquet")
    got = [(r.id, r.updated_at) for r in upkeep.conversations_ordered(spark, str(tmp_path)).collect()]
    assert got == sorted(rows, key=lambda r: (r[1], r[0]), reverse=True)


def test_orphans_of_two_columns(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", None), ("b", 1), ("b", None), (None, 1)], "repo_id string, generation long")
    parent = spark.createDataFrame([("a", 1), ("a", 1), (None, 2)], "repo_id string, generation long")
    left = [tuple(r) for r in store.orphans(rows, "repo_id", parent, "repo_id", ("generation",)).collect()]
    assert sorted(left, key=str) == [("a", 2), ("b", 1), ("b", None)]


def test_orphan_check_tells_generations_apart(spark, tmp_path):
    from millrace.plans import upkeep

    tables = {"messages": "id string, conversation_id string", "conversations": "id string", "citations": "message_id string"}
    for name, schema in tables.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, rows in {"index_reports": [("a", 1), ("a", 2)], "index_generations": [("a", 2), ("a", 3)]}.items():
        spark.createDataFrame(rows, "repo_id string, generation long").write.parquet(f"{tmp_path}/{name}.parquet")
    assert {r.problem: r.n for r in upkeep.orphan_check(spark, str(tmp_path)).collect()}["reports_without_generation"] == 1


def test_append(spark):
    rows = messages(spark, ["user"])
    new = messages(spark, ["assistant", "user"]).drop("seq")
    assert [r.seq for r in store.append_messages(rows, new).orderBy("seq").collect()] == [1, 2, 3]
    with pytest.raises(Exception, match="unknown role"):
        store.append_messages(rows, messages(spark, ["bot"]).drop("seq")).collect()


def test_append_over_hours(spark):
    schema = "id string, conversation_id string, role string, content string, created_at long"
    times = [5, 5, None, 3_600_000, 7_200_000, 4, 90_000_000, 3_599_999]
    new = spark.createDataFrame([(f"n{i}", "c", "user", "x", t) for i, t in enumerate(times)] + [("m", "d", "user", "x", 1)], schema)
    old = spark.createDataFrame([("o", "c", 7, "user", "x", 0)], "id string, conversation_id string, seq long, role string, content string, created_at long")
    got = {r.id: r.seq for r in store.append_messages(old, new).collect()}
    order = sorted(range(len(times)), key=lambda i: (-1 if times[i] is None else times[i], f"n{i}"))
    assert got == {"o": 7, "m": 1} | {f"n{i}": 8 + k for k, i in enumerate(order)}


def test_merge_and_slice(spark):
    rows = messages(spark, ["user", "user", "assistant", "assistant", "tool", "tool", "assistant"], calls={4})
    merged = context.merge_roles(rows).orderBy("seq").collect()
    assert [(r.seq, r.merged) for r in merged] == [(1, 2), (3, 1), (4, 1), (5, 1), (6, 1), (7, 1)] and merged[0].content == "t1\n\nt2"
    marked = messages(spark, ["user", "assistant", "system", "user"])
    assert [r.seq for r in context.after_last_marker(marked).collect()] == [4]
    assert context.history(marked).count() == 3


def test_budget(spark):
    rows = messages(spark, ["user", "assistant", "user", "assistant", "tool", "assistant"], calls={4}).withColumn("tokens", F.lit(10))
    fit = lambda n: tuple(context.fit_budget(rows, n).select("kept", "dropped", "tokens", "fits").first())
    assert fit(60) == (6, 0, 60, True) and fit(59) == (4, 2, 40, True) and fit(30) == (2, 4, 20, True) and fit(5) == (1, 5, 10, False)


def test_deltas(spark):
    rows = spark.createDataFrame([("s", 0, "a"), ("s", 10, "b"), ("s", 45, "c"), ("s", 50, "d"), ("s", 100, "e"), ("t", 5, "x")], "stream_id string, at_ms long, piece string")
    got = [(r.stream_id, r.text) for r in context.coalesce_deltas(rows).orderBy("stream_id", "flush").collect()]
    assert got == [("s", "abc"), ("s", "de"), ("t", "x")]


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_blocks_change_nothing(spark, block):
    """Merging and budgets over random chats, cut into blocks of any size, against a plain loop."""
    import random

    rng = random.Random(5)
    chats = {f"c{n}": [(rng.choice(["user", "assistant", "assistant", "tool"]), rng.random() < 0.2, rng.randint(1, 9)) for _ in range(rng.randint(1, 14))] for n in range(60)}
    rows = [(f"{c}-{i}", c, 2 * i + 1, r, f"t{i}", call and r == "assistant", n) for c, chat in chats.items() for i, (r, call, n) in enumerate(chat)]
    table = spark.createDataFrame(rows, "id string, conversation_id string, seq long, role string, content string, calls boolean, tokens long")
    want, fits = set(), {}
    for c, chat in chats.items():
        islands = []
        for i, (role, call, _) in enumerate(chat):
            call = call and role == "assistant"
            if islands and islands[-1][1] == role and role != "tool" and not call and not islands[-1][3]:
                islands[-1][2] += 1
            else:
                islands.append([2 * i + 1, role, 1, call])
        want |= {(c, seq, role, n) for seq, role, n, _ in islands}
        users = [i for i, x in enumerate(chat) if x[0] == "user"]
        units, fixed = {}, None
        for i, (role, _, n) in enumerate(chat):
            if not users:
                key, fixed = 0, 0
            elif i < users[-1]:
                key = max((u for u in users if u <= i), default=-1)
            else:
                key, fixed = max([users[-1]] + [j for j in range(users[-1] + 1, i + 1) if chat[j][0] == "assistant"]), users[-1]
            units.setdefault(key, []).append(n)
        left = sorted(units)
        while sum(sum(units[u]) for u in left) > 15 and any(u != fixed for u in left):
            left.remove(next(u for u in left if u != fixed))
        fits[c] = (sum(len(units[u]) for u in left), sum(sum(units[u]) for u in left))
    assert {(r.conversation_id, r.seq, r.role, r.merged) for r in context.merge_roles(table, block).collect()} == want
    assert {r.conversation_id: (r.kept, r.tokens) for r in context.fit_budget(table, 15, block).collect()} == fits


def test_changes_and_what_is_not_there(spark):
    table = spark.createDataFrame([("a", "x", "p"), ("b", "y", None)], "id string, title string, repo string")
    changes = spark.createDataFrame([("a", None), ("z", "q")], "id string, repo string")
    assert {tuple(r) for r in store.set_fields(table, ["id"], changes).collect()} == {("a", "x", None), ("b", "y", None)}
    assert [tuple(r) for r in store.not_found(table, ["id"], changes).collect()] == [("z", "not_found")]
    a = spark.createDataFrame([(1, 5), (1, None), (2, None)], "k int, x int")
    b = spark.createDataFrame([(1, 6), (2, None), (3, 1)], "k int, x int")
    assert {(r.k, r.reusable) for r in store.reusable(a, b, "k", ["x"]).collect()} == {(1, False), (2, True), (3, False)}
    requests = spark.createDataFrame([(1, None), (2, ["u"]), (3, [])], "k int, allowed array<string>")
    some = spark.createDataFrame([(k, v) for k in (1, 2, 3) for v in ("u", "v")], "k int, id string")
    assert {tuple(r) for r in store.allowed(some, requests, "k", "id").collect()} == {(1, "u"), (1, "v"), (2, "u")}
    zipped = store.zip_positional(spark.createDataFrame([(1, 30), (1, 10)], "k int, n int"), spark.createDataFrame([(1, "b"), (1, "a"), (1, "c")], "k int, h string"), "k", ["n"], ["h"])
    assert {(r.n, r.h) for r in zipped.collect()} == {(10, "a"), (30, "b")}


def test_attempts(spark):
    from millrace.operators import attempts as A

    schema = "id string, conversation_id string, message_id string, kind string, status string, exit_code int, created_at long, updated_at long"
    table = spark.createDataFrame([("p1", "c", None, "propose_diff", "proposed", None, 1, 1), ("p2", "c", None, "propose_diff", "applied", None, 2, 2), ("r1", "c", None, "run_command", "failed", 1, 3, 3), ("r2", "c", None, "run_command", "passed", 0, 4, 4)], schema)
    after, refused = A.decide(table, spark.createDataFrame([("p1", True, 9), ("p2", True, 9), ("zz", False, 9)], "id string, approve boolean, at long"))
    assert {r.id: r.status for r in after.collect()}["p1"] == "approved" and {r.id for r in refused.collect()} == {"p2", "zz"} and A.pending(after).count() == 0
    calls, verdict = spark.createDataFrame([("c", 2), ("c", 1)], "conversation_id string, n int"), spark.createDataFrame([("c", True), ("d", True)], "conversation_id string, held_out_pass boolean")
    rows = {r.conversation_id: r for r in A.evaluation(table, calls, verdict).collect()}
    assert tuple(rows["c"])[1:] == (1, 2, 3, False, True, True) and tuple(rows["d"])[1:] == (0, 0, 0, False, True, False)
    first = A.evaluation(table.where("id <> 'r1'"), calls, verdict).where("conversation_id = 'c'").first()
    assert first.first_attempt_pass and not first.repaired_pass
    done, lost = A.finish(table, spark.createDataFrame([("p1", "cancelled", None, 8), ("q", "passed", 0, 8)], "id string, status string, exit_code int, updated_at long"))
    assert {r.id: r.status for r in done.collect()}["p1"] == "cancelled" and [r.id for r in lost.collect()] == ["q"]
    new = spark.createDataFrame([("n1", "c", None, "run_command", 5), ("n2", "gone", None, "run_command", 5)], "id string, conversation_id string, message_id string, kind string, created_at long")
    more, none = A.insert(table, new, spark.createDataFrame([("c",)], "id string"))
    assert more.where("status = 'proposed'").count() == 2 and [r.id for r in none.collect()] == ["n2"]


def test_send(spark):
    heads = spark.createDataFrame([("a", "New chat", 1), ("b", "New chat", 1), ("c", "Old", 1)], "id string, title string, updated_at long")
    talk = spark.createDataFrame([("m", "b", 1, "user", "hi", 1)], "id string, conversation_id string, seq long, role string, content string, created_at long")
    sends = spark.createDataFrame([("1", "a", "  How  are you? " + "x" * 60, 5, True), ("2", "b", "more", 6, True), ("3", "c", " ", 7, True), ("4", "c", "now", 8, False), ("5", "z", "who", 9, True)], "id string, conversation_id string, text string, created_at long, admitted boolean")
    named, messages, errors = store.send(heads, talk, sends)
    assert {r.id: (r.title, r.updated_at) for r in named.collect()} == {"a": ("How  are you? " + "x" * 34, 5), "b": ("New chat", 6), "c": ("Old", 1)}
    assert {(r.id, r.seq) for r in messages.collect()} == {("m", 1), ("1", 1), ("2", 2)} and {(r.id, r.error) for r in errors.collect()} == {("3", "empty"), ("4", "busy"), ("5", "not_found")}


def test_search_report(spark):
    from millrace.operators import textual

    files = spark.createDataFrame([("a/z.txt", "hit\nno\nhit"), ("a.txt", "hit"), ("b/bin", "hit\x00"), ("c.txt", "no"), ("d.txt", "hit hit"), (".env", "hit"), ("x/my-secret/f", "hit"), (None, "hit")], "path string, text string")
    report = lambda n: tuple(textual.search_report(files, "hit", n).first())
    assert report(9) == (4, False, 4, 1) and report(3) == (3, True, 4, 1) and report(2) == (2, True, 2, 0) and report(0) == (0, True, 1, 0)


def test_refresh_reasons(spark):
    g = spark.createDataFrame([("a", 1, 5, "f1", "r"), ("b", 1, 5, "f2", "old"), ("c", 2, 5, "f3", "r"), ("d", 1, 5, "f4", "r"), ("e", 1, 5, "f5", "r"), ("f", 1, None, "f6", "r")], "repo_id string, generation long, finished_at long, vector_file string, recipe string")
    now = spark.createDataFrame([(r, "x", 1, 1) for r in "abcdef"], "repo_id string, path string, size long, mtime_ns long")
    manifest = spark.createDataFrame([(r, 1, "x", 2 if r == "e" else 1, 1) for r in "abcdef"], "repo_id string, generation long, path string, size long, mtime_ns long")
    files = spark.createDataFrame([(f"f{i}",) for i in (1, 2, 3, 5)], "vector_file string")
    got = {r.repo_id: r.reason for r in index.refresh_reason(now, now, manifest, g, files, "r").collect()}
    assert got == {"a": None, "b": "recipe", "c": "generation", "d": "missing_file", "e": "files", "f": "no_index"}


def test_build_twice(spark):
    """A second build encodes only what changed, numbers go on, and two finished generations stay."""
    from millrace.operators import build

    schema = "repo_id string, path string, size long, mtime_ns long, text string, skip_reason string"
    files = [("r", f"f{i}.txt", 1, 1, "\n".join(f"line {j} of file {i}" for j in range(70)), None) for i in range(4)] + [("r", "key.pem", 1, 1, None, "secret"), ("s", "a.md", 1, 1, "# A\nb\nc\n", None), ("s", "void.txt", 0, 1, "", None)]
    none = spark.createDataFrame([], "repo_id string, generation long, created_at long, finished_at long, vector_file string, chunk_count long, recipe string")
    cache = spark.createDataFrame([], "recipe string, digest string, vector array<double>, bytes long, last_used long")
    encoder, stages = build.HashedEncoder(16), []
    one = build.build_index(spark.createDataFrame(files, schema), none, cache, encoder, 1000, stages.append)
    first = {r.repo_id: r for r in one.reports.collect()}
    assert stages[0] == "chunk" and (first["r"].files_seen, first["r"].files_indexed, first["r"].chunks, first["r"].embedded_new, first["r"].embedded_cached) == (5, 4, 8, 8, 0)
    assert [(x.path, x.reason) for x in first["r"].files_skipped] == [("key.pem", "secret")] and sorted(r.id for r in one.chunks.collect()) == list(range(1, 10))
    assert one.vectors.count() == 9 and one.manifest.where("repo_id = 'r'").count() == 4
    files[0] = ("r", "f0.txt", 2, 2, files[0][4].replace("line 0 ", "LINE 0 "), None)
    two = build.build_index(spark.createDataFrame(files, schema), one.generations, one.cache, encoder, 2000)
    second = {r.repo_id: r for r in two.reports.collect()}
    assert (second["r"].generation, second["r"].embedded_new, second["r"].embedded_cached) == (2, 1, 7) and second["s"].embedded_new == 0
    three = build.build_index(spark.createDataFrame(files, schema), two.generations, two.cache, encoder, 3000)
    assert {(r.repo_id, r.generation) for r in three.generations.collect()} == {("r", 2), ("r", 3), ("s", 2), ("s", 3)}
    assert {r.last_used for r in three.cache.collect()} == {1000, 3000} and three.cache.count() == 10
    assert {r.error for r in build.guard(three.generations, encoder.recipe).collect()} == {None} and {r.error for r in build.guard(three.generations, "other").collect()} == {"recipe"}


def test_numbers_follow_the_order(spark):
    rows = spark.createDataFrame([(i * 37 % 100, "x") for i in range(100)], "k int, v string").repartition(7)
    assert {r.k: r.n for r in index.number_rows(rows, ["k"], "n", 5).collect()} == {k: k + 5 for k in range(100)}
    assert index.number_rows(rows.limit(0), ["k"], "n").count() == 0

