"""Text functions against pinned and hand-made values."""

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.hashing import fnv1a64
from millrace.operators import textual
from millrace.sources.fnv import fnv1a64 as fnv_bytes


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_tokens_pin(spark):
    want = "kvcache_trimto kv cache trim to httpserver http server utf8decode utf8 decode x1".split()
    assert one(spark, "KVCache_trimTo(HTTPServer, utf8Decode) a x1", T.tokens) == want


def test_tokens_edges(spark):
    assert one(spark, "", T.tokens) == []
    assert one(spark, "__a__ _ é_ü ÄrgerNis", T.tokens) == ["é_ü", "ärgernis", "ärger", "nis"]
    assert one(spark, None, T.tokens) is None


def test_lines(spark):
    for text, want in [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\r\nb\n", ["a", "b"]), ("\n", [""]), ("a\n\nb", ["a", "", "b"])]:
        assert one(spark, text, T.lines) == want


def test_digest_pin(spark):
    digest = spark.range(1).select(T.chunk_digest(F.lit("p"), F.lit(1), F.lit("x")).alias("d")).first()["d"]
    assert digest == "838d6ad28ea6d60874cd08015db0f65925fb06a74b338657a9e6f5819511df1d"


def test_byte_cut(spark):
    for text in ["abc", "aéé€€", "𝄞𝄞", "x" * 10 + "é"]:
        for limit in range(4, 12):
            assert one(spark, text, lambda c, n=limit: T.byte_cut(c, n)) == text.encode()[:limit].decode("utf-8", "ignore")


def test_fence_and_runs(spark):
    assert one(spark, "no", T.fence) == "```"
    assert one(spark, "a ```` b `c`", T.fence) == "`````"


def test_paths(spark):
    for path, want in [("src/.env", True), ("a/.env.local", True), ("id_rsa.pub", True), ("my_Secret.txt", True), ("x/key.pem", True), ("src/main.rs", False), ("keys/readme.md", False)]:
        assert one(spark, path, T.is_secret) is want
    assert tuple(one(spark, "a/./b//c", T.confined_path)) == ("a/b/c", None)
    assert one(spark, "a/../b", T.confined_path)["error"] == "outside"
    assert one(spark, "/a", T.confined_path)["error"] == "absolute"
    assert one(spark, "a/node_modules/b.js", T.in_pruned_dir) and not one(spark, "a/b/out", T.in_pruned_dir)
    assert one(spark, "a/b.TSX", T.language_of) == "js" and one(spark, "a/b.h", T.fence_tag) == "c" and one(spark, "Makefile", T.language_of) == "other"


def test_small_parsers(spark):
    for text, want in [("Hello, World!", "hello-world"), ("  Rust   is -- fun  ", "rust-is-fun"), ("a", "a"), ("---", "")]:
        assert one(spark, text, T.slugify) == want
    for text, want in [("", ""), ("x", "1x"), ("aaabcc", "3a1b2c"), ("z" * 300, "255z45z")]:
        assert one(spark, text, T.run_lengths) == want
    assert tuple(one(spark, "port=8080\n", T.key_value)) == ("port", "8080")
    assert one(spark, "novalue", T.key_value) is None and one(spark, "=x", T.key_value) is None
    assert one(spark, "k=" + "v" * 63, T.key_value) and one(spark, "k=" + "v" * 64, T.key_value) is None


def test_fnv(spark):
    for text in ["", "a", "hello", "naïve ☃"]:
        assert int(one(spark, text, fnv1a64)) == fnv_bytes(text.encode())


def test_search_and_ranges(spark):
    docs = spark.createDataFrame([(1, "Needle\nneedle\nNEEDLE\n"), (2, None), (3, "")], "id int, text string")
    assert [r.line_no for r in textual.search_lines(docs, "needle").collect()] == [2]
    assert textual.search_lines(docs, "needle", True).count() == 3
    assert textual.search_lines(docs, "").count() == 0
    long = spark.createDataFrame([(1, "abc\ndef\nghi")], "id int, text string")
    row = textual.read_ranges(long, "id", 1, 0, 7).first()
    assert (row.content, row.truncated, row.total_lines) == ("abc\ndef", True, 3)
    row = textual.read_ranges(long, "id", 2, 3, 2).first()
    assert (row.content, row.truncated) == ("de", True)
    assert textual.read_ranges(long, "id", 9, 0, 5).first().content == ""


def test_hits_on_long_lines(spark, tmp_path):
    from millrace.plans import texts

    pads = ("", "x" * 380, "x" * 383, "x" * 392, "x" * 393, "x" * 394, "é" * 196, "日" * 131, "x" + "日" * 131, "𝄞" * 99 + "x", "x" * 5000)
    rows = [(1, "a", "\n".join(f"restart{x}\nother{x}\n{x}restart" for x in pads)), (2, None, "z" * 450 + "restart"), (3, "c", None), (4, "d", "nothing")]
    spark.createDataFrame(rows, "doc_id long, path string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    wanted = [(d, p, n, line.encode()[:400].decode("utf-8", "ignore")) for d, p, t in rows if t for n, line in enumerate(t.split("\n"), 1) if "restart" in line]
    assert sorted(map(str, wanted)) == sorted(str(tuple(r)) for r in texts.substring_search(spark, str(tmp_path)).collect())
    assert any(len(w[3].encode()) == 400 for w in wanted) and len(wanted) == 2 * len(pads) + 1


def test_list_folder(spark):
    files = spark.createDataFrame([("r", "a/x.py"), ("r", "a/y.py"), ("r", "a/b/z.py"), ("r", "a/.env"), ("r", None)], "repo_id string, path string")
    rows = {(r.folder, r.name, r.is_folder, r.truncated) for r in textual.list_folder(files, 2).collect()}
    assert rows == {("", "a", True, False), ("a", "b", True, True), ("a", "x.py", False, True), ("a/b", "z.py", False, False)}


def test_cuts_and_captures(spark):
    texts = ["", "short", "é" * 40, "x" + "é" * 40, "日" * 30, "𝄞" * 20, "a" * 64, "a" * 65]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.capped(F.col("t"), 32).alias("c"), T.captured(F.col("t"), 32).alias("x")).collect()
    for r in rows:
        raw = r.t.encode()
        cut = 32
        while cut < len(raw) and raw[cut] & 0xC0 == 0x80:
            cut += 1
        assert r.c == (r.t if len(raw) <= 32 else raw[:cut].decode() + f"\n…[truncated {len(raw) - cut} bytes]")
        lost = max(len(raw) - 32, 0)
        assert r.x.dropped == lost and bytes(r.x.bytes) == (raw if not lost else raw[:16] + f"\n…[truncated {lost} bytes]…\n".encode() + raw[-16:])


def test_hidden_names(spark):
    names = {"src/a.py": False, ".git/config": True, "a/target/x": True, "a/targets/x": False, ".env.local": True, "k/ID_RSA.pub": True, "x.PEM": True, "db.sqlite": True, "my-credentials.txt": True, "notes/top-secret/a": True, "monkey": False, "a.key/b": True}
    rows = spark.createDataFrame([(n,) for n in names], "p string").select("p", T.is_hidden_from_tools(F.col("p")).alias("h")).collect()
    assert {r.p: r.h for r in rows} == names


def test_common_prefix(spark):
    from millrace.functions import arrays

    cases = [([1, 2, 3], [1, 2, 4], 2), ([], [1], 0), ([1], [1], 1), ([1, 2], [1], 1), ([5], [6], 0), ([1, None], [1, None, 2], 2)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a array<int>, b array<int>").select("i", arrays.common_prefix(F.col("a"), F.col("b")).alias("n"), arrays.prefix_reuse(F.col("a"), F.col("b"), 2).alias("x")).collect()
    assert {r.i: r.n for r in rows} == {i: n for i, (_, _, n) in enumerate(cases)}
    assert {r.i: tuple(r.x) for r in rows} == {0: (2, 1, 1), 1: (0, 1, 1), 2: (0, 1, 1), 3: (0, 1, 1), 4: (0, 1, 1), 5: (2, 1, 1)}
    assert spark.range(1).select(arrays.control_count(F.array(F.lit(2), F.lit(999), F.lit(1000))).alias("n")).first().n == 2

