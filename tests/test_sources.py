"""Folder reading, index files, streams and the session helpers."""

import time

import numpy as np
import pytest

from millrace.session import cut_lineage
from millrace.sources import files as S
from millrace.streaming import ingest


def test_read_folder(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / ".git").mkdir()
    for name, raw in {"src/a.py": b"x = 1\n", "id_rsa.pub": b"A=1", "bin.dat": b"ab\0c", "bad.txt": b"\xff\xfe\xfd", "node_modules/x.js": b"x", ".git/config": b"x", "big.txt": b"x" * (512 * 1024 + 1), "src/__init__.py": b""}.items():
        (tmp_path / name).write_bytes(raw)
    rows = {r.path: (r.skip_reason, r.text) for r in S.read_folder(spark, str(tmp_path)).collect()}
    assert rows == {"src/a.py": (None, "x = 1\n"), "src/__init__.py": (None, ""), "id_rsa.pub": ("secret", None), "bin.dat": ("binary", None), "bad.txt": ("invalid_utf8", None), "big.txt": ("too_large", None)}


def test_ignore_files_and_links(spark, tmp_path):
    for name in ("docs/deep", "logs", "src/gen"):
        (tmp_path / name).mkdir(parents=True)
    lines = {
        "": "*.log\n/logs/\n# a comment\n!keep.log\n\ndocs/**/draft-?.md\n\\#odd\n", "src/": "gen/\n!gen/kept.py\n*.tmp\n", "docs/deep/": "!draft-1.md\n",
    }
    for folder, text in lines.items():
        (tmp_path / f"{folder}.gitignore").write_text(text)
    for name in ("a.log", "keep.log", "logs/x.py", "docs/draft-1.md", "docs/deep/draft-1.md", "docs/deep/draft-2.md", "docs/draft-10.md", "src/gen/kept.py", "src/a.tmp", "a.tmp", "#odd", "src/logs"):
        (tmp_path / name).write_text("x = 1\n")
    outside = tmp_path.parent / f"{tmp_path.name}-other.py"
    outside.write_text("y = 2\n")
    (tmp_path / "link.py").symlink_to(outside)
    rows = {r.path: r.skip_reason for r in S.read_folder(spark, str(tmp_path)).collect()}
    assert rows == {"keep.log": None, "docs/deep/draft-1.md": None, "docs/draft-10.md": None, "a.tmp": None, "src/logs": None, "link.py": "symlink"}


def test_generations_in_a_folder(spark, tmp_path):
    from millrace.sources import generations as G

    folder = str(tmp_path / "g")
    assert G.current_generation(spark, folder) is None
    for n in (1, 2, 3):
        G.write_generation(spark.createDataFrame([(n, [0.5])], "id long, vec array<float>"), folder, n)
    assert G.current_generation(spark, folder) == 3 and G.read_generation(spark, folder).first().id == 3 and G.read_generation(spark, folder, 1).first().id == 1
    assert G.drop_generations(spark, folder, {2}) == [1] and G.read_generation(spark, folder, 2).first().id == 2


def test_versions_of_a_table(spark, tmp_path):
    from millrace.sources import schemas

    steps = [lambda t: t.withColumn("b", t["a"] + 1), lambda t: t.drop("a")]
    schemas.write_versioned(spark.createDataFrame([(1,)], "a int"), str(tmp_path / "t"), 0)
    assert schemas.read_versioned(spark, str(tmp_path / "t"), steps).first().asDict() == {"b": 2}
    assert schemas.migrate(spark.createDataFrame([(1, 5)], "a int, b int"), 1, steps).first().asDict() == {"b": 5}
    with pytest.raises(ValueError):
        schemas.migrate(spark.range(1), 3, steps)


def test_reports(spark, tmp_path):
    import json

    from millrace.sources import reports

    rows = spark.createDataFrame([(1, "é", None)], "a int, b string, c string")
    reports.write_lines(rows, str(tmp_path / "lines"))
    assert json.loads(spark.read.text(str(tmp_path / "lines")).first()[0]) == {"a": 1, "b": "é", "c": None}
    assert reports.write_report(rows, str(tmp_path / "r.json"), name="x") == 1
    assert json.load(open(tmp_path / "r.json", encoding="utf-8"))["name"] == "x"


def test_checkpoint_folder_must_be_shared():
    from types import SimpleNamespace

    from millrace import session

    folder = SimpleNamespace(isDefined=lambda: False)
    sc = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: folder)), getConf=lambda: {}, master="spark://host:7077")
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(SimpleNamespace(sparkContext=sc, conf={}))


def test_command_line(capsys):
    from millrace.__main__ import main

    assert main([]) == 0 and "hybrid_search" in capsys.readouterr().out and main(["nonsense"]) == 2


def test_index_file(spark, tmp_path):
    ids, vectors = np.array([5, 3, 9], dtype=np.uint64), np.arange(12, dtype=np.float32).reshape(3, 4)
    path = str(tmp_path / "v.idx")
    S.write_index(path, ids, vectors, 7)
    raw = open(path, "rb").read()
    assert len(raw) == 128 + 48 and S.parse_index(raw) == (None, 4, 3, 7)
    back = S.index_rows(raw)
    assert (back[0] == ids).all() and (back[1] == vectors).all()
    assert S.parse_index(b"x" * 48)[0] == "bad_magic" and S.parse_index(raw[:47])[0] == "bad_length" and S.parse_index(raw[:-1])[0] == "bad_length"
    assert S.parse_index(raw[:12] + b"\x09" + raw[13:])[0] == "bad_hash"
    empty = S.index_bytes(np.empty(0, np.uint64), np.empty((0, 16), np.float32), 7)
    assert S.parse_index(empty) == (None, 16, 0, 7)
    (tmp_path / "w.idx").write_bytes(b"nonsense" * 10)
    rows = S.read_vector_indexes(spark, str(tmp_path / "*.idx")).collect()
    assert sorted(r.id for r in rows if r.error is None) == [3, 5, 9] and [r.error for r in rows if r.error] == ["bad_magic"]
    with pytest.raises(ValueError):
        S.index_rows(b"x" * 48)


def test_checkpoint(spark):
    frame = cut_lineage(spark.range(10).repartition(3))
    assert frame.count() == 10


def test_streams(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    spark.createDataFrame([(1, "a.py", "def x():\n    pass\n\n"), (2, "b.md", "# T\na\nb\n")], "file_id long, path string, text string").coalesce(1).write.parquet(str(source))
    files = spark.readStream.schema("file_id long, path string, text string").parquet(str(source))
    query = ingest.stream_chunks(files, "file_id", lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"), str(tmp_path / "cp"))
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert {r.symbol for r in spark.read.parquet(str(out)).collect()} == {"x", "T"}


def test_stream_state(spark, tmp_path):
    rows = [("s", 0, "a"), ("s", 10, "b"), ("s", 45, "c"), ("s", 50, "d")]
    spark.createDataFrame(rows, "stream_id string, at_ms long, piece string").coalesce(1).write.parquet(str(tmp_path / "d"))
    deltas = spark.readStream.schema("stream_id string, at_ms long, piece string").parquet(str(tmp_path / "d"))
    query = ingest.stream_deltas(deltas).writeStream.format("memory").queryName("flushes").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).start()
    try:
        # A query with processing-time timeouts is never idle, so its result is awaited, not its rest.
        until = time.monotonic() + 60
        while not spark.table("flushes").count() and time.monotonic() < until:
            time.sleep(0.2)
        assert [(r.text, r.n) for r in spark.table("flushes").collect()] == [("abc", 3)]
    finally:
        query.stop()
    events = [("2024-01-01 00:01:00", "x", 1.0), ("2024-01-01 00:02:00", "x", 2.0), ("2024-01-01 00:07:00", "y", 4.0)]
    frame = spark.createDataFrame(events, "ts string, kind string, value double").selectExpr("cast(ts as timestamp) ts", "kind", "value")
    frame.coalesce(1).write.parquet(str(tmp_path / "e"))
    counted = ingest.windowed_counts(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "e")), "ts", "kind")
    query = counted.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp3")).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(90)
        assert {(r.kind, r.n, r.total) for r in spark.table("windows").collect()} == {("x", 2, 3.0), ("y", 1, 4.0)}
    finally:
        query.stop()
