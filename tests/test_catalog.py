"""Every named query of the core against its SQL, on the smallest tables."""

import os

import pytest

from millrace.operators.chunking import chunk_text
from millrace.plans import catalog
from tests.compare import SMALL, connect, same

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 80


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    assert same(QUERIES[name](spark, SMALL), con, SQL[name])


def test_only_chunks_of_code_lack_sql():
    assert set(QUERIES) - set(SQL) == {"code_chunks", "cited_chunks"}


def test_code_chunks_of_the_whole_table(spark, con):
    """Every file chunked by itself on the driver."""
    files = con.execute("SELECT DISTINCT file_id, path, text FROM source_files WHERE text IS NOT NULL").fetchall()
    want = {(i, *chunk) for i, path, text in files for chunk in chunk_text(path or "", text)}
    got = [(r.file_id, r.start_line, r.end_line, r.digest, r.content, r.symbol, r.kind) for r in QUERIES["code_chunks"](spark, SMALL).collect()]
    assert set(got) == want and len(got) == len(want)


def test_cited_chunks_of_the_whole_table(spark, con):
    files = con.execute("SELECT DISTINCT repo_id, path, text FROM source_files WHERE text IS NOT NULL AND path IS NOT NULL").fetchall()
    made = {(repo, chunk[2]) for repo, path, text in files for chunk in chunk_text(path, text)}
    cited = set(con.execute("SELECT DISTINCT repo_id, digest_hex FROM citations").fetchall())
    want = {repo: (len(mine), len(mine & cited)) for repo in {r for r, _ in made} if (mine := {x for x in made if x[0] == repo})}
    assert {r.repo_id: (r.chunks, r.cited) for r in QUERIES["cited_chunks"](spark, SMALL).collect()} == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries()) and set(catalog.oracle_sql()) <= set(entry.oracle_sql())
