"""``python -m millrace QUERY [--root FOLDER] [--out FOLDER] [--rows N]``: run a named query and show or write its rows."""

from __future__ import annotations

import argparse

from millrace.plans import catalog
from millrace.session import local_session
from millrace.sources.reports import write_lines


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="millrace")
    parser.add_argument("query", nargs="?", help="name of a query; without one, the names are listed")
    parser.add_argument("--root", default="/root/testdata/sf0.001", help="folder of the tables")
    parser.add_argument("--out", help="folder for JSON lines; without one, rows are shown")
    parser.add_argument("--rows", type=int, default=20)
    parser.add_argument("--cpus", type=int, default=8)
    given = parser.parse_args(arguments)
    named = catalog.queries()
    if given.query not in named:
        print("\n".join(sorted(named)))
        return 0 if given.query is None else 2
    spark = local_session(given.cpus, given.cpus, "millrace")
    rows = named[given.query](spark, given.root)
    if given.out:
        write_lines(rows, given.out)
    else:
        rows.show(given.rows, truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
