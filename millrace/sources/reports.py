"""Reports as JSON: a folder of lines by all tasks, or one document for a bounded report."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

MAX_ROWS = 10_000


def write_lines(rows: DataFrame, folder: str) -> None:
    """One JSON object a line, nulls included, written by all tasks."""
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(folder)


def write_report(rows: DataFrame, path: str, **head) -> int:
    """A local JSON document ``{..head, "rows": [...]}``; refused beyond ``MAX_ROWS`` rows. The number of rows."""
    taken = rows.limit(MAX_ROWS + 1).toJSON().collect()
    if len(taken) > MAX_ROWS:
        raise ValueError(f"a report of more than {MAX_ROWS} rows; use write_lines")
    with open(path, "w", encoding="utf-8") as out:
        json.dump({**head, "rows": [json.loads(x) for x in taken]}, out, ensure_ascii=False, indent=1)
    return len(taken)
