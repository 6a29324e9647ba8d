"""Readers and writers."""

from millrace.sources.tables import read_table, table_exists

__all__ = ["read_table", "table_exists"]
