"""Sinks: table creation and the writers; the only modules here that write."""

from sluice.sinks.ddl import create_control_tables, create_namespaces, table_ddl
from sluice.sinks.writers import append_log, conform, insert_columns, overwrite_via_staging, replace_table, write_table

__all__ = ["create_control_tables", "create_namespaces", "table_ddl", "append_log", "conform", "insert_columns",
           "overwrite_via_staging", "replace_table", "write_table"]
