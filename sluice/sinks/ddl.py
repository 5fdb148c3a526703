"""Namespaces and the twelve control tables, created if absent."""

from __future__ import annotations

import logging
import re
from collections.abc import Mapping

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from sluice.schemas import COLUMN_COMMENTS, PARTITION_COLUMNS, TABLE_COMMENTS, TABLES

log = logging.getLogger(__name__)
_IDENT = re.compile(r"^[A-Za-z0-9_]+$")

# The three namespaces and what they hold.
NAMESPACES = {
    "raw": "Raw layer: targets of ingestion.",
    "staging": "Staging layer: intermediate copies for merges.",
    "control": "Control tables of the ingestion framework.",
}


def check_identifier(name: str) -> str:
    if not name or not _IDENT.match(name):
        raise ValueError(f"invalid identifier {name!r}: letters, digits and _ only")
    return name


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def create_namespaces(spark: SparkSession, names: Mapping[str, str] | None = None) -> list[str]:
    """``CREATE SCHEMA IF NOT EXISTS`` with a comment; returns names created or kept."""
    done = []
    for name, comment in (names or NAMESPACES).items():
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{check_identifier(name)}` COMMENT {_quote(comment)}")
        done.append(name)
    return done


def table_ddl(database: str, table: str, schema: T.StructType | None = None,
              partition_cols: list[str] | None = None, location: str | None = None) -> str:
    schema = schema or TABLES[table]
    def comment(name: str) -> str:
        text = COLUMN_COMMENTS.get((table, name), COLUMN_COMMENTS.get(name)) if table in TABLES else None
        return f" COMMENT {_quote(text)}" if text else ""
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}{comment(f.name)}"
                     for f in schema.fields)
    parts = PARTITION_COLUMNS.get(table, []) if partition_cols is None else partition_cols
    sql = f"CREATE TABLE IF NOT EXISTS `{check_identifier(database)}`.`{check_identifier(table)}` ({cols}) USING parquet"
    if parts:
        sql += " PARTITIONED BY (" + ", ".join(f"`{p}`" for p in parts) + ")"
    if table in TABLE_COMMENTS:
        sql += f" COMMENT {_quote(TABLE_COMMENTS[table])}"
    if location:
        sql += f" LOCATION {_quote(location)}"
    return sql


def create_control_tables(spark: SparkSession, database: str) -> dict[str, str | None]:
    """Create every control table; one failure does not stop the others.

    Returns table -> error text (None when created or already there).
    """
    result: dict[str, str | None] = {}
    for table in TABLES:
        try:
            spark.sql(table_ddl(database, table))
            result[table] = None
        except Exception as e:  # keep going, report all
            log.error("creating %s.%s failed: %s", database, table, e)
            result[table] = str(e).splitlines()[0]
    return result
