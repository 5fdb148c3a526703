"""Comma-separated column lists packed into config strings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_list(value: str | Iterable[str] | None) -> list[str]:
    """Config-side parse of one list value (a handful of names, never data)."""
    if value is None:
        return []
    if not isinstance(value, str):
        return [str(v).strip() for v in value if str(v).strip()]
    return [p.strip() for p in value.split(",") if p.strip()]


def split_list(col: str | Column) -> Column:
    """``'a, b,,c'`` -> ``['a','b','c']``: split on commas, trim, drop empties."""
    c = F.col(col) if isinstance(col, str) else col
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def explode_list(df: DataFrame, list_col: str, keep: Iterable[str],
                 out_col: str = "column_name", position_col: str | None = "position") -> DataFrame:
    """One row per list element, with its 1-based position when asked."""
    keep = list(keep)
    if position_col:
        return (df.select(*keep, F.posexplode(split_list(list_col)).alias("_pos", out_col))
                .withColumn(position_col, (F.col("_pos") + 1).cast("int")).drop("_pos"))
    return df.select(*keep, F.explode(split_list(list_col)).alias(out_col))
