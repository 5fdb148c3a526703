"""Type names as stored in the registry, and which type changes widen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Type changes that widen without loss (old type, new type).
WIDENING = [
    ("TINYINT", "SMALLINT"), ("TINYINT", "INT"), ("TINYINT", "BIGINT"),
    ("SMALLINT", "INT"), ("SMALLINT", "BIGINT"),
    ("INT", "BIGINT"), ("INT", "DOUBLE"),
    ("FLOAT", "DOUBLE"),
    ("DATE", "TIMESTAMP"), ("DATE", "TIMESTAMP_NTZ"),
]


def type_name(dt: T.DataType) -> str:
    """Registry spelling of a Spark type: ``simpleString`` upper-cased."""
    return dt.simpleString().upper()


def is_widening(old: str | Column, new: str | Column) -> Column:
    """True where the (old, new) type-name pair is a lossless widening."""
    o = F.upper(F.col(old) if isinstance(old, str) else old)
    n = F.upper(F.col(new) if isinstance(new, str) else new)
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, b in WIDENING])
    listed = F.coalesce(F.array_contains(pairs, F.concat_ws(">", o, n)), F.lit(False))

    def digits(c, group):
        return F.regexp_extract(c, r"^DECIMAL\((\d+),\s*(\d+)\)$", group).try_cast("int")
    # a decimal widens if neither its scale nor the digits before the point shrink
    scale = digits(n, 2) - digits(o, 2)
    whole = (digits(n, 1) - digits(n, 2)) - (digits(o, 1) - digits(o, 2))
    return listed | F.coalesce((scale >= 0) & (whole >= 0) & (o != n), F.lit(False))
