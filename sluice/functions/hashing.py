"""Record hash: lowercase hex SHA-256 over the configured columns."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.lists import parse_list

_SEP = "|"
_STRICT_SEP = "\u0001"
_STRICT_NULL = "\u0000"


def record_hash(cols: Sequence[str | Column], strict: bool = False) -> Column:
    """``sha2(concat_ws('|', cols), 256)`` with each column cast to text.

    The default keeps the configured formula, so ``('a', NULL, 'b')`` and
    ``('a', 'b')`` hash alike (``concat_ws`` skips NULL).  ``strict=True``
    marks NULL with ``\\u0000`` and joins with ``\\u0001`` so neither NULLs
    nor a ``|`` inside a value can collide.
    """
    if not cols:
        raise ValueError("record_hash needs at least one column")
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    if strict:
        texts = [F.coalesce(t, F.lit(_STRICT_NULL)) for t in texts]
        return F.sha2(F.concat_ws(_STRICT_SEP, *texts), 256)
    return F.sha2(F.concat_ws(_SEP, *texts), 256)


def hash_columns_for(df: DataFrame, hash_columns: str | Iterable[str] | None,
                     exclude: Iterable[str] = ()) -> list[str]:
    """Resolve the ``hash_columns`` setting against a DataFrame.

    NULL or empty means every column in source order, metadata columns
    (``exclude``) left out.  Named columns must exist.
    """
    skip = {c.lower() for c in exclude}
    if hash_columns is None or (isinstance(hash_columns, str) and not hash_columns.strip()):
        return [c for c in df.columns if c.lower() not in skip]
    names = parse_list(hash_columns) if isinstance(hash_columns, str) else list(hash_columns)
    lookup = {c.lower(): c for c in df.columns}
    missing = [n for n in names if n.lower() not in lookup]
    if missing:
        raise ValueError(f"hash columns not in source: {', '.join(missing)}")
    return [lookup[n.lower()] for n in names]


def with_record_hash(df: DataFrame, hash_columns: str | Iterable[str] | None = None,
                     out_col: str = "record_hash", strict: bool = False,
                     exclude: Iterable[str] = ()) -> DataFrame:
    cols = hash_columns_for(df, hash_columns, exclude=[out_col, *exclude])
    return df.withColumn(out_col, record_hash(cols, strict=strict))
