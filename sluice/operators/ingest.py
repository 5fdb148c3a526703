"""Incremental ingestion: classify by key and hash, merge, watermarks, metadata.

All functions are lazy DataFrame -> DataFrame.  Keys are primary keys: unique
and non-NULL (``assert_unique_keys`` checks this before a merge), so the
key-equality joins here have no hot key by construction.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.expressions import computation_column
from sluice.functions.joins import join_per_key

INSERT, UPDATE, UNCHANGED, ABSENT = "INSERT", "UPDATE", "UNCHANGED", "ABSENT"


class MergeKeyError(ValueError):
    """Source keys are NULL or duplicated; a merge would be ambiguous (MERGE_ERROR)."""


def bad_keys(df: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Keys that are NULL or repeated, with their counts.  Reads the key columns only; the count is a
    partial aggregate, so even a key repeated in a third of the rows leaves each task as one row."""
    null_key = F.greatest(*[F.col(k).isNull().cast("int") for k in pk]) if len(pk) > 1 \
        else F.col(pk[0]).isNull().cast("int")
    return (df.groupBy(*pk).agg(F.count(F.lit(1)).alias("_n"))
            .filter((F.col("_n") > 1) | (null_key == 1)))


def assert_unique_keys(df: DataFrame, pk: Sequence[str]) -> None:
    """Raise if any key is NULL or repeated.  One aggregate job, one row back at most."""
    bad = bad_keys(df, pk).limit(1).collect()
    if bad:
        raise MergeKeyError(f"primary key {pk} is NULL or duplicated, e.g. {bad[0].asDict()}")


def _change_expr(s_key: Column, t_key: Column, s_hash: Column, t_hash: Column) -> Column:
    return (F.when(t_key.isNull(), F.lit(INSERT))
            .when(s_key.isNull(), F.lit(ABSENT))
            .when(~s_hash.eqNullSafe(t_hash), F.lit(UPDATE))
            .otherwise(F.lit(UNCHANGED)))


def classify(src: DataFrame, tgt: DataFrame, pk: Sequence[str],
             hash_col: str = "record_hash", out_col: str = "change_type") -> DataFrame:
    """INSERT / UPDATE / UNCHANGED / ABSENT per key.

    Only ``(pk, hash)`` crosses the shuffle: both sides are projected first,
    so the full-outer join moves keys and 64-char hashes, never payload.
    """
    pk = list(pk)
    # the (never NULL) hash doubles as the side marker: no extra column in the shuffle
    s = src.select(*pk, F.coalesce(F.col(hash_col), F.lit("")).alias("_s_hash"))
    t = tgt.select(*pk, F.coalesce(F.col(hash_col), F.lit("")).alias("_t_hash"))
    j = s.join(t, pk, "full_outer")
    change = _change_expr(F.col("_s_hash"), F.col("_t_hash"), F.col("_s_hash"), F.col("_t_hash"))
    return j.select(*pk, change.alias(out_col))


def change_counts(classified: DataFrame, change_col: str = "change_type") -> DataFrame:
    """One row: rows_read, rows_inserted, rows_updated, rows_deleted, rows_unchanged."""
    c = F.col(change_col)
    return classified.agg(
        F.count_if(c != ABSENT).alias("rows_read"),
        F.count_if(c == INSERT).alias("rows_inserted"),
        F.count_if(c == UPDATE).alias("rows_updated"),
        F.count_if(c == ABSENT).alias("rows_deleted"),
        F.count_if(c == UNCHANGED).alias("rows_unchanged"),
    )


def merge_snapshot(src: DataFrame, tgt: DataFrame, pk: Sequence[str], hash_col: str = "record_hash",
                   update_unchanged: bool = False, soft_delete: bool = False,
                   deleted_col: str = "is_deleted", change_col: str | None = None) -> DataFrame:
    """The target as it is after merging ``src`` into it, in one full-outer join.

    - new keys take the source row, changed hashes take the source row;
    - unchanged rows keep the **target** row, so their metadata (load run id,
      ingestion time) is left alone, unless ``update_unchanged`` (plain upsert);
    - keys absent from the source keep the target row; with ``soft_delete``
      they are flagged in ``deleted_col`` (rows are never removed).  A key that was
      flagged before is UNCHANGED, so ABSENT counts the newly deleted.
    - a target column that the source no longer has is NULL on new and changed rows.

    Columns: the target's in order, then columns new in the source.
    ``change_col`` adds the change type so a write can observe counts.
    """
    pk = list(pk)
    s, t = src.alias("_s"), tgt.alias("_t")
    cond = None
    for k in pk:
        c = F.col(f"_s.{k}") == F.col(f"_t.{k}")
        cond = c if cond is None else cond & c
    j = s.join(t, cond, "full_outer")
    s_key, t_key = F.col(f"_s.{pk[0]}"), F.col(f"_t.{pk[0]}")
    s_hash, t_hash = F.col(f"_s.{hash_col}"), F.col(f"_t.{hash_col}")
    if update_unchanged:
        take_src = s_key.isNotNull()
    else:
        take_src = t_key.isNull() | (s_key.isNotNull() & ~s_hash.eqNullSafe(t_hash))

    src_cols, tgt_cols = list(src.columns), list(tgt.columns)
    out = []
    for c in tgt_cols:
        if c in pk:
            out.append(F.coalesce(F.col(f"_s.{c}"), F.col(f"_t.{c}")).alias(c))
        elif soft_delete and c == deleted_col:
            out.append(s_key.isNull().alias(c))
        elif c in src_cols:
            out.append(F.when(take_src, F.col(f"_s.{c}")).otherwise(F.col(f"_t.{c}")).alias(c))
        elif c == deleted_col:  # the target's own flag, not a dropped source column
            out.append(F.col(f"_t.{c}").alias(c))
        else:  # a column the source no longer has: kept where the target row stands, else NULL
            out.append(F.when(~take_src, F.col(f"_t.{c}")).alias(c))
    for c in src_cols:
        if c not in tgt_cols:
            out.append(F.when(s_key.isNotNull(), F.col(f"_s.{c}")).alias(c))
    if soft_delete and deleted_col not in tgt_cols:
        out.append(s_key.isNull().alias(deleted_col))
    if change_col:
        change = _change_expr(s_key, t_key, s_hash, t_hash)
        if soft_delete and deleted_col in tgt_cols:  # deleted before: nothing changes now
            before = s_key.isNull() & F.coalesce(F.col(f"_t.{deleted_col}"), F.lit(False))
            change = F.when(before, F.lit(UNCHANGED)).otherwise(change)
        out.append(change.alias(change_col))
    return j.select(*out)


def soft_delete_flags(src: DataFrame, tgt: DataFrame, pk: Sequence[str],
                      out_col: str = "is_deleted") -> DataFrame:
    """Every target key with ``is_deleted`` = absent from the source."""
    pk = list(pk)
    present = src.select(*pk).withColumn("_present", F.lit(1))
    return (tgt.select(*pk).join(present, pk, "left")
            .select(*pk, F.col("_present").isNull().alias(out_col)))


def extract_since(src: DataFrame, column: str, watermark=None,
                  watermarks: DataFrame | None = None, object_keys: Sequence[str] = (),
                  watermark_col: str = "watermark_value") -> DataFrame:
    """Rows at or after the stored watermark (``>=``; ties are re-read and the
    merge drops them as UNCHANGED).  No watermark means a full extract.

    One object: ``watermark`` is a single value; it is cast to the column's
    type as a literal, so the comparison reaches the Parquet scan as a
    pushed filter.  Many objects in one source: ``watermarks`` holds one row
    per ``object_keys`` value; it is joined (left, so objects without a
    watermark pass whole); an object with a large share of the rows is left to ``join_per_key``.

    Rows whose watermark column is NULL are always loaded: nothing says they were seen before, and the
    merge drops them as UNCHANGED if they were.
    """
    if watermarks is None:
        if watermark is None:
            return src
        dtype = src.schema[column].dataType
        if isinstance(watermark, (dt.datetime, dt.date)):
            watermark = watermark.isoformat(sep=" ") if isinstance(watermark, dt.datetime) else watermark.isoformat()
        return src.filter((F.col(column) >= F.lit(watermark).cast(dtype)) | F.col(column).isNull())
    keys = list(object_keys)
    wm = watermarks.select(*keys, F.col(watermark_col).alias("_wm"))
    j = join_per_key(src, wm, keys)
    return j.filter(F.col("_wm").isNull() | F.col(column).isNull() | (F.col(column) >= F.col("_wm"))).drop("_wm")


def next_watermarks(loaded: DataFrame, key_cols: Sequence[str], ts_col: str, run_col: str) -> DataFrame:
    """Per object: newest timestamp, the run that holds it, rows loaded.

    Partial aggregation combines per task before the shuffle, so an object
    with a third of all rows sends one row per task, not its rows.
    """
    return loaded.groupBy(*key_cols).agg(
        F.max(ts_col).alias("last_run_ts"),
        F.max_by(run_col, F.struct(ts_col, run_col)).alias("last_run_id"),  # of equal times the greatest run
        F.count(F.lit(1)).alias("rows_last_loaded"),
    )


def watermark_values(df: DataFrame, key_cols: Sequence[str], column: str) -> DataFrame:
    """Per object: the high-water mark of ``column`` and its SHA-256 as text."""
    agg = df.groupBy(*key_cols).agg(F.max(column).alias("watermark_value"))
    return agg.withColumn("watermark_hash", F.sha2(F.col("watermark_value").cast("string"), 256))


@dataclass(frozen=True)
class MetadataSpec:
    column_name: str
    computation: str
    column_order: int
    data_type: str = "STRING"
    applies_to: str = "all"


def specs_for(load_type: str, specs: Iterable[MetadataSpec]) -> list[MetadataSpec]:
    return sorted((s for s in specs if s.applies_to in ("all", load_type)),
                  key=lambda s: (s.column_order, s.column_name))


def _declared(col: Column, data_type: str, produced: T.DataType | None) -> Column:
    wanted = data_type.strip().upper()
    if wanted.startswith("TIMESTAMP") and isinstance(produced, (T.TimestampType, T.TimestampNTZType)):
        return col
    return col.cast(wanted.lower())


def inject_metadata(df: DataFrame, specs: Sequence[MetadataSpec], run_values: Mapping[str, object],
                    hash_columns: Sequence[str] = (), strict_hash: bool = False) -> DataFrame:
    """Append metadata columns in ``column_order``; tokens bind to run values.

    A metadata name equal to a source column is an error before any write.
    """
    ordered = sorted(specs, key=lambda s: (s.column_order, s.column_name))
    lower = {c.lower() for c in df.columns}
    clash = [s.column_name for s in ordered if s.column_name.lower() in lower]
    if clash:
        raise ValueError(f"metadata columns already in source: {', '.join(clash)}")
    cols = {}
    for s in ordered:
        c = computation_column(s.computation, run_values, hash_columns, strict_hash)
        produced = df.select(c.alias("_x")).schema["_x"].dataType if s.data_type.upper().startswith("TIMESTAMP") else None
        cols[s.column_name] = _declared(c, s.data_type, produced)
    return df.withColumns(cols)
