"""Idempotent seeding: insert rows whose natural key is absent, never change others.

Set-based: one plan per table instead of a probe query and an insert per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INSERTED, SKIPPED, FAILED, DROPPED = "inserted", "skipped", "failed", "dropped"


def _any_null(keys: Sequence[str]) -> Column:
    c = F.lit(False)
    for k in keys:
        c = c | F.col(k).isNull()
    return c


def first_per_key(batch: DataFrame, keys: Sequence[str], order_col: str) -> DataFrame:
    """The first row (smallest ``order_col``) of each natural key.

    ``min(struct(order_col, ...))`` is a partial aggregate: a key repeated in
    a third of the batch leaves each task as one row.  Unlike
    ``dropDuplicates`` it fixes which row survives.
    """
    others = [c for c in batch.columns if c not in keys and c != order_col]
    w = batch.groupBy(*keys).agg(F.min(F.struct(order_col, *others)).alias("_w"))
    return w.select(*[F.col(k) for k in keys], *[F.col(f"_w.{c}").alias(c) for c in [order_col, *others]]) \
        .select(*batch.columns)


def existing_keys(existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of the table; ``distinct`` combines per task first."""
    return existing.select(*keys).distinct()


def insert_if_absent(batch: DataFrame, existing: DataFrame, keys: Sequence[str], order_col: str) -> DataFrame:
    """Rows to insert: first row per key, only keys not in ``existing``, no NULL keys."""
    keys = list(keys)
    winners = first_per_key(batch.filter(~_any_null(keys)), keys, order_col)
    return winners.join(existing_keys(existing, keys), keys, "left_anti")


def seed_outcome(batch: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per outcome: ``inserted`` (one per new key), ``skipped`` (key
    present, or a later duplicate in the batch), ``failed`` (a key field is
    NULL).  Aggregates only: rows are counted per key first, and the key
    counts meet the existing keys in a join where both sides are unique.
    """
    keys = list(keys)
    per_key = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    present = existing_keys(existing, keys).select(*[F.col(k).alias(f"_e{i}") for i, k in enumerate(keys)],
                                                   F.lit(1).alias("_present"))
    cond = None
    for i, k in enumerate(keys):
        c = per_key[k].eqNullSafe(present[f"_e{i}"])
        cond = c if cond is None else cond & c
    j = per_key.join(present, cond, "left").select(*keys, "_n", "_present")
    nullk = _any_null(keys)
    new = ~nullk & F.col("_present").isNull()
    tot = j.agg(
        F.sum(F.when(new, F.lit(1)).otherwise(F.lit(0))).alias("ins"),
        F.sum(F.when(nullk, F.lit(0)).when(new, F.col("_n") - 1).otherwise(F.col("_n"))).alias("skip"),
        F.sum(F.when(nullk, F.col("_n")).otherwise(F.lit(0))).alias("fail"),
    )
    rows = F.array(
        F.struct(F.lit(INSERTED).alias("outcome"), F.col("ins").cast("long").alias("n")),
        F.struct(F.lit(SKIPPED).alias("outcome"), F.col("skip").cast("long").alias("n")),
        F.struct(F.lit(FAILED).alias("outcome"), F.col("fail").cast("long").alias("n")),
    )
    return tot.select(F.inline(rows)).filter(F.col("n") > 0)


def stamp(rows: DataFrame, id_col: str | None, ts_cols: Sequence[str], run_ts) -> DataFrame:
    """Add a UUID id (unless the table has none) and the insert timestamps.

    ``uuid()`` changes on every evaluation: write the result once and read it
    back, never recompute the plan.  All timestamps are the run's one instant.
    """
    out = rows
    if id_col:
        out = out.withColumn(id_col, F.expr("uuid()"))
    ts = F.lit(run_ts).cast("timestamp")
    for c in ts_cols:
        out = out.withColumn(c, ts)
    return out
