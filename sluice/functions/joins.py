"""Join of rows to per-key values that adaptive execution can broadcast or split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_per_key(rows: DataFrame, per_key: DataFrame, keys: list[str]) -> DataFrame:
    """Left-join ``rows`` to ``per_key`` (one row per key, NULL-safe key equality) without a job while planning.

    NULL-safe equality hashes both sides by expressions of the keys, so both are shuffled for this
    join even where ``per_key`` is an aggregate by the same keys.  Adaptive execution then sees the real sizes: it
    broadcasts a small ``per_key``, and splits the partition of a hot key, whose rows all meet one ``per_key`` row.
    """
    alias = [f"__pk_k{i}" for i in range(len(keys))]
    side = per_key.select(*[F.col(k).alias(a) for k, a in zip(keys, alias)], *[c for c in per_key.columns if c not in keys])
    return rows.join(side, _nse(rows, side, keys, alias), "left").drop(*alias)


def _nse(left: DataFrame, right: DataFrame, lkeys, rkeys):
    cond = None
    for a, b in zip(lkeys, rkeys):
        c = left[a].eqNullSafe(right[b])
        cond = c if cond is None else cond & c
    return cond
