"""Metadata ``computation`` text to Column, with run-time tokens bound."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions.hashing import record_hash

# Computation tokens bound to run values instead of evaluated as SQL.
RUN_TOKENS = ("load_run_id", "source_system", "source_object", "pipeline_id", "run_ts")

_HASH_FORM = re.compile(
    r"^\s*sha2\s*\(\s*concat_ws\s*\(\s*'\|'\s*,\s*hash_columns\s*\)\s*,\s*256\s*\)\s*$", re.I)
_NOW_FORM = re.compile(r"^\s*(current_timestamp\s*\(\s*\)|now\s*\(\s*\))\s*$", re.I)


def computation_column(computation: str, run_values: Mapping[str, object],
                       hash_columns: Sequence[str] = (), strict_hash: bool = False) -> Column:
    """Turn one ``computation`` into a Column.

    - ``sha2(concat_ws('|', hash_columns), 256)``: the record hash over the
      object's hash columns (built from column objects, not by text replace).
    - ``current_timestamp()``: the run's single ``run_ts`` if given, so every
      row and every action of a run carries the same instant.
    - a bare run token (``load_run_id``, ``source_system``, ...): its value.
    - anything else: Spark SQL via ``F.expr``.
    """
    text = computation.strip()
    if _HASH_FORM.match(text):
        if not hash_columns:
            raise ValueError("hash computation needs hash columns")
        return record_hash(list(hash_columns), strict=strict_hash)
    if _NOW_FORM.match(text):
        ts = run_values.get("run_ts")
        if ts is None:
            return F.current_timestamp()
        return ts if isinstance(ts, Column) else F.lit(ts)
    if text in RUN_TOKENS:
        if text not in run_values:
            raise ValueError(f"run value {text!r} not supplied")
        return F.lit(run_values[text])
    return F.expr(text)
