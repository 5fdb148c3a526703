"""Runs and watermarks over time: what was in force when, and what ran at once.

All of it is done in cells of time (``functions.cells``) or time bins, so an object with a third of all rows is spread over its cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.cells import carried, running_sum


def watermarks_as_of(history: DataFrame, lookups: DataFrame, keys: Sequence[str], time_col: str, values: Sequence[str],
                     ties: Sequence[str] = (), grain: str = "HOUR") -> DataFrame:
    """Each lookup (a run, an audit question) with the watermark that was in force at its time: the last appended before or at it."""
    return carried(history, lookups, keys, time_col, values, lambda at: F.date_trunc(grain, at), ties)


def latest_watermarks(history: DataFrame, keys: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """The watermark row in force now, of rows that are only appended; one partial row a key and task is shuffled."""
    rest = [c for c in history.columns if c not in keys]
    return history.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order_cols)).alias("_w")).select(*keys, "_w.*")


def _bin(at: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(at.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")


def closed(runs: DataFrame, start: str, end: str) -> DataFrame:
    """``runs`` with ``_end``: the end, for a run without one the last time that any run shows (and one microsecond, so that it counts as running then)."""
    last = runs.agg(F.max(F.greatest(F.col(start), F.coalesce(F.col(end), F.col(start))))).scalar()
    return runs.withColumn("_end", F.coalesce(F.col(end), last + F.expr("INTERVAL '0.000001' SECOND")))


def overlapping_runs(runs: DataFrame, keys: Sequence[str], id_col: str, start: str, end: str, bin_seconds: int = 3600) -> DataFrame:
    """(keys, earlier, later, overlap_from, overlap_to) of every two runs of a key that run at the same time, each pair once.

    A run is [start, end); without end it is open until the last time in the table.  Runs are dealt to the time bins that they span, and a pair belongs to
    the bin in which the later one starts: it is there once, and the earlier one meets it there.  Of runs that start together the lesser id
    is the earlier.  Runs without start, and those that end before they start, overlap nothing.
    """
    keys = list(keys)
    rows = closed(runs.where(F.col(start).isNotNull()), start, end).where(F.col("_end") > F.col(start))
    one = rows.select(*keys, F.col(id_col).alias("earlier"), F.col(start).alias("_s"), F.col("_end").alias("_e"),
                      F.explode(F.sequence(_bin(F.col(start), bin_seconds), _bin(F.col("_end"), bin_seconds))).alias("_bin"))
    other = rows.select(*keys, F.col(id_col).alias("later"), F.col(start).alias("overlap_from"), F.col("_end").alias("_later_end"), _bin(F.col(start), bin_seconds).alias("_bin"))
    met = one.join(other, [*keys, "_bin"]).where("overlap_from < _e AND (_s < overlap_from OR (_s = overlap_from AND earlier < later))")
    return met.select(*keys, "earlier", "later", "overlap_from", F.least("_e", "_later_end").alias("overlap_to"))


def runs_at_once(runs: DataFrame, keys: Sequence[str], id_col: str, start: str, end: str, grain: str = "HOUR") -> DataFrame:
    """(keys, id, start, running): how many runs of the key run when a run starts, itself included.

    A sweep over starts and ends: a running sum of +1 and -1, an end before the starts of its time.  No pair is made.
    """
    keys = list(keys)
    rows = runs.where(F.col(start).isNotNull())
    ends_late = F.col(end) <= F.col(start)  # a run without duration still counts itself
    moves = F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("turn"), F.lit(1).alias("step")),
                    F.struct(F.greatest(end, start).alias("at"), F.when(ends_late, 2).otherwise(0).alias("turn"), F.lit(-1).alias("step")))
    swept = rows.select(*keys, F.col(id_col).alias("_id"), F.explode(F.when(F.col(end).isNull(), F.slice(moves, 1, 1)).otherwise(moves)).alias("m")).select(*keys, "_id", "m.*")
    summed = running_sum(swept, keys, ["at", "turn", "_id"], F.date_trunc(grain, F.col("at")), F.col("step"), "running")
    return summed.where("step = 1").select(*keys, F.col("_id").alias(id_col), F.col("at").alias(start), F.col("running").cast("long").alias("running"))
