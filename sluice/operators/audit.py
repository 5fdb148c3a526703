"""Run audit, per-object metrics, errors: append-only events and their rollups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.cells import numbered
from sluice.functions.joins import join_per_key
from sluice.schemas import ERROR_TYPES, schema_of

SUCCESS, FAILED, PARTIAL, RUNNING = "SUCCESS", "FAILED", "PARTIAL", "RUNNING"


def final_status(success: Column, failed: Column) -> Column:
    """No failures SUCCESS, no successes FAILED, else PARTIAL."""
    return F.when(failed == 0, F.lit(SUCCESS)).when(success == 0, F.lit(FAILED)).otherwise(F.lit(PARTIAL))


def run_rollup(object_results: DataFrame, run_col: str, failed: Column) -> DataFrame:
    """Objects of each run rolled up: total, succeeded, failed, final status.  An object whose outcome is NULL
    is not known to have succeeded: it counts as failed."""
    failed = F.coalesce(failed, F.lit(True))
    g = object_results.groupBy(F.col(run_col).alias("run_id")).agg(
        F.count(F.lit(1)).alias("total_objects"),
        F.count_if(~failed).alias("success_objects"),
        F.count_if(failed).alias("failed_objects"))
    return g.withColumn("status", final_status(F.col("success_objects"), F.col("failed_objects")))


def run_state(events: DataFrame, run_col: str, ts_col: str, status_col: str | None = None,
              identity_cols: Sequence[str] = (), tie_col: str | None = None) -> DataFrame:
    """Latest state of each run from its appended events (start, end, ...).

    No in-place update: start is the first event, end the last, the status
    the one of the last event; duration in whole seconds.  ``identity_cols`` (who started the run, and how) are
    those of the first event.  ``tie_col`` orders events of one time; without it the status itself does.
    """
    aggs = [F.min(ts_col).alias("start_time"), F.max(ts_col).alias("end_time")]
    if status_col:
        aggs.append(F.max_by(status_col, F.struct(ts_col, tie_col or status_col)).alias("status"))
    aggs += [F.min_by(c, F.struct(ts_col, tie_col) if tie_col else F.col(ts_col)).alias(c) for c in identity_cols]
    g = events.groupBy(F.col(run_col).alias("run_id")).agg(*aggs)
    return g.withColumn("duration_seconds",
                        F.expr("timestampdiff(SECOND, start_time, end_time)").cast("long"))


def object_metrics(rows: DataFrame, keys: Mapping[str, str], rejected: Column, objects: DataFrame | None = None,
                   config_cols: Sequence[str] = ("target_table", "load_type")) -> DataFrame:
    """Rows read and rejected per (run, object); FAILED when any row is rejected.

    With ``objects`` (``source_object_config``) each row also has its object's ``config_cols``, NULL for an unknown object.
    """
    g = rows.groupBy(*[F.col(c).alias(a) for a, c in keys.items()]).agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(F.coalesce(rejected, F.lit(False))).alias("rows_rejected"))
    g = g.withColumn("status", F.when(F.col("rows_rejected") == 0, F.lit(SUCCESS)).otherwise(F.lit(FAILED)))
    return g if objects is None else join_per_key(g, objects.select("object_id", *config_cols), ["object_id"])


def normalise_error_type(c: Column) -> Column:
    """Values outside the closed list become UNKNOWN (keep the original in the message)."""
    return F.when(F.upper(c).isin(ERROR_TYPES), F.upper(c)).otherwise(F.lit("UNKNOWN"))


def error_attempts(errors: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                   out_col: str = "retry_attempt", grain: str = "MINUTE") -> DataFrame:
    """1-based attempt number of each error within its (run, object), by time.

    ``order_cols`` begins with the error's time.  Errors are numbered inside cells of one ``grain`` of time, which split a
    run/object with a huge number of errors; nothing runs or is written while the plan is built.
    """
    return numbered(errors, group_cols, order_cols, F.date_trunc(grain, F.col(order_cols[0])), out_col)


def table_counts(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of each named table, one row per table, one job."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
             for name, df in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def run_event(spark: SparkSession, run_id: str, pipeline_id: str, status: str, start_time, environment: str,
              end_time=None, triggered_by: str = "api", triggered_mode: str = "manual",
              counts: tuple[int, int, int] | None = None, job_id: str | None = None,
              job_run_id: str | None = None, created_at=None) -> DataFrame:
    """One ``job_run_audit`` event row (start: RUNNING; end: final status)."""
    total, ok, bad = counts if counts else (None, None, None)
    dur = int((end_time - start_time).total_seconds()) if end_time is not None else None
    row = (run_id, pipeline_id, job_id, job_run_id, triggered_by, triggered_mode, start_time, end_time,
           dur, status, total, ok, bad, environment, created_at or end_time or start_time)
    return spark.createDataFrame([row], schema_of("job_run_audit"))
