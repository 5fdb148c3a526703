"""One ingestion run: every active object of a pipeline, in load order.

Per object: read (watermark-narrowed), detect drift against the stored
registry, check quality before the write, inject metadata, then overwrite
(full load) or merge (hash incremental), observe the counts during the
write, log metrics, advance the watermark, re-register the schema.
Drift is detected against the stored registry *before* re-registering, so a
changed schema cannot hide its own drift.
"""

from __future__ import annotations

import itertools
import logging
import time
import uuid
import traceback
from concurrent.futures import ThreadPoolExecutor
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sluice.functions.hashing import hash_columns_for, record_hash
from sluice.functions.lists import parse_list
from sluice.operators import dq, drift, ingest
from sluice.plans.control import ControlPlane, utcnow
from sluice.sinks.writers import overwrite_via_staging, recover, replace_table, schema_changed, write_table
from sluice.sources.declared import read_registered_files, schema_from_registry
from sluice.sources.objects import CLOUD_STORAGE, read_object

log = logging.getLogger(__name__)


class RunHalted(RuntimeError):
    """A decision to stop this object (drift, quality, a bad definition): not retried."""

    def __init__(self, error_type: str, message: str):
        super().__init__(message)
        self.error_type = error_type


class SourceError(RuntimeError):
    """The source system failed: retried."""

    error_type = "JDBC_ERROR"


@dataclass
class ObjectResult:
    object_id: str
    source_object: str
    status: str
    counts: dict = field(default_factory=dict)
    error: str | None = None
    watermark: dict | None = None          # to advance at the end of the run
    schema_entry: tuple | None = None      # (object_id, schema, primary key) to re-register


def qualified(spark, catalog: str | None, name: str | None) -> str | None:
    """``catalog.db.table`` where the session has that catalog configured, else ``db.table``."""
    if not name:
        return None
    parts = name.split(".")
    if len(parts) > 2:
        catalog, parts = parts[0], parts[-2:]
    known = catalog and catalog != "spark_catalog" and spark.conf.get(f"spark.sql.catalog.{catalog}", None)
    return ".".join([catalog, *parts] if known else parts)


def _land(src: DataFrame, table: str) -> DataFrame:
    """Write the extract once and read it back: later passes (DQ, key check,
    merge) see one consistent snapshot and the source system is read once."""
    src.write.mode("overwrite").format("parquet").saveAsTable(table)
    return src.sparkSession.table(table)


def _read_files_or_table(cp: ControlPlane, obj: Mapping, settings: Mapping) -> tuple[DataFrame, DataFrame | None]:
    """An object's rows and, with the setting ``declared_schema``, the records of its CSV or JSON files that do not fit the registered schema."""
    path = f"{str(obj['source_schema']).rstrip('/')}/{obj['source_object']}"
    fmt = next((f for f in ("csv", "json") if path.lower().endswith(f".{f}")), None)
    if fmt and settings.get("declared_schema") and str(obj["source_type"]).strip().lower() == CLOUD_STORAGE:
        registered = [r.asDict() for r in cp.registered(obj["object_id"]).select("column_name", "data_type", "is_nullable", "column_order").collect()]
        got = read_registered_files(cp.spark, path, fmt, schema_from_registry(registered)) if registered else None
        if got:
            return got
    return read_object(cp.spark, obj), None


def ingest_object(cp: ControlPlane, obj: Mapping, run_id: str, settings: Mapping,
                  read: Callable[[Mapping], DataFrame] | None = None,
                  parents: Mapping[str, DataFrame] | None = None,
                  defer_control_updates: bool = False) -> ObjectResult:
    spark = cp.spark
    oid, name = obj["object_id"], obj["source_object"]
    load_type = str(obj["load_type"]).strip().lower()
    pk = parse_list(obj["primary_key"])
    catalog = obj.get("target_catalog")
    target = qualified(spark, catalog, f"{obj['target_schema']}.{obj['target_table']}")
    staging = qualified(spark, catalog, obj.get("staging_table")) or f"{target}__staging"
    if load_type == "hash_incremental" and not pk:
        raise RunHalted("VALIDATION_ERROR", f"{name} is loaded by hash and names no primary key")
    recover(spark, target, staging)
    wm_col = obj.get("watermark_column")
    t0 = time.time()
    misfits = None

    if read:
        src = read(obj)
    elif str(obj.get("source_type", "")).lower() == "jdbc":
        try:  # a partitioned read is asked for in the connection's options (partitionColumn, bounds, numPartitions)
            src = read_object(spark, obj, connection=cp.connection_for(oid), secret=cp.secret,
                              fetchsize=settings.get("batch_size"))
        except Exception as e:
            raise SourceError(str(e)) from e
    else:
        src, misfits = _read_files_or_table(cp, obj, settings)

    # N7/N8: narrow by the stored watermark (literal cast to the column type -> pushed to the scan)
    if load_type == "hash_incremental" and wm_col:
        wm = cp.get_watermark(oid)
        if wm and wm.get("watermark_col_value"):
            src = ingest.extract_since(src, wm_col, watermark=wm["watermark_col_value"])

    # live sources (JDBC, or when asked) are landed once; file and table sources are re-read as they are
    if str(obj.get("source_type", "")).lower() == "jdbc" or settings.get("land_extract"):
        try:
            src = _land(src, f"{staging}__extract")
        except Exception as e:
            raise (SourceError(str(e)) if str(obj.get("source_type", "")).lower() == "jdbc" else e) from e

    # R3-R6: drift against the stored registry
    events = cp.detect_drift(oid, src.schema, setting=settings.get("schema_drift_action"),
                             ignore=parse_list(settings.get("schema_drift_ignore")))
    found = events.collect()  # one row per drifted column of one object
    if found:
        cp.log_drift(spark.createDataFrame(found, events.schema), run_id, oid)
        if any(r.action_taken == drift.HALTED for r in found):
            raise RunHalted("SCHEMA_MISMATCH", f"schema drift halted {name}: "
                            + ", ".join(f"{r.column_name}:{r.drift_type}" for r in found if r.action_taken == drift.HALTED))
    source_schema = src.schema  # registered as seen, ignored columns included
    ignored_new = [r.column_name for r in found if r.action_taken == drift.IGNORED and r.drift_type == drift.NEW]
    if ignored_new:  # an ignored new column does not evolve the target
        src = src.drop(*ignored_new)

    # Q7-Q12: quality before the write (one aggregate job; results are one row per rule)
    rules = cp.get_dq_rules(oid)
    action = str(settings.get("dq_failure_action", "HALT")).upper()
    rows_read = None
    clean = src
    if rules:
        results = dq.evaluate_rules(src, rules, parents, failure_action=action)
        got = results.collect()
        cp.log_dq_results(run_id, oid, spark.createDataFrame(got, results.schema))
        for r in got:
            if r.reason:
                cp.log_error(run_id, oid, "DQ_ERROR", f"rule {r.rule_id} cannot be judged: {r.reason}", retry_attempt=0)
        if any(r.action_taken == dq.HALTED for r in got):
            raise RunHalted("DQ_ERROR", f"data-quality ERROR rule failed for {name}: "
                            + ", ".join(r.rule_id for r in got if r.action_taken == dq.HALTED))
        checked = [r.rows_checked for r in got if r.rows_checked is not None]
        rows_read = max(checked) if checked else None
        # rows failing ERROR rules are set aside (only reached when the failure action lets the run go on);
        # rules that failed no row add nothing to the write
        failed_ids = {r.rule_id for r in got if r.rows_failed}
        row_rules = [r for r in rules if r.severity.upper() == "ERROR" and r.kind != "ROW_COUNT"
                     and r.rule_id in failed_ids]
        if row_rules:
            clean, rejected = dq.quarantine(src, row_rules, parents)
            write_table(rejected.withColumn("load_run_id", F.lit(run_id)), f"{target}__rejected", mode="append")

    # N11: metadata columns
    specs = cp.get_metadata_columns(load_type)
    meta_names = [s.column_name for s in specs]
    hcols = hash_columns_for(clean, obj.get("hash_columns"), exclude=meta_names)
    run_values = {"load_run_id": run_id, "source_system": obj["source_system"], "source_object": name,
                  "pipeline_id": cp.pipeline_id, "run_ts": F.lit(utcnow()).cast("timestamp")}
    data = ingest.inject_metadata(clean, specs, run_values, hcols)
    if load_type == "hash_incremental" and "record_hash" not in data.columns:
        data = data.withColumn("record_hash", record_hash(hcols))

    # counts ride on the write: no extra pass over the data
    obs_src = Observation(f"loaded_{oid}")
    observed = [F.count(F.lit(1)).alias("rows")]
    if wm_col:  # as text, in Spark: a value brought to Python would take the driver's time zone
        observed.append(F.max(wm_col).cast("string").alias("wm"))
    data = data.observe(obs_src, *observed)

    buckets = settings.get("target_buckets") or int(spark.conf.get("spark.sql.shuffle.partitions"))
    layout = {"bucket_cols": pk, "buckets": buckets} if load_type == "hash_incremental" else {}
    # N5/D3: soft delete flags keys absent from the extract; a watermark-narrowed extract leaves
    # most keys out on purpose, so soft delete is refused there
    soft = bool(settings.get("soft_delete")) and load_type == "hash_incremental"
    if soft and wm_col:
        log.warning("soft_delete ignored for %s: a watermark extract does not list absent rows", name)
        soft = False
    if load_type == "hash_incremental":
        ingest.assert_unique_keys(clean, pk)  # D13: NULL or repeated keys would make the merge ambiguous
    part_cols = [c for c in parse_list(settings.get("target_partition_columns")) if c in clean.columns] \
        if load_type == "hash_incremental" else []
    if load_type == "full_load" and spark.catalog.tableExists(target):
        replace_table(data, target, staging)  # new version written once, then switched (schema may evolve)
        loaded = obs_src.get
        counts = {"rows_inserted": loaded["rows"], "rows_updated": 0, "rows_deleted": 0}
    elif load_type == "full_load" or not spark.catalog.tableExists(target):
        if soft:
            data = data.withColumn("is_deleted", F.lit(False))
        write_table(data, target, mode="overwrite", partition_cols=part_cols, **layout)
        loaded = obs_src.get
        counts = {"rows_inserted": loaded["rows"], "rows_updated": 0, "rows_deleted": 0}
    else:
        tgt = spark.table(target)
        stored_parts = [c.name for c in spark.catalog.listColumns(target) if c.isPartition]
        confined = bool(stored_parts) and not schema_changed(data, target)  # evolved: whole table
        confined = confined and not soft and all(c in clean.columns for c in stored_parts)
        touched = None
        if confined:  # only these partitions are read and rewritten; soft delete needs the whole target
            touched = touched_partitions(clean, tgt, pk, stored_parts, values_fixed=bool(settings.get("partition_values_fixed")))
            touched.write.mode("overwrite").format("parquet").saveAsTable(f"{staging}__touched")
            touched = spark.table(f"{staging}__touched")
            tgt = in_partitions(tgt, touched, stored_parts)
        merged = ingest.merge_snapshot(data, tgt, pk, "record_hash", soft_delete=soft, change_col="_change")
        obs = Observation(f"merge_{oid}")
        c = F.col("_change")
        merged = merged.observe(obs, F.count_if(c == ingest.INSERT).alias("ins"),
                                F.count_if(c == ingest.UPDATE).alias("upd"),
                                F.count_if(c == ingest.ABSENT).alias("absent")).drop("_change")
        if confined:
            overwrite_via_staging(merged, target, staging, partition_cols=stored_parts, dynamic=True, touched=touched, **layout)
            spark.sql(f"DROP TABLE IF EXISTS {staging}__touched")
        else:
            replace_table(merged, target, staging, **layout)
        m, loaded = obs.get, obs_src.get
        counts = {"rows_inserted": m["ins"], "rows_updated": m["upd"], "rows_deleted": m["absent"] if soft else 0}
    clean_rows = loaded["rows"]
    counts["rows_read"] = rows_read if rows_read is not None else clean_rows
    if misfits is not None:
        counts["rows_read"] += _set_misfits_aside(misfits, f"{target}__unreadable", run_id)
    counts["rows_rejected"] = counts["rows_read"] - clean_rows
    duration = int(time.time() - t0)
    cp.log_metrics(run_id, oid, counts["rows_read"], counts["rows_inserted"], counts["rows_updated"],
                   counts["rows_rejected"], counts["rows_deleted"], duration, "SUCCESS")
    result = ObjectResult(oid, name, "SUCCESS", counts, schema_entry=(oid, source_schema, pk))
    if wm_col and loaded.get("wm") is not None:
        result.watermark = {"object_id": oid, "watermark_value": loaded["wm"], "run_id": run_id,
                            "rows_loaded": clean_rows, "watermark_col": wm_col}
    if not defer_control_updates:
        apply_control_updates(cp, [result])
    return result


def _set_misfits_aside(misfits: DataFrame, table: str, run_id: str) -> int:
    """Append the records that did not fit their declared schema; how many they were."""
    seen = Observation(f"misfits_{uuid.uuid4().hex}")
    write_table(misfits.withColumn("load_run_id", F.lit(run_id)).observe(seen, F.count(F.lit(1)).alias("n")), table, mode="append")
    return seen.get["n"]


def touched_partitions(batch: DataFrame, target: DataFrame, pk: list[str], part_cols: list[str],
                       values_fixed: bool = False) -> DataFrame:
    """The partitions a merge of ``batch`` must rewrite, one row each.

    Those are the partitions holding batch rows, plus the partitions where a batch key
    lives today (a key whose partition value changed must leave its old partition).
    The second set costs a semi-join of the batch keys against the target's key and
    partition columns only, far less than rewriting untouched partitions.  When a key's
    partition value can never change (``values_fixed``, e.g. the date of an immutable
    event) that check is skipped and untouched partitions are not read at all.
    """
    types = {f.name: f.dataType for f in target.schema.fields}
    found = batch.select(*[F.col(c).cast(types[c]).alias(c) for c in part_cols])
    if not values_fixed:
        found = found.unionByName(target.select(*pk, *part_cols).join(batch.select(*pk), pk, "left_semi").select(*part_cols))
    return found.distinct()


def in_partitions(target: DataFrame, partitions: DataFrame, part_cols: list[str]) -> DataFrame:
    """The target's rows in the listed partitions: a semi-join on the partition columns, which prunes the scan."""
    same = None
    for c in part_cols:
        term = target[c].eqNullSafe(partitions[c])
        same = term if same is None else same & term
    return target.join(partitions, same, "left_semi")


def apply_control_updates(cp: ControlPlane, results: list[ObjectResult]) -> None:
    """Advance watermarks and re-register schemas of successful objects: one
    rewrite of each control table per run, not one per object."""
    ok = [r for r in results if r.status == "SUCCESS"]
    cp.update_watermarks([r.watermark for r in ok if r.watermark])
    cp.register_schemas([r.schema_entry for r in ok if r.schema_entry])


def run_pipeline(cp: ControlPlane, read: Callable[[Mapping], DataFrame] | None = None,
                 parents: Mapping[str, DataFrame] | None = None, triggered_by: str = "api",
                 triggered_mode: str = "manual") -> dict:
    """Run every active object in load order; an object failure is logged and
    the run goes on; the run ends SUCCESS, FAILED or PARTIAL."""
    cp.refresh()  # config is read fresh once per run, then remembered for its objects
    run_id = cp.log_run_start(triggered_by=triggered_by, triggered_mode=triggered_mode)
    cp.buffer_logs()  # metric, DQ and drift rows of all objects go out in one append per table
    results: list[ObjectResult] = []
    objects: list[dict] = []
    kept_books = True
    try:
        settings = cp.get_pipeline_config()
        objects = [r.asDict() for r in cp.get_source_objects().collect()]  # config rows of one pipeline
        attempts = max(1, int(settings.get("max_retry") or 1))
        delay = float(settings.get("retry_delay_seconds") or 0)
        parallel = max(1, int(settings.get("max_parallel_objects") or 1))

        def load(obj: dict) -> ObjectResult:
            for attempt in range(1, attempts + 1):
                try:
                    return ingest_object(cp, obj, run_id, settings, read, parents, defer_control_updates=True)
                except Exception as e:
                    halted = isinstance(e, (RunHalted, ingest.MergeKeyError))
                    kind = e.error_type if isinstance(e, (RunHalted, SourceError)) else (
                        "MERGE_ERROR" if isinstance(e, ingest.MergeKeyError) else "UNKNOWN")
                    cp.log_error(run_id, obj["object_id"], kind, str(e) or repr(e),
                                 traceback.format_exc(), retry_attempt=attempt)
                    if halted or attempt == attempts:  # halts are decisions, not transient faults
                        cp.log_metrics(run_id, obj["object_id"], status="FAILED")
                        return ObjectResult(obj["object_id"], obj["source_object"], "FAILED", error=str(e))
                    time.sleep(delay)
            raise AssertionError("unreachable")

        # objects of one load_order are independent: up to max_parallel_objects run as concurrent Spark
        # jobs; the next load_order starts when the previous one is done
        for _, group in itertools.groupby(objects, key=lambda o: o["load_order"]):
            group = list(group)
            if parallel == 1 or len(group) == 1:
                results.extend(load(o) for o in group)
            else:
                with ThreadPoolExecutor(max_workers=min(parallel, len(group))) as pool:
                    results.extend(pool.map(load, group))
        try:
            apply_control_updates(cp, results)
        except Exception as e:  # the loads are done; report the bookkeeping failure, do not lose the run
            log.error("control table update failed: %s", e)
            cp.log_error(run_id, objects[0]["object_id"] if objects else "-", "UNKNOWN", str(e) or repr(e),
                         traceback.format_exc())
            kept_books = False
    finally:
        cp.flush_logs()
    ok = sum(r.status == "SUCCESS" for r in results)
    bad = len(results) - ok
    status = "SUCCESS" if bad == 0 else ("FAILED" if ok == 0 else "PARTIAL")
    if not kept_books and status == "SUCCESS":
        status = "PARTIAL"  # the data is loaded, but watermarks or schemas lag behind
    cp.log_run_end(run_id, status, (len(results), ok, bad))
    return {"run_id": run_id, "status": status, "objects": results}


__all__ = ["run_pipeline", "ingest_object", "apply_control_updates", "touched_partitions", "in_partitions", "RunHalted", "ObjectResult"]
