"""Control-plane client: read config, log runs, metrics, errors, drift, DQ.

The method names follow the client calls an ingestion job makes
(``get_source_objects``, ``log_run_start``, ``run_dq_checks`` ...).  Reads
return DataFrames or, for config that decides control flow (settings,
rules, metadata specs, one watermark), a small collected value.  Writes go
through ``sluice.sinks``.
"""

from __future__ import annotations

import datetime as dt
import logging
import threading
import uuid
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.operators import audit, config, dq, drift
from sluice.operators.ingest import MetadataSpec
from sluice.schemas import TABLES
from sluice.sinks.ddl import check_identifier
from sluice.sinks.writers import append_log, insert_columns

log = logging.getLogger(__name__)

# Typed pipeline settings and their defaults when a pipeline sets none.
SETTING_TYPES = {
    "max_retry": "int", "retry_delay_seconds": "int", "batch_size": "int", "max_parallel_objects": "int",
    "schema_drift_action": "string", "dq_failure_action": "string", "alert_on_failure": "boolean",
    "alert_email": "string", "target_buckets": "int", "soft_delete": "boolean", "land_extract": "boolean", "declared_schema": "boolean",
    "schema_drift_ignore": "string", "target_partition_columns": "string",
    "partition_values_fixed": "boolean",
}
SETTING_DEFAULTS = {"schema_drift_action": "EVOLVE", "dq_failure_action": "HALT", "max_retry": 3}
# Log tables whose rows a run may hold and append once at its end.
BUFFERED_LOGS = {"ingestion_metrics", "dq_check_results", "schema_drift_log"}


def utcnow() -> dt.datetime:
    """Now, with its zone: Spark takes a naive time as one in the driver's zone."""
    return dt.datetime.now(dt.timezone.utc)


class ControlPlane:
    def __init__(self, spark: SparkSession, database: str, pipeline_id: str, environment: str = "dev",
                 secret=None):
        """``secret(scope, key) -> value`` resolves JDBC credentials named by connection rows."""
        self.spark = spark
        self.secret = secret
        self.database = check_identifier(database)
        self.pipeline_id = pipeline_id
        self.environment = environment
        self._runs: dict[str, dict] = {}  # start time and identity of the runs started here
        # objects may load in parallel threads; writes to the shared control tables go one at a time
        self._write_lock = threading.RLock()
        self._ids: dict[str, str] = {}
        self._rows: dict[str, dict] = {}
        self._memo: dict = {}
        self._buffer: dict[str, list[DataFrame]] | None = None

    def refresh(self) -> None:
        """Forget remembered config; a run calls this once at its start."""
        self._ids.clear()
        self._rows.clear()
        self._memo.clear()

    def _append(self, df: DataFrame, table: str) -> bool:
        with self._write_lock:
            if self._buffer is not None and table in BUFFERED_LOGS:
                self._buffer.setdefault(table, []).append(df)
                return True
            return append_log(df, self.database, table)

    def buffer_logs(self) -> None:
        """Hold metric, DQ-result and drift rows until ``flush_logs``: one append (and one set of
        files) per log table and run instead of one per object.  Errors and run events are not held."""
        with self._write_lock:
            self._buffer = {}

    def flush_logs(self) -> bool:
        with self._write_lock:
            buf, self._buffer = self._buffer or {}, None
        ok = True
        for table, frames in buf.items():
            df = frames[0]
            for f in frames[1:]:
                df = df.unionByName(f, allowMissingColumns=True)
            ok = self._append(df.coalesce(1), table) and ok  # a run's log rows are few: one file
        return ok

    def _insert(self, df: DataFrame, table: str) -> None:
        """Append rows that must not get lost: a failure is raised."""
        with self._write_lock:
            insert_columns(df, self.database, table)

    # ---- tables -----------------------------------------------------------
    def table(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.database}.{name}")

    def _mine(self, name: str) -> DataFrame:
        return self.table(name).filter(F.col("pipeline_id") == self.pipeline_id)

    # ---- configuration (C1-C5) -------------------------------------------
    def get_source_objects(self) -> DataFrame:
        return config.active_objects(self.table("source_object_config"), self.pipeline_id)

    def get_pipeline_config(self, types: Mapping[str, str] | None = None) -> dict:
        if types is None and "settings" in self._memo:
            return dict(self._memo["settings"])
        memo = types is None
        types = dict(types or SETTING_TYPES)
        wide = config.pipeline_settings(self._mine("pipeline_config"), types).collect()  # one row
        values = dict(SETTING_DEFAULTS)
        if wide:
            values.update({k: v for k, v in wide[0].asDict().items() if k != "pipeline_id" and v is not None})
        if memo:
            self._memo["settings"] = dict(values)
        return values

    def get_connection_config(self) -> DataFrame:
        return config.connections_for(self.get_source_objects(), self.table("connection_config"))

    def connection_for(self, object_id: str) -> dict | None:
        """The active connection row of one object (by pipeline and source system), or None."""
        oid = self.resolve_object_id(object_id)
        rows = self.get_connection_config().filter(F.col("object_id") == oid).limit(1).collect()
        return rows[0].asDict() if rows and rows[0]["connection_name"] is not None else None

    def get_metadata_columns(self, load_type: str | None = None) -> list[MetadataSpec]:
        key = ("metadata", load_type)
        if key not in self._memo:
            self._memo[key] = self._metadata_columns(load_type)
        return list(self._memo[key])

    def _metadata_columns(self, load_type: str | None) -> list[MetadataSpec]:
        pipes = self.spark.createDataFrame([(self.pipeline_id,)], "pipeline_id string")
        cfg = self.table("metadata_column_config").drop("config_id", "created_at", "is_merge_key")
        rows = config.effective_metadata(cfg, pipes, load_type).collect()  # config: a few rows
        return sorted((MetadataSpec(r.column_name, r.computation, r.column_order, r.data_type, r.applies_to)
                       for r in rows), key=lambda s: (s.column_order, s.column_name))

    def resolve_object_id(self, object_or_name: str) -> str:
        """Accept an object id or its source object name (both occur in practice).

        Config does not change during a run, so answers are remembered.
        """
        if object_or_name in self._ids:
            return self._ids[object_or_name]
        objs = self._mine("source_object_config")
        hit = (objs.filter((F.col("object_id") == object_or_name) | (F.col("source_object") == object_or_name))
               .orderBy("created_at", "object_id").select("object_id").limit(1).collect())
        oid = hit[0].object_id if hit else object_or_name
        if hit:
            self._ids[object_or_name] = oid
        return oid

    def get_dq_rules(self, object_id: str) -> list[dq.Rule]:
        key = ("rules", self.resolve_object_id(object_id))
        if key not in self._memo:
            self._memo[key] = dq.rules_from_config(self._mine("dq_rule_config"), key[1])
        return list(self._memo[key])

    def _object_row(self, object_id: str) -> dict:
        oid = self.resolve_object_id(object_id)
        if oid in self._rows:
            return self._rows[oid]
        rows = self._mine("source_object_config").filter(F.col("object_id") == oid).limit(1).collect()
        if rows:
            self._rows[oid] = rows[0].asDict()
            return self._rows[oid]
        return {"object_id": oid, "source_object": object_id, "target_table": "", "load_type": "", "write_mode": ""}

    # ---- run lifecycle (A1, A2) -------------------------------------------
    def log_run_start(self, triggered_by: str = "api", triggered_mode: str = "manual",
                      job_id: str | None = None, job_run_id: str | None = None) -> str:
        run_id = str(uuid.uuid4())
        start = utcnow()
        who = {"triggered_by": triggered_by, "triggered_mode": triggered_mode, "job_id": job_id, "job_run_id": job_run_id}
        self._runs[run_id] = {"start": start, **who}
        ev = audit.run_event(self.spark, run_id, self.pipeline_id, audit.RUNNING, start, self.environment, **who)
        self._append(ev, "job_run_audit")
        return run_id

    def _started(self, run_id: str) -> dict:
        """Start time and identity of a run, from its start event if another client began it."""
        if run_id not in self._runs:
            who = ["triggered_by", "triggered_mode", "job_id", "job_run_id"]
            first = F.min_by(F.struct(F.unix_micros("start_time").alias("us"), *who), "created_at").alias("f")
            got = self.table("job_run_audit").filter(F.col("run_id") == run_id).agg(first).select("f.*").first()
            known = got is not None and got["us"] is not None
            start = dt.datetime.fromtimestamp(got["us"] / 1e6, dt.timezone.utc) if known else utcnow()
            self._runs[run_id] = {"start": start, **({c: got[c] for c in who} if known else {})}
        return dict(self._runs[run_id])

    def log_run_end(self, run_id: str, status: str, counts: tuple[int, int, int] | None = None) -> bool:
        """The end event; who started the run, and how, is what the start event says."""
        who = self._started(run_id)
        ev = audit.run_event(self.spark, run_id, self.pipeline_id, status.upper(), who.pop("start"), self.environment,
                             end_time=utcnow(), counts=counts, **who)
        return self._append(ev, "job_run_audit")

    def run_states(self) -> DataFrame:
        """Latest state per run from the appended events (no in-place update).  Of two events of one time the final one counts."""
        a = self.table("job_run_audit")
        order = F.struct("created_at", F.col("end_time").isNotNull())
        latest = F.max_by(F.struct(*[c for c in a.columns if c != "run_id"]), order)
        return a.groupBy("run_id").agg(latest.alias("_l")).select("run_id", "_l.*")

    # ---- errors and metrics (A4, A5) --------------------------------------
    def log_error(self, run_id: str, object_id: str, error_type: str, error_message: str | None,
                  stack_trace: str | None = None, retry_attempt: int | None = None) -> bool:
        try:
            obj = self._object_row(object_id)
            kind = error_type.upper() if error_type and error_type.upper() in audit.ERROR_TYPES else "UNKNOWN"
            message = error_message if kind == (error_type or "").upper() else f"[{error_type}] {error_message}"
            if retry_attempt is None:
                prior = self.table("job_run_error").filter(
                    (F.col("run_id") == run_id) & (F.col("object_id") == obj["object_id"]) & (F.col("retry_attempt") > 0)).count()
                retry_attempt = prior + 1
            row = (str(uuid.uuid4()), run_id, self.pipeline_id, obj["object_id"], obj["source_object"], kind,
                   message, stack_trace, int(retry_attempt), utcnow(), self.environment)
            return self._append(self.spark.createDataFrame([row], TABLES["job_run_error"]), "job_run_error")
        except Exception as e:  # never crash on logging
            log.error("log_error failed: %s", e)
            return False

    def log_metrics(self, run_id: str, object_id: str, rows_read: int | None = None,
                    rows_inserted: int | None = None, rows_updated: int | None = None,
                    rows_rejected: int | None = None, rows_deleted: int | None = 0,
                    duration_seconds: int | None = None, status: str = "SUCCESS") -> bool:
        try:
            obj = self._object_row(object_id)
            row = (str(uuid.uuid4()), run_id, self.pipeline_id, obj["object_id"], obj["source_object"],
                   obj["target_table"], obj["load_type"], obj["write_mode"], rows_read, rows_inserted,
                   rows_updated, rows_deleted, rows_rejected, duration_seconds, status, utcnow(), self.environment)
            return self._append(self.spark.createDataFrame([row], TABLES["ingestion_metrics"]), "ingestion_metrics")
        except Exception as e:
            log.error("log_metrics failed: %s", e)
            return False

    # ---- watermarks (N7, N9, N10) -------------------------------------------
    def watermarks(self) -> DataFrame:
        """The latest watermark row of each object: rows are appended, never rewritten."""
        w = self.table("watermark_control")
        keys = ["object_id", "pipeline_id"]
        latest = F.max_by(F.struct(*[c for c in w.columns if c not in keys]), F.struct("updated_at", "last_run_id", "watermark_col_value"))
        return w.groupBy(*keys).agg(latest.alias("_l")).select(*keys, "_l.*").select(*w.columns)

    def get_watermark(self, object_id: str) -> dict | None:
        """The stored watermark row, or None on the first run (full extract)."""
        oid = self.resolve_object_id(object_id)
        rows = self.watermarks().filter((F.col("pipeline_id") == self.pipeline_id) & (F.col("object_id") == oid)).collect()
        return rows[0].asDict() if rows else None

    def update_watermark(self, object_id: str, watermark_value, run_id: str | None = None,
                         rows_loaded: int | None = None, watermark_col: str | None = None) -> None:
        """Advance the object's watermark; call only after a successful load."""
        self.update_watermarks([{"object_id": self.resolve_object_id(object_id), "watermark_value": watermark_value,
                                 "run_id": run_id, "rows_loaded": rows_loaded, "watermark_col": watermark_col}])

    def update_watermarks(self, entries: Sequence[Mapping]) -> None:
        """Append one row per object.  Clients that advance different objects at once cannot undo each other."""
        if not entries:
            return
        now = utcnow()

        def text(v):
            if v is None:
                return None
            return v.isoformat(sep=" ") if isinstance(v, dt.datetime) else str(v)

        rows = [(e["object_id"], self.pipeline_id, now, e.get("run_id"), e.get("rows_loaded"), now,
                 e.get("watermark_col"), text(e.get("watermark_value"))) for e in entries]
        new = self.spark.createDataFrame(rows, "object_id string, pipeline_id string, last_run_ts timestamp, "
                                               "last_run_id string, rows_last_loaded bigint, updated_at timestamp, "
                                               "watermark_col string, watermark_col_value string")
        self._insert(new.withColumn("watermark_col_hash", F.sha2(F.col("watermark_col_value"), 256)).coalesce(1), "watermark_control")

    # ---- schema registry and drift (R1-R7) -----------------------------------
    def current_schema_rows(self, object_id: str, schema: T.StructType, primary_key: Iterable[str] = ()) -> DataFrame:
        return drift.describe_schema(self.spark, schema, self.resolve_object_id(object_id), self.pipeline_id,
                                     primary_key)

    def registry(self) -> DataFrame:
        """The latest registry row of each column: rows are appended, never rewritten."""
        r = self.table("object_schema_registry")
        keys = ["object_id", "pipeline_id", "column_name"]
        latest = F.max_by(F.struct(*[c for c in r.columns if c not in keys]), F.struct("updated_at", "schema_id"))
        return r.groupBy(*keys).agg(latest.alias("_l")).select(*keys, "_l.*").select(*r.columns)

    def registered(self, object_id: str) -> DataFrame:
        oid = self.resolve_object_id(object_id)
        return self.registry().filter((F.col("pipeline_id") == self.pipeline_id) & (F.col("object_id") == oid) & F.col("active_flag"))

    def detect_drift(self, object_id: str, schema: T.StructType, setting: str | None = None,
                     ignore: Sequence[str] = ()) -> DataFrame:
        reg = self.registered(object_id).select("object_id", "column_name", "data_type", "is_nullable")
        cur = self.current_schema_rows(object_id, schema)
        if reg.limit(1).count() == 0:  # first registration is not drift
            cur = cur.limit(0)
        events = drift.detect_drift(reg, cur)
        setting = setting or self.get_pipeline_config().get("schema_drift_action", "EVOLVE")
        return drift.drift_actions(events, setting, ignore)

    def register_schema(self, object_id: str, schema: T.StructType, primary_key: Iterable[str] = ()) -> None:
        """Re-register one object's schema (see ``register_schemas``)."""
        self.register_schemas([(object_id, schema, list(primary_key))])

    def register_schemas(self, entries: Sequence[tuple[str, T.StructType, Sequence[str]]]) -> None:
        """Re-register schemas: current columns active, first registration time
        kept, vanished columns kept inactive.  One full-outer join and one
        append for all objects of a run."""
        if not entries:
            return
        now = utcnow()
        oids = [self.resolve_object_id(o) for o, _, _ in entries]
        cur = None
        for oid, (_, schema, pk) in zip(oids, entries):
            rows = drift.describe_schema(self.spark, schema, oid, self.pipeline_id, pk)
            cur = rows if cur is None else cur.unionByName(rows)
        reg_all = self.registry()
        mine = F.col("object_id").isin(oids) & (F.col("pipeline_id") == self.pipeline_id)
        old = reg_all.filter(mine).drop("schema_id", "updated_at", "active_flag", "pipeline_id")
        new = drift.reregister(old, cur.drop("pipeline_id"), F.lit(now).cast("timestamp"),
                               keys=["object_id", "column_name"])
        ids = reg_all.filter(mine).select("object_id", "column_name", "schema_id")
        new = (new.join(ids, ["object_id", "column_name"], "left")
               .withColumn("schema_id", F.coalesce("schema_id", F.expr("uuid()")))
               .withColumn("pipeline_id", F.lit(self.pipeline_id))
               .drop("is_new"))
        self._insert(new.select(*reg_all.columns).coalesce(1), "object_schema_registry")

    def log_drift(self, drift_events: DataFrame, run_id: str | None = None, object_id: str | None = None) -> bool:
        """Append drift events.  Without ``run_id`` they belong to the run started last, without ``object_id`` to the object they name."""
        run_id = run_id or next(reversed(self._runs), None)
        if object_id is None:
            first = drift_events.select("object_id").limit(1).collect()
            if not first:
                return True
            object_id = first[0]["object_id"]
        obj = self._object_row(object_id)
        rows = drift_events.select(
            F.expr("uuid()").alias("drift_id"), F.lit(run_id).alias("run_id"), F.lit(obj["object_id"]).alias("object_id"),
            F.lit(self.pipeline_id).alias("pipeline_id"), F.lit(obj["source_object"]).alias("source_object"),
            "column_name", "drift_type", "old_value", "new_value", "action_taken",
            F.lit(utcnow()).cast("timestamp").alias("detected_at"), F.lit(self.environment).alias("environment"))
        return self._append(rows, "schema_drift_log")

    def evolve_table(self, target_table: str, drift_events: DataFrame, schema: T.StructType | None = None) -> list[str]:
        """Add the new columns of the events to a table; without ``schema`` their types are those the events name."""
        events = [r.asDict() for r in drift_events.collect()]  # one row per drifted column
        if schema is None:
            new = {e["column_name"]: e["new_value"] for e in events if e["drift_type"] == drift.NEW}
            schema = T.StructType([T.StructField(c, T._parse_datatype_string(t.lower())) for c, t in new.items()])
        if not self.spark.catalog.tableExists(target_table):
            return []
        return drift.evolve_table(self.spark, target_table, events, schema)

    # ---- data quality (Q7-Q12) ------------------------------------------------
    def run_dq_checks(self, df: DataFrame, rules: Sequence[dq.Rule], parents: Mapping[str, DataFrame] | None = None,
                      failure_action: str | None = None) -> DataFrame:
        action = failure_action or self.get_pipeline_config().get("dq_failure_action", "HALT")
        return dq.evaluate_rules(df, rules, parents, failure_action=action)

    def log_dq_results(self, run_id: str, object_id: str, results: DataFrame) -> bool:
        oid = self.resolve_object_id(object_id)
        rows = dq.check_result_rows(results, run_id, oid, self.pipeline_id, utcnow(), self.environment) \
            .withColumn("result_id", F.expr("uuid()"))
        return self._append(rows, "dq_check_results")
