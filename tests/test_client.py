"""The client calls one by one, as a pipeline would make them."""

import os

from pyspark.sql import functions as F

from sluice.operators import dq
from sluice.plans.control import ControlPlane
from sluice.plans.seed_job import seed_from_document
from sluice.sinks.ddl import create_control_tables
from tests.conftest import FIXTURES, SF001

DOC = os.path.join(FIXTURES, "seed_document.json")


def test_client_lifecycle(spark, db):
    create_control_tables(spark, db)
    seed_from_document(spark, db, DOC, target_catalog="lake")
    cp = ControlPlane(spark, db, "orders_pipeline", environment="qa")

    objs = cp.get_source_objects().collect()
    assert [o.source_object for o in objs] == ["orders"]
    conf = cp.get_pipeline_config()
    assert conf["batch_size"] == 50000 and conf["alert_on_failure"] is False
    conn = cp.get_connection_config().first()
    assert conn.connection_name == "tpch_conn"
    meta = cp.get_metadata_columns("hash_incremental")
    assert [m.column_name for m in meta] == ["record_hash", "ingestion_timestamp", "load_run_id",
                                             "source_system", "source_object"]
    assert [m.column_name for m in cp.get_metadata_columns("full_load")][0] == "ingestion_timestamp"
    rules = cp.get_dq_rules("orders")  # by source object name as well as by id
    assert len(rules) == 5 and rules == cp.get_dq_rules(objs[0].object_id)

    run_id = cp.log_run_start(triggered_by="nightly", triggered_mode="schedule", job_id="J7", job_run_id="J7-1")
    df = spark.read.parquet(f"{SF001}/orders.parquet")
    n = df.count()

    # the registry: the first schema is no drift, a later difference is, and is logged and applied
    assert cp.detect_drift("orders", df.schema).count() == 0
    cp.register_schema("orders", df.schema, ["o_orderkey"])
    drifted = df.withColumn("o_clerk", F.lit("x")).drop("o_orderpriority")
    events = cp.detect_drift("orders", drifted.schema)
    assert {(r.column_name, r.drift_type, r.action_taken) for r in events.collect()} == {
        ("o_clerk", "NEW_COLUMN", "EVOLVED"), ("o_orderpriority", "DROPPED_COLUMN", "EVOLVED")}
    assert cp.log_drift(events)  # of the run started last
    spark.sql(f"CREATE TABLE {db}.orders_raw (o_orderkey BIGINT) USING parquet")
    assert cp.evolve_table(f"{db}.orders_raw", events) == ["o_clerk"]

    # a load that reads every order, of which seven are bad
    results = cp.run_dq_checks(df, rules)
    assert dq.gate(results) and cp.log_dq_results(run_id, "orders", results)
    assert cp.log_metrics(run_id, "orders", rows_read=n, rows_inserted=n - 7, rows_updated=0, rows_rejected=7)
    assert cp.log_error(run_id, "orders", "DISK_FULL", "first line\nsecond line", "where")

    # watermarks: nothing before the first load, then the latest
    assert cp.get_watermark("orders") is None
    cp.update_watermark("orders", "1998-08-01", run_id=run_id)
    cp.update_watermark("orders", "1998-08-02", run_id=run_id)
    assert cp.get_watermark("orders")["watermark_col_value"] == "1998-08-02"
    assert cp.log_run_end(run_id, "PARTIAL", (1, 0, 1))

    err = spark.table(f"{db}.job_run_error").first()
    assert (err.error_type, err.error_message, err.retry_attempt, err.environment) == (
        "UNKNOWN", "[DISK_FULL] first line\nsecond line", 1, "qa")
    m = spark.table(f"{db}.ingestion_metrics").first()
    assert (m.rows_read, m.rows_inserted, m.rows_updated, m.rows_rejected, m.load_type) == (n, n - 7, 0, 7, "hash_incremental")
    drift_row = spark.table(f"{db}.schema_drift_log").first()
    assert drift_row.run_id == run_id
    state = cp.run_states().filter(F.col("run_id") == run_id).first()
    assert state.status == "PARTIAL" and state.end_time >= state.start_time
    assert (state.triggered_by, state.triggered_mode, state.job_id, state.job_run_id) == ("nightly", "schedule", "J7", "J7-1")
    assert spark.table(f"{db}.job_run_audit").filter("environment = 'qa'").count() == 2
    reg = spark.table(f"{db}.object_schema_registry")
    assert reg.filter("is_primary_key").select("column_name").first()[0] == "o_orderkey"
    assert sorted(r.column_order for r in reg.collect()) == [1, 2, 3, 4, 5, 6]
