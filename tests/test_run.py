"""End to end: create tables, seed twice, run, rerun, drift, DQ halt."""

import os

from pyspark.sql import functions as F

from sluice.plans.control import ControlPlane
from sluice.plans.ingestion_run import run_pipeline
from sluice.plans.seed_job import seed_from_document
from sluice.sinks.ddl import create_control_tables
from tests.conftest import FIXTURES, SF001

DOC = os.path.join(FIXTURES, "seed_document.json")


def _setup(spark, db):
    create_control_tables(spark, db)
    spark.sql("CREATE DATABASE IF NOT EXISTS srcdb")
    spark.sql("CREATE DATABASE IF NOT EXISTS raw")
    spark.sql("CREATE DATABASE IF NOT EXISTS staging")
    spark.sql("DROP TABLE IF EXISTS raw.orders")
    spark.sql("DROP TABLE IF EXISTS staging.orders")
    spark.read.parquet(f"{SF001}/orders.parquet").write.mode("overwrite").saveAsTable("srcdb.orders")


def test_seed_twice(spark, db):
    create_control_tables(spark, db)
    first = seed_from_document(spark, db, DOC, target_catalog="lake")
    assert sum(v.get("inserted", 0) for k, v in first.items() if k != "failed") == 20
    assert first["failed"] == 0
    second = seed_from_document(spark, db, DOC, target_catalog="lake")
    assert sum(v.get("skipped", 0) for k, v in second.items() if k != "failed") == 20
    assert sum(v.get("inserted", 0) for k, v in second.items() if k != "failed") == 0
    so = spark.table(f"{db}.source_object_config").first()
    assert so.target_catalog == "lake" and so.object_id and so.created_at is not None
    rules = spark.table(f"{db}.dq_rule_config")
    assert rules.filter(F.col("object_id") == so.object_id).count() == 5


def test_run_rerun_and_halt(spark, db):
    _setup(spark, db)
    seed_from_document(spark, db, DOC, target_catalog="lake")
    cp = ControlPlane(spark, db, "orders_pipeline", environment="dev")
    assert cp.get_pipeline_config()["max_retry"] == 2

    r1 = run_pipeline(cp)
    assert r1["status"] == "SUCCESS", r1
    n = spark.table("srcdb.orders").count()
    assert spark.table("raw.orders").count() == n
    assert {"record_hash", "load_run_id", "ingestion_timestamp"} <= set(spark.table("raw.orders").columns)

    r2 = run_pipeline(cp)
    assert r2["status"] == "SUCCESS"
    c = r2["objects"][0].counts
    assert (c["rows_inserted"], c["rows_updated"]) == (0, 0)
    # unchanged rows keep the first run's id
    assert spark.table("raw.orders").filter(F.col("load_run_id") == r1["run_id"]).count() == n

    states = {r.run_id: r.status for r in cp.run_states().collect()}
    assert states[r1["run_id"]] == "SUCCESS" and states[r2["run_id"]] == "SUCCESS"
    assert spark.table(f"{db}.ingestion_metrics").filter("status = 'SUCCESS'").count() == 2
    assert cp.registry().filter("active_flag").count() == 6
    assert spark.table(f"{db}.dq_check_results").count() == 10

    # drift: a new column EVOLVES; a NULL key is rejected by an ERROR rule -> run halts
    src = spark.table("srcdb.orders")
    changed = (src.withColumn("o_comment", F.lit("c"))
               .withColumn("o_custkey", F.when(F.col("o_orderkey") == 1, None).otherwise(F.col("o_custkey"))))
    changed.write.mode("overwrite").saveAsTable("srcdb.orders_v2")
    spark.sql("DROP TABLE srcdb.orders")
    spark.table("srcdb.orders_v2").write.saveAsTable("srcdb.orders")
    r3 = run_pipeline(cp)
    assert r3["status"] == "FAILED"
    err = spark.table(f"{db}.job_run_error").filter(F.col("run_id") == r3["run_id"]).first()
    assert err.error_type == "DQ_ERROR" and err.retry_attempt == 1
    drift_rows = spark.table(f"{db}.schema_drift_log").filter(F.col("run_id") == r3["run_id"]).collect()
    assert [(d.column_name, d.drift_type, d.action_taken) for d in drift_rows] == [
        ("o_comment", "NEW_COLUMN", "EVOLVED")]


def test_bucketed_target_merge_shuffles_source_only(spark, db):
    _setup(spark, db)
    seed_from_document(spark, db, DOC, target_catalog="lake")
    cp = ControlPlane(spark, db, "orders_pipeline")
    assert run_pipeline(cp)["status"] == "SUCCESS"
    info = {r.col_name: r.data_type for r in spark.sql("DESCRIBE TABLE EXTENDED raw.orders").collect()}
    assert info["Bucket Columns"] == "[`o_orderkey`]"
    from sluice.operators.ingest import merge_snapshot
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        src = spark.table("srcdb.orders").withColumn("record_hash", F.lit("x"))
        plan = merge_snapshot(src, spark.table("raw.orders"), ["o_orderkey"])._jdf.queryExecution() \
            .executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 1


def test_warn_action_sets_failing_rows_aside(spark, db):
    _setup(spark, db)
    spark.sql("DROP TABLE IF EXISTS raw.orders__rejected")
    seed_from_document(spark, db, DOC, target_catalog="lake")
    cfg = spark.table(f"{db}.pipeline_config").withColumn(
        "config_value", F.when(F.col("config_key") == "dq_failure_action", "WARN").otherwise(F.col("config_value")))
    cfg.write.saveAsTable(f"{db}.pc_tmp")
    spark.sql(f"INSERT OVERWRITE {db}.pipeline_config SELECT * FROM {db}.pc_tmp")
    src = spark.read.parquet(f"{SF001}/orders.parquet")
    bad = src.withColumn("o_custkey", F.when(F.col("o_orderkey") < 10, None).otherwise(F.col("o_custkey")))
    spark.sql("DROP TABLE srcdb.orders")
    bad.write.saveAsTable("srcdb.orders")
    cp = ControlPlane(spark, db, "orders_pipeline")
    assert cp.get_pipeline_config()["dq_failure_action"] == "WARN"
    res = run_pipeline(cp)
    assert res["status"] == "SUCCESS", res
    n_bad = src.filter("o_orderkey < 10").count()
    c = res["objects"][0].counts
    assert c["rows_rejected"] == n_bad and c["rows_read"] == src.count()
    rej = spark.table("raw.orders__rejected")
    assert rej.count() == n_bad and rej.filter("failed_rules = 'cust_not_null'").count() == n_bad
    assert spark.table("raw.orders").count() == src.count() - n_bad


def _add_object(spark, db, object_id, source_object, load_order):
    base = spark.table(f"{db}.source_object_config").limit(1)
    row = (base.withColumn("object_id", F.lit(object_id)).withColumn("source_object", F.lit(source_object))
           .withColumn("target_table", F.lit(source_object)).withColumn("staging_table", F.lit(None).cast("string"))
           .withColumn("load_order", F.lit(load_order)))
    row.write.saveAsTable(f"{db}.so_tmp_{load_order}")
    spark.sql(f"INSERT INTO {db}.source_object_config SELECT * FROM {db}.so_tmp_{load_order}")


def test_partial_run_with_retries(spark, db):
    _setup(spark, db)
    spark.sql("DROP TABLE IF EXISTS raw.missing_src")
    seed_from_document(spark, db, DOC, target_catalog="lake")
    _add_object(spark, db, "obj-missing", "missing_src", 2)
    cp = ControlPlane(spark, db, "orders_pipeline")
    res = run_pipeline(cp)
    assert res["status"] == "PARTIAL"
    errs = spark.table(f"{db}.job_run_error").filter(F.col("run_id") == res["run_id"]).orderBy("retry_attempt").collect()
    assert [(e.object_id, e.error_type, e.retry_attempt) for e in errs] == [
        ("obj-missing", "UNKNOWN", 1), ("obj-missing", "UNKNOWN", 2)]
    end = {r.run_id: r for r in cp.run_states().collect()}[res["run_id"]]
    assert (end.status, end.total_objects, end.success_objects, end.failed_objects) == ("PARTIAL", 2, 1, 1)


def test_duplicate_source_keys_are_merge_error(spark, db):
    _setup(spark, db)
    seed_from_document(spark, db, DOC, target_catalog="lake")
    cp = ControlPlane(spark, db, "orders_pipeline")
    assert run_pipeline(cp)["status"] == "SUCCESS"
    src = spark.read.parquet(f"{SF001}/orders.parquet")
    spark.sql("DROP TABLE srcdb.orders")
    src.unionByName(src.limit(3)).write.saveAsTable("srcdb.orders")
    res = run_pipeline(cp)
    assert res["status"] == "FAILED"
    errs = spark.table(f"{db}.job_run_error").filter(F.col("run_id") == res["run_id"]).collect()
    assert [(e.error_type, e.retry_attempt) for e in errs] == [("MERGE_ERROR", 1)]
    assert spark.table("raw.orders").count() == src.count()  # target untouched


def test_seed_document_first_row_wins(spark, db, tmp_path):
    import json
    doc = json.load(open(DOC))
    dup = dict(doc["pipeline_config"][0], config_value="99")
    doc["pipeline_config"].append(dup)
    p = tmp_path / "doc.json"
    p.write_text(json.dumps(doc))
    create_control_tables(spark, db)
    rep = seed_from_document(spark, db, str(p))
    assert rep["pipeline_config"] == {"inserted": 8, "skipped": 1}
    got = spark.table(f"{db}.pipeline_config").filter("config_key = 'max_retry'").first()
    assert got.config_value == "2"


def test_parallel_objects_same_load_order(spark, db):
    _setup(spark, db)
    spark.sql("DROP TABLE IF EXISTS raw.orders_copy")
    spark.sql("DROP TABLE IF EXISTS srcdb.orders_copy")
    spark.table("srcdb.orders").write.saveAsTable("srcdb.orders_copy")
    seed_from_document(spark, db, DOC, target_catalog="lake")
    _add_object(spark, db, "obj-copy", "orders_copy", 1)   # same load_order as orders
    cfg = spark.table(f"{db}.pipeline_config").withColumn(
        "config_value", F.when(F.col("config_key") == "max_parallel_objects", "2").otherwise(F.col("config_value")))
    cfg.write.saveAsTable(f"{db}.pc_tmp2")
    spark.sql(f"INSERT OVERWRITE {db}.pipeline_config SELECT * FROM {db}.pc_tmp2")
    cp = ControlPlane(spark, db, "orders_pipeline")
    res = run_pipeline(cp)
    assert res["status"] == "SUCCESS", res
    n = spark.table("srcdb.orders").count()
    assert spark.table("raw.orders").count() == n and spark.table("raw.orders_copy").count() == n
    assert spark.table(f"{db}.ingestion_metrics").filter(F.col("run_id") == res["run_id"]).count() == 2
    # the rules belong to the orders object only
    assert spark.table(f"{db}.dq_check_results").filter(F.col("run_id") == res["run_id"]).count() == 5


def test_soft_delete_run(spark, db):
    _setup(spark, db)
    seed_from_document(spark, db, DOC, target_catalog="lake")
    spark.sql(f"INSERT INTO {db}.pipeline_config SELECT 'cfg-sd', 'orders_pipeline', 'soft_delete', 'true', "
              f"'flag absent rows', true, current_timestamp(), current_timestamp()")
    cp = ControlPlane(spark, db, "orders_pipeline")
    assert run_pipeline(cp)["status"] == "SUCCESS"
    src = spark.read.parquet(f"{SF001}/orders.parquet")
    spark.sql("DROP TABLE srcdb.orders")
    src.filter("o_orderkey % 7 <> 0").write.saveAsTable("srcdb.orders")
    res = run_pipeline(cp)
    gone = src.filter("o_orderkey % 7 = 0").count()
    assert res["objects"][0].counts["rows_deleted"] == gone
    tgt = spark.table("raw.orders")
    assert tgt.count() == src.count() and tgt.filter("is_deleted").count() == gone


def test_jdbc_object_run_lands_extract(spark, db):
    import json
    url = "jdbc:derby:memory:sluice_run;create=true"
    drv = "org.apache.derby.jdbc.EmbeddedDriver"
    src = spark.read.parquet(f"{SF001}/orders.parquet")
    src.write.format("jdbc").options(url=url, driver=drv, dbtable="APP.ORDERS_J").mode("overwrite").save()
    create_control_tables(spark, db)
    spark.sql("CREATE DATABASE IF NOT EXISTS rawj")
    for t in ("orders_j", "orders_j__staging__extract"):
        spark.sql(f"DROP TABLE IF EXISTS rawj.{t}")
    now = F.current_timestamp()
    obj = spark.createDataFrame([("obj-j", "p_j", "derby", "jdbc", "APP", "ORDERS_J", "lake", "rawj", "orders_j",
                                  None, "hash_incremental", "merge", "o_orderkey", None, None, True, 1, "t", "t")],
                                "object_id string, pipeline_id string, source_system string, source_type string, "
                                "source_schema string, source_object string, target_catalog string, "
                                "target_schema string, target_table string, staging_table string, "
                                "load_type string, write_mode string, primary_key string, "
                                "watermark_column string, hash_columns string, active_flag boolean, "
                                "load_order int, created_by string, updated_by string") \
        .withColumn("created_at", now).withColumn("updated_at", now)
    from sluice.sinks.writers import insert_columns
    insert_columns(obj, db, "source_object_config")
    opts = json.dumps({"partitionColumn": '"o_orderkey"', "lowerBound": "0", "upperBound": "6000",
                       "numPartitions": "3"})
    conn = spark.createDataFrame([("c-j", "p_j", "derby", "derby_mem", "scope", "URL", "USER", "PWD", drv, opts,
                                   True)],
                                 "connection_id string, pipeline_id string, source_system string, "
                                 "connection_name string, secret_scope string, jdbc_url_secret_key string, "
                                 "jdbc_user_secret_key string, jdbc_password_secret_key string, "
                                 "driver_class string, extra_jdbc_options string, active_flag boolean") \
        .withColumn("created_at", now).withColumn("updated_at", now)
    insert_columns(conn, db, "connection_config")
    secrets = {"URL": url, "USER": "app", "PWD": "app"}
    cp = ControlPlane(spark, db, "p_j", secret=lambda scope, key: secrets[key])
    res = run_pipeline(cp)
    assert res["status"] == "SUCCESS", res
    assert spark.table("rawj.orders_j").count() == src.count()
    assert spark.table("rawj.orders_j__staging__extract").count() == src.count()
    again = run_pipeline(cp)["objects"][0].counts
    assert (again["rows_inserted"], again["rows_updated"]) == (0, 0)


def test_evolved_source_reaches_target(spark, db):
    _setup(spark, db)
    src = spark.read.parquet(f"{SF001}/orders.parquet")
    spark.sql("DROP TABLE srcdb.orders")
    src.withColumn("o_custkey", F.col("o_custkey").cast("int")).write.saveAsTable("srcdb.orders")
    seed_from_document(spark, db, DOC, target_catalog="lake")
    cp = ControlPlane(spark, db, "orders_pipeline")
    assert run_pipeline(cp)["status"] == "SUCCESS"
    assert dict(spark.table("raw.orders").dtypes)["o_custkey"] == "int"
    spark.sql("DROP TABLE srcdb.orders")
    src.withColumn("o_comment", F.lit("new")).write.saveAsTable("srcdb.orders")  # o_custkey back to bigint
    res = run_pipeline(cp)
    assert res["status"] == "SUCCESS", res
    drift_rows = {(d.column_name, d.drift_type, d.action_taken)
                  for d in spark.table(f"{db}.schema_drift_log").filter(F.col("run_id") == res["run_id"]).collect()}
    assert drift_rows == {("o_comment", "NEW_COLUMN", "EVOLVED"), ("o_custkey", "TYPE_CHANGE", "EVOLVED")}
    tgt = spark.table("raw.orders")
    assert dict(tgt.dtypes)["o_custkey"] == "bigint" and "o_comment" in tgt.columns
    assert tgt.count() == src.count() and tgt.filter("o_comment = 'new'").count() == src.count()
    info = {r.col_name: r.data_type for r in spark.sql("DESCRIBE TABLE EXTENDED raw.orders").collect()}
    assert info["Bucket Columns"] == "[`o_orderkey`]"
    again = run_pipeline(cp)["objects"][0].counts
    assert (again["rows_inserted"], again["rows_updated"]) == (0, 0)


def test_drift_ignore_list_setting(spark, db):
    _setup(spark, db)
    seed_from_document(spark, db, DOC, target_catalog="lake")
    spark.sql(f"INSERT INTO {db}.pipeline_config SELECT 'cfg-ig', 'orders_pipeline', 'schema_drift_ignore', "
              f"'o_comment', 'ignored columns', true, current_timestamp(), current_timestamp()")
    cp = ControlPlane(spark, db, "orders_pipeline")
    assert run_pipeline(cp)["status"] == "SUCCESS"
    src = spark.read.parquet(f"{SF001}/orders.parquet")
    spark.sql("DROP TABLE srcdb.orders")
    src.withColumn("o_comment", F.lit("x")).write.saveAsTable("srcdb.orders")
    res = run_pipeline(cp)
    got = [(d.column_name, d.action_taken) for d in
           spark.table(f"{db}.schema_drift_log").filter(F.col("run_id") == res["run_id"]).collect()]
    assert got == [("o_comment", "IGNORED")]
    assert "o_comment" not in spark.table("raw.orders").columns
    third = run_pipeline(cp)  # registered as seen: no drift again
    assert spark.table(f"{db}.schema_drift_log").filter(F.col("run_id") == third["run_id"]).count() == 0


def test_seed_failures_reported_then_raised(spark, db, tmp_path):
    import json

    import pytest

    from sluice.plans.seed_job import SeedFailed
    doc = json.load(open(DOC))
    doc["pipeline_config"].append({"pipeline_id": "orders_pipeline", "config_key": None, "config_value": "1",
                                   "active_flag": True})
    doc["dq_rule_config"].append(dict(doc["dq_rule_config"][0], rule_id="orphan", source_object="nowhere"))
    p = tmp_path / "doc.json"
    p.write_text(json.dumps(doc))
    create_control_tables(spark, db)
    rep = seed_from_document(spark, db, str(p))
    assert rep["pipeline_config"] == {"inserted": 8, "failed": 1}
    assert rep["dq_rule_config"] == {"inserted": 5, "dropped": 1}
    assert rep["failed"] == 1
    with pytest.raises(SeedFailed):
        seed_from_document(spark, db, str(p), raise_on_failure=True)
