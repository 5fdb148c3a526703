"""Connections, namespaces, table evolution, full-load runs, the stream front end."""

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.operators import config, drift
from sluice.plans.control import ControlPlane
from sluice.plans.ingestion_run import run_pipeline
from sluice.sinks.ddl import create_control_tables, create_namespaces
from sluice.sinks.writers import insert_columns
from sluice.streaming import merge_stream
from tests.conftest import SF001


def test_connections_for_objects(spark):
    objs = spark.createDataFrame([("o1", "p", "sys_a"), ("o2", "p", "sys_b")],
                                 "object_id string, pipeline_id string, source_system string")
    conns = spark.createDataFrame([("p", "sys_a", "conn_a", True), ("p", "sys_a", "old", False)],
                                  "pipeline_id string, source_system string, connection_name string, active_flag boolean")
    got = {r.object_id: r.connection_name for r in config.connections_for(objs, conns).collect()}
    assert got == {"o1": "conn_a", "o2": None}


def test_namespaces(spark):
    create_namespaces(spark, {"ns_raw_t": "raw layer", "ns_stage_t": "it's staging"})
    names = {d.name for d in spark.catalog.listDatabases()}
    assert {"ns_raw_t", "ns_stage_t"} <= names


def test_evolve_table_adds_column(spark, db):
    spark.createDataFrame([(1,)], "a int").write.saveAsTable(f"{db}.t")
    ev = [{"column_name": "b", "drift_type": "NEW_COLUMN", "action_taken": "EVOLVED"},
          {"column_name": "a", "drift_type": "TYPE_CHANGE", "action_taken": "HALTED"}]
    cur = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    assert drift.evolve_table(spark, f"{db}.t", ev, cur) == ["b"]
    assert spark.table(f"{db}.t").columns == ["a", "b"]


def test_full_load_run(spark, db, tmp_path):
    create_control_tables(spark, db)
    spark.sql("CREATE DATABASE IF NOT EXISTS rawfl")
    spark.sql("DROP TABLE IF EXISTS rawfl.nation")
    now = F.current_timestamp()
    obj = spark.createDataFrame([("obj-1", "p_full", "tpch", "cloud_storage", SF001, "nation.parquet", "lake",
                                  "rawfl", "nation", None, "full_load", "overwrite", "n_nationkey", None, None,
                                  True, 1, "t", "t")],
                                "object_id string, pipeline_id string, source_system string, source_type string, "
                                "source_schema string, source_object string, target_catalog string, "
                                "target_schema string, target_table string, staging_table string, "
                                "load_type string, write_mode string, primary_key string, "
                                "watermark_column string, hash_columns string, active_flag boolean, "
                                "load_order int, created_by string, updated_by string") \
        .withColumn("created_at", now).withColumn("updated_at", now)
    insert_columns(obj, db, "source_object_config")
    meta = spark.createDataFrame([("m1", "default", "load_run_id", "STRING", "all", "load_run_id", 1, False, True),
                                  ("m2", "default", "record_hash", "STRING", "hash_incremental",
                                   "sha2(concat_ws('|', hash_columns), 256)", 2, False, True)],
                                 "config_id string, pipeline_id string, column_name string, data_type string, "
                                 "applies_to string, computation string, column_order int, is_merge_key boolean, "
                                 "active_flag boolean").withColumn("created_at", now)
    insert_columns(meta, db, "metadata_column_config")
    cp = ControlPlane(spark, db, "p_full")
    for _ in range(2):
        res = run_pipeline(cp)
        assert res["status"] == "SUCCESS", res
    out = spark.table("rawfl.nation")
    assert out.count() == 25 and "record_hash" not in out.columns
    assert out.select("load_run_id").distinct().first()[0] == res["run_id"]
    # the source gains a column: the next full load carries it into the target
    scratch = str(tmp_path)
    spark.read.parquet(f"{SF001}/nation.parquet").withColumn("n_comment", F.lit("c")) \
        .write.parquet(os.path.join(scratch, "nation.parquet"))
    obj2 = spark.table(f"{db}.source_object_config").withColumn("source_schema", F.lit(scratch))
    obj2.write.saveAsTable(f"{db}.so_fl_tmp")
    spark.sql(f"INSERT OVERWRITE {db}.source_object_config SELECT * FROM {db}.so_fl_tmp")
    res3 = run_pipeline(cp)
    assert res3["status"] == "SUCCESS", res3
    out = spark.table("rawfl.nation")
    assert out.count() == 25 and out.filter("n_comment = 'c'").count() == 25


def test_stream_front_end_merges_files(spark, db, tmp_path):
    inbox = tmp_path / "inbox"
    orders = spark.read.parquet(f"{SF001}/orders.parquet")
    orders.filter("o_orderkey % 2 = 0").write.parquet(str(inbox / "b1"))
    q = merge_stream(spark, str(inbox / "*"), orders.schema, f"{db}.orders", f"{db}.orders_stg",
                     ["o_orderkey"], str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    assert spark.table(f"{db}.orders").count() == orders.filter("o_orderkey % 2 = 0").count()
    newer = orders.withColumn("o_totalprice", F.col("o_totalprice") + 1)
    orders.unionByName(newer).write.parquet(str(inbox / "b2"))  # two versions of every key
    q = merge_stream(spark, str(inbox / "*"), orders.schema, f"{db}.orders", f"{db}.orders_stg",
                     ["o_orderkey"], str(tmp_path / "ckpt"), order_cols=["o_totalprice"])
    q.awaitTermination(120)
    got = spark.table(f"{db}.orders")
    assert got.count() == orders.count() and got.select(orders.columns).exceptAll(newer).count() == 0


def test_watermark_run_narrows_second_extract(spark, db):
    create_control_tables(spark, db)
    spark.sql("CREATE DATABASE IF NOT EXISTS rawwm")
    spark.sql("DROP TABLE IF EXISTS rawwm.orders")
    spark.sql("DROP TABLE IF EXISTS rawwm.orders__staging")
    now = F.current_timestamp()
    obj = spark.createDataFrame([("obj-w", "p_wm", "tpch", "cloud_storage", SF001, "orders.parquet", "lake",
                                  "rawwm", "orders", None, "hash_incremental", "merge", "o_orderkey", "o_orderdate",
                                  None, True, 1, "t", "t")],
                                "object_id string, pipeline_id string, source_system string, source_type string, "
                                "source_schema string, source_object string, target_catalog string, "
                                "target_schema string, target_table string, staging_table string, "
                                "load_type string, write_mode string, primary_key string, "
                                "watermark_column string, hash_columns string, active_flag boolean, "
                                "load_order int, created_by string, updated_by string") \
        .withColumn("created_at", now).withColumn("updated_at", now)
    insert_columns(obj, db, "source_object_config")
    meta = spark.createDataFrame([("m1", "default", "load_run_id", "STRING", "all", "load_run_id", 1, False, True)],
                                 "config_id string, pipeline_id string, column_name string, data_type string, "
                                 "applies_to string, computation string, column_order int, is_merge_key boolean, "
                                 "active_flag boolean").withColumn("created_at", now)
    insert_columns(meta, db, "metadata_column_config")
    cp = ControlPlane(spark, db, "p_wm")
    r1 = run_pipeline(cp)
    assert r1["status"] == "SUCCESS", r1
    orders = spark.read.parquet(f"{SF001}/orders.parquet")
    top = orders.agg(F.max("o_orderdate")).first()[0]
    wm = cp.get_watermark("obj-w")
    assert wm["watermark_col"] == "o_orderdate" and wm["watermark_col_value"].startswith(str(top.date()))
    assert wm["watermark_col_hash"] and wm["rows_last_loaded"] == orders.count()
    r2 = run_pipeline(cp)
    c = r2["objects"][0].counts
    assert c["rows_read"] == orders.filter(F.col("o_orderdate") >= top).count()
    assert (c["rows_inserted"], c["rows_updated"]) == (0, 0)
    assert spark.table("rawwm.orders").count() == orders.count()


def _files_by_partition(spark, table):
    from sluice.sinks.writers import table_location
    root = table_location(spark, table).replace("file:", "")
    out = {}
    for d in sorted(os.listdir(root)):
        if "=" in d:
            out[d] = sorted(f for f in os.listdir(os.path.join(root, d)) if f.endswith(".parquet"))
    return out


def test_partition_confined_merge(spark, db):
    create_control_tables(spark, db)
    spark.sql("CREATE DATABASE IF NOT EXISTS rawpt")
    for t in ("orders", "orders__staging"):
        spark.sql(f"DROP TABLE IF EXISTS rawpt.{t}")
    spark.sql("CREATE DATABASE IF NOT EXISTS srcpt")
    spark.sql("DROP TABLE IF EXISTS srcpt.orders")
    orders = spark.read.parquet(f"{SF001}/orders.parquet")
    orders.write.saveAsTable("srcpt.orders")
    now = F.current_timestamp()
    obj = spark.createDataFrame([("obj-pt", "p_pt", "tpch", "databricks_native", "srcpt", "orders", "lake",
                                  "rawpt", "orders", None, "hash_incremental", "merge", "o_orderkey", "o_orderdate",
                                  None, True, 1, "t", "t")],
                                "object_id string, pipeline_id string, source_system string, source_type string, "
                                "source_schema string, source_object string, target_catalog string, "
                                "target_schema string, target_table string, staging_table string, "
                                "load_type string, write_mode string, primary_key string, "
                                "watermark_column string, hash_columns string, active_flag boolean, "
                                "load_order int, created_by string, updated_by string") \
        .withColumn("created_at", now).withColumn("updated_at", now)
    insert_columns(obj, db, "source_object_config")
    meta = spark.createDataFrame([("m1", "default", "load_run_id", "STRING", "all", "load_run_id", 1, False, True)],
                                 "config_id string, pipeline_id string, column_name string, data_type string, "
                                 "applies_to string, computation string, column_order int, is_merge_key boolean, "
                                 "active_flag boolean").withColumn("created_at", now)
    insert_columns(meta, db, "metadata_column_config")
    cfg = spark.createDataFrame([("c1", "p_pt", "target_partition_columns", "o_orderstatus", None, True)],
                                "config_id string, pipeline_id string, config_key string, config_value string, "
                                "description string, active_flag boolean") \
        .withColumn("created_at", now).withColumn("updated_at", now)
    insert_columns(cfg, db, "pipeline_config")
    cp = ControlPlane(spark, db, "p_pt")
    assert run_pipeline(cp)["status"] == "SUCCESS"
    assert [c.name for c in spark.catalog.listColumns("rawpt.orders") if c.isPartition] == ["o_orderstatus"]
    before = _files_by_partition(spark, "rawpt.orders")

    top = orders.agg(F.max("o_orderdate")).first()[0]
    at_top = orders.filter(F.col("o_orderdate") == top).collect()
    moved_key = at_top[0].o_orderkey
    old_status = at_top[0].o_orderstatus
    new_status = "P" if old_status != "P" else "O"
    max_key = orders.agg(F.max("o_orderkey")).first()[0]
    new_rows = orders.limit(3).withColumn("o_orderkey", F.col("o_orderkey") + max_key + 1) \
        .withColumn("o_orderdate", F.lit(top).cast("timestamp_ntz")).withColumn("o_orderstatus", F.lit(new_status))
    changed = orders.withColumn("o_orderstatus", F.when(F.col("o_orderkey") == moved_key, F.lit(new_status))
                                .otherwise(F.col("o_orderstatus"))).unionByName(new_rows)
    spark.sql("DROP TABLE srcpt.orders")
    changed.write.saveAsTable("srcpt.orders")
    res = run_pipeline(cp)
    assert res["status"] == "SUCCESS", res
    tgt = spark.table("rawpt.orders")
    assert tgt.count() == orders.count() + 3
    assert tgt.groupBy("o_orderkey").count().filter("count > 1").count() == 0  # the moved key left its old partition
    assert tgt.filter(F.col("o_orderkey") == moved_key).first().o_orderstatus == new_status
    touched = {f"o_orderstatus={r.o_orderstatus}" for r in at_top} | {f"o_orderstatus={new_status}"}
    after = _files_by_partition(spark, "rawpt.orders")
    for part, files in before.items():
        if part not in touched:
            assert after[part] == files, part  # untouched partitions were not rewritten
        else:
            assert after[part] != files, part


def test_command_line(spark, tmp_path, capsys):
    import json

    from sluice.__main__ import main
    name = "cli_ctl"
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")
    assert main(["ddl", "--control-schema", name, "--raw-schema", "cli_raw", "--staging-schema", "cli_stg"]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["created"] == 12
    assert main(["seed", "--control-schema", name, "--config-path",
                 os.path.join(os.path.dirname(__file__), "fixtures", "seed_document.json")]) == 0
    rep = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert rep["failed"] == 0 and rep["pipeline_config"] == {"inserted": 8}
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


def test_touched_partitions_fixed_values_reads_batch_only(spark):
    from sluice.plans.ingestion_run import in_partitions, touched_partitions
    tgt = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, p string")
    batch = spark.createDataFrame([(2, "c")], "k int, p string")  # key 2 moved from b to c
    moved = in_partitions(tgt, touched_partitions(batch, tgt, ["k"], ["p"]), ["p"])
    assert sorted(r.p for r in moved.collect()) == ["b", "c"]
    fixed = in_partitions(tgt, touched_partitions(batch, tgt, ["k"], ["p"], values_fixed=True), ["p"])
    assert [r.p for r in fixed.collect()] == ["c"]
