"""Table creation, log sinks, staged overwrite, file/JDBC/native sources."""

import json

import pytest
from pyspark.sql import functions as F

from sluice.schemas import TABLES, required_columns
from sluice.sinks import ddl, writers
from sluice.sources import jdbc_options, load_fixture, read_files, read_object, table_presence
from tests.conftest import SF001


def test_create_control_tables(spark, db):
    res = ddl.create_control_tables(spark, db)
    assert all(v is None for v in res.values()) and len(res) == 12
    pres = {r.table_name: r.present for r in table_presence(spark, db, list(TABLES) + ["nope"]).collect()}
    assert pres.pop("nope") is False and all(pres.values())
    assert spark.table(f"{db}.job_run_audit").columns[-1] == "environment"
    assert sum(len(f.dataType.simpleString()) > 0 for t in TABLES.values() for f in t.fields) == 155
    # idempotent
    assert all(v is None for v in ddl.create_control_tables(spark, db).values())


def test_log_sink_refuses_null_required(spark, db):
    ddl.create_control_tables(spark, db)
    good = spark.createDataFrame([("e1", "r1", "p", "o", "obj", "UNKNOWN", 1, "dev")],
                                 "error_id string, run_id string, pipeline_id string, object_id string, "
                                 "source_object string, error_type string, retry_attempt int, environment string") \
        .withColumn("error_ts", F.current_timestamp())
    assert writers.append_log(good, db, "job_run_error") is True
    bad = good.withColumn("run_id", F.lit(None).cast("string"))
    assert writers.append_log(bad, db, "job_run_error") is False
    assert spark.table(f"{db}.job_run_error").count() == 1
    # partition pruning on environment
    q = spark.table(f"{db}.job_run_error").filter("environment = 'dev'")
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(q._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [(environment" in plan


def test_staged_overwrite_of_self_reading_merge(spark, db):
    t, s = f"{db}.tgt", f"{db}.stg"
    spark.range(5).withColumn("v", F.lit("a")).write.saveAsTable(t)
    merged = spark.table(t).withColumn("v", F.lit("b")).unionByName(spark.range(5, 7).withColumn("v", F.lit("c")))
    writers.overwrite_via_staging(merged, t, s)
    got = {r.v: r["count"] for r in spark.table(t).groupBy("v").count().collect()}
    assert got == {"b": 5, "c": 2}


def test_insert_subset_of_columns(spark, db):
    ddl.create_control_tables(spark, db)
    rows = spark.createDataFrame([("c1", "p", "k", "v", True)],
                                 "config_id string, pipeline_id string, config_key string, config_value string, "
                                 "active_flag boolean").withColumn("created_at", F.current_timestamp()) \
        .withColumn("updated_at", F.current_timestamp())
    writers.insert_columns(rows, db, "pipeline_config")
    r = spark.table(f"{db}.pipeline_config").first()
    assert r.description is None and r.config_value == "v"
    assert "config_id" in required_columns("pipeline_config")


def test_file_sources_and_fixture(spark, tmp_path):
    j = tmp_path / "rows.json"
    j.write_text(json.dumps([{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]))
    c = tmp_path / "rows.csv"
    c.write_text("a,b\n1,x\n2,y\n")
    assert dict(load_fixture(spark, str(j)).dtypes)["a"] == "bigint"
    assert dict(load_fixture(spark, str(c)).dtypes)["a"] == "string"
    with pytest.raises(ValueError):
        load_fixture(spark, str(tmp_path / "rows.xml"))
    assert read_files(spark, str(c), "csv", schema="a int, b string").first().a == 1
    obj = {"source_type": "cloud_storage", "source_schema": SF001, "source_object": "nation.parquet"}
    assert read_object(spark, obj).count() == 25


def test_native_source(spark, db):
    spark.read.parquet(f"{SF001}/region.parquet").write.saveAsTable(f"{db}.region")
    obj = {"source_type": "databricks_native", "source_schema": db, "source_object": "region"}
    assert read_object(spark, obj).count() == 5


def test_jdbc_source_embedded_derby(spark):
    # embedded, in-process database: no server, no port
    url = "jdbc:derby:memory:sluice_test;create=true"
    conn = {"secret_scope": "s", "jdbc_url_secret_key": url, "jdbc_user_secret_key": None,
            "jdbc_password_secret_key": None, "driver_class": "org.apache.derby.jdbc.EmbeddedDriver",
            "extra_jdbc_options": json.dumps({"queryTimeout": "30"})}
    orders = spark.read.parquet(f"{SF001}/orders.parquet").select("o_orderkey", "o_totalprice").limit(50)
    orders.write.format("jdbc").options(url=url, driver=conn["driver_class"], dbtable="APP.ORDERS_T") \
        .mode("overwrite").save()
    opts = jdbc_options(conn, "APP.ORDERS_T", fetchsize=1000,
                        partitioning={"column": '"o_orderkey"', "lowerBound": 0, "upperBound": 1000,
                                      "numPartitions": 4})
    assert opts["fetchsize"] == "1000" and opts["queryTimeout"] == "30"
    obj = {"source_type": "jdbc", "source_schema": "APP", "source_object": "ORDERS_T"}
    df = read_object(spark, obj, connection=conn, fetchsize=1000,
                     partitioning={"column": '"o_orderkey"', "lowerBound": 0, "upperBound": 1000, "numPartitions": 4})
    assert df.rdd.getNumPartitions() == 4
    assert df.count() == 50
    assert jdbc_options({**conn, "extra_jdbc_options": "test"}, "t").get("queryTimeout") is None


def test_replace_table_swaps_location_once(spark, db):
    t, s = f"{db}.swap_t", f"{db}.swap_stg"
    spark.range(6).withColumn("v", F.lit("a")).write.bucketBy(4, "id").format("parquet").saveAsTable(t)
    before = writers.table_location(spark, t)
    merged = spark.table(t).withColumn("v", F.lit("b")).unionByName(spark.range(6, 8).withColumn("v", F.lit("c")))
    writers.replace_table(merged, t, s)
    after = writers.table_location(spark, t)
    assert after != before and "__v" in after
    got = {r.v: r["count"] for r in spark.table(t).groupBy("v").count().collect()}
    assert got == {"b": 6, "c": 2}
    assert not spark.catalog.tableExists(s)
    info = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {t}").collect()}
    assert info["Num Buckets"] == "4"
    import os
    assert not os.path.exists(before.replace("file:", ""))
    writers.replace_table(spark.table(t).filter("id < 3"), t, s)
    assert spark.table(t).count() == 3
