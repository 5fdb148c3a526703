"""Sinks and control tables under the conditions that lose data: emptied partitions, crashes, two clients, time zones."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from sluice.operators.ingest import merge_snapshot
from sluice.plans.control import ControlPlane
from sluice.plans.ingestion_run import in_partitions, qualified, touched_partitions
from sluice.sinks import writers
from sluice.sinks.ddl import create_control_tables


def _partitioned(spark, db, rows):
    t = f"{db}.target"
    spark.createDataFrame(rows, "k int, v string, p string").write.partitionBy("p").format("parquet").saveAsTable(t)
    return t


def _rows(spark, t):
    spark.catalog.refreshTable(t)
    return sorted(map(tuple, spark.table(t).select("k", "v", "p").collect()), key=str)


def test_move_out_of_a_partition_leaves_nothing_behind(spark, db):
    t = _partitioned(spark, db, [(1, "a", "A"), (2, "b", "B"), (3, "c", None)])
    tgt = spark.table(t).withColumn("record_hash", F.col("v"))
    batch = spark.createDataFrame([(1, "x", "B"), (3, "y", "C")], "k int, v string, p string").withColumn("record_hash", F.col("v"))
    touched = touched_partitions(batch, tgt, ["k"], ["p"])
    assert sorted(r.p or "" for r in touched.collect()) == ["", "A", "B", "C"]
    merged = merge_snapshot(batch, in_partitions(tgt, touched, ["p"]), ["k"]).select("k", "v", "p")
    writers.overwrite_via_staging(merged, t, f"{t}__staging", partition_cols=["p"], dynamic=True, touched=touched)
    assert _rows(spark, t) == [(1, "x", "B"), (2, "b", "B"), (3, "y", "C")]


def test_full_load_replaces_all_partitions(spark, db):
    t = _partitioned(spark, db, [(1, "a", "A"), (2, "b", "B")])
    writers.replace_table(spark.createDataFrame([(9, "z", "B")], "k int, v string, p string"), t, f"{t}__staging")
    assert _rows(spark, t) == [(9, "z", "B")]


def test_appends_go_by_name_and_add_new_columns(spark, db):
    t = f"{db}.rejected"
    writers.write_table(spark.createDataFrame([(1, "a")], "k int, v string"), t)
    writers.write_table(spark.createDataFrame([("b", 2, "new")], "v string, k int, extra string"), t)
    assert sorted(map(tuple, spark.table(t).select("k", "v", "extra").collect())) == [(1, "a", None), (2, "b", "new")]


def test_crash_between_renames_is_recovered(spark, db):
    t = f"{db}.target"
    spark.createDataFrame([(1, "a")], "k int, v string").write.format("parquet").saveAsTable(t)
    spark.sql(f"ALTER TABLE {t} RENAME TO target__prev")  # as a crash would leave it
    writers.recover(spark, t, f"{t}__staging")
    assert spark.table(t).collect()[0].v == "a"


def test_complete_staging_is_applied_after_a_crash(spark, db, monkeypatch):
    t = _partitioned(spark, db, [(1, "a", "A"), (2, "b", "B")])
    moved = spark.createDataFrame([(1, "x", "B"), (2, "b", "B")], "k int, v string, p string")
    touched = spark.createDataFrame([("A",), ("B",)], "p string")
    with monkeypatch.context() as m:
        m.setattr(writers, "_finish_staging", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            writers.overwrite_via_staging(moved, t, f"{t}__staging", partition_cols=["p"], dynamic=True, touched=touched)
    assert _rows(spark, t) == [(1, "a", "A"), (2, "b", "B")]
    writers.recover(spark, t, f"{t}__staging")
    assert _rows(spark, t) == [(1, "x", "B"), (2, "b", "B")]
    assert not spark.catalog.tableExists(f"{t}__staging")


def test_bucketed_first_write_has_one_file_a_bucket(spark, db):
    t = f"{db}.bucketed"
    writers.write_table(spark.range(2000).repartition(13).withColumn("v", F.lit("x")), t, mode="overwrite", bucket_cols=["id"], buckets=4)
    assert spark.table(t).select(F.input_file_name()).distinct().count() == 4


def test_two_clients_lose_nothing(spark, db):
    create_control_tables(spark, db)
    a, b = (ControlPlane(spark, db, "p", "qa") for _ in range(2))
    for i in range(3):
        a.update_watermark(f"a{i}", str(i))
        b.update_watermark(f"b{i}", str(i))
    a.update_watermark("a0", "7")
    got = {r.object_id: r.watermark_col_value for r in a.watermarks().collect()}
    assert got == {"a0": "7", "a1": "1", "a2": "2", "b0": "0", "b1": "1", "b2": "2"}


@pytest.mark.parametrize("zone", ["Asia/Tokyo", "America/Lima"])
def test_times_are_exact_in_any_driver_zone(spark, db, zone, monkeypatch):
    monkeypatch.setenv("TZ", zone)
    time.tzset()
    try:
        create_control_tables(spark, db)
        cp = ControlPlane(spark, db, "p", "qa")
        before = dt.datetime.now(dt.timezone.utc).timestamp()
        run = cp.log_run_start()
        cp._runs.clear()  # as another client would see it
        cp.log_run_end(run, "SUCCESS", (1, 1, 0))
        s = cp.run_states().select(F.unix_micros("start_time") / 1e6, "duration_seconds").first()
        assert abs(s[0] - before) < 60 and 0 <= s[1] < 60
        src = spark.sql("SELECT TIMESTAMP '2024-05-01 12:00:00' AS ts")
        text = src.agg(F.max("ts").cast("string")).first()[0]
        cp.update_watermark("o", text, watermark_col="ts")
        from sluice.operators.ingest import extract_since
        assert extract_since(src, "ts", watermark=cp.get_watermark("o")["watermark_col_value"]).count() == 1
    finally:
        monkeypatch.undo()
        time.tzset()


def test_names_keep_a_known_catalog(spark):
    assert qualified(spark, None, "db.t") == qualified(spark, "elsewhere", "db.t") == "db.t"
    spark.conf.set("spark.sql.catalog.lake", "none.such.Catalog")
    try:
        assert qualified(spark, "lake", "db.t") == "lake.db.t" == qualified(spark, None, "lake.db.t")
    finally:
        spark.conf.unset("spark.sql.catalog.lake")


def test_submitted_master_is_kept():
    import subprocess
    import sys
    code = ("from sluice.session import get_spark; s = get_spark(conf={'spark.driver.host': '127.0.0.1'}); print('MASTER', s.sparkContext.master); s.stop()")
    env = {**os.environ, "PYSPARK_SUBMIT_ARGS": "--master local[3] pyspark-shell"}
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=env, timeout=120, cwd=os.path.dirname(os.path.dirname(__file__)))
    assert "MASTER local[3]" in out.stdout


def test_decimals_widen(spark):
    from sluice.functions.types import is_widening
    rows = [("DECIMAL(10,2)", "DECIMAL(12,2)", True), ("DECIMAL(10,2)", "DECIMAL(10,4)", False), ("DECIMAL(10,2)", "DECIMAL(12,4)", True),
            ("DECIMAL(10,2)", "DECIMAL(9,2)", False), ("DECIMAL(10,2)", "DECIMAL(10,2)", False), ("INT", "BIGINT", True), ("BIGINT", "INT", False)]
    df = spark.createDataFrame(rows, "a string, b string, w boolean")
    assert df.where(is_widening("a", "b") != F.col("w")).count() == 0


def test_of_two_active_connections_one_counts(spark):
    from sluice.operators.config import connections_for
    objs = spark.createDataFrame([("o", "p", "erp")], "object_id string, pipeline_id string, source_system string")
    conns = spark.createDataFrame([("p", "erp", "old", True, dt.datetime(2020, 1, 1)), ("p", "erp", "new", True, dt.datetime(2021, 1, 1)),
                                   ("p", "erp", "off", False, dt.datetime(2022, 1, 1))],
                                  "pipeline_id string, source_system string, connection_name string, active_flag boolean, created_at timestamp")
    assert [r.connection_name for r in connections_for(objs, conns).collect()] == ["new"]


def test_unknown_outcome_is_no_success(spark):
    from sluice.operators.audit import run_rollup
    df = spark.createDataFrame([("r", "ok"), ("r", None)], "run string, outcome string")
    row = run_rollup(df, "run", F.col("outcome") == "error").first()
    assert (row.total_objects, row.success_objects, row.failed_objects, row.status) == (2, 1, 1, "PARTIAL")


#: Spark reads one Parquet footer per scanned table in a job of its own; no query scans more than four tables, but for one.
FOOTERS, TABLES = 4, {"rules_for_all_objects": 8}


def test_no_job_runs_while_a_query_is_built(spark):
    """Operators only plan."""
    import __spark_entry__ as entry
    from tests.conftest import SF001
    jobs = {}
    for name in sorted(set(entry.queries()) - set(entry.LLM_QUERIES)):
        spark.sparkContext.setJobGroup(f"build-{name}", name)
        entry.queries()[name](spark, SF001)
        jobs[name] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"build-{name}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {n: k for n, k in jobs.items() if k > TABLES.get(n, FOOTERS)} == {}
