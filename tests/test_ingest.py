"""Hash, classify, merge, soft delete, watermarks, metadata."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sluice.functions.hashing import hash_columns_for, record_hash
from sluice.operators import ingest
from sluice.plans import scenarios as sc
from tests.conftest import SF01


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_classes_at_sf001(spark):
    c = ingest.classify(sc.orders_source(spark, SF01), sc.orders_target(spark, SF01), ["o_orderkey"])
    got = {r.change_type: r["count"] for r in c.groupBy("change_type").count().collect()}
    assert got == {"INSERT": 1500, "UPDATE": 1500, "ABSENT": 1500, "UNCHANGED": 10500}


def test_classify_plan_two_exchanges_no_python(spark):
    c = ingest.classify(sc.orders_source(spark, SF01), sc.orders_target(spark, SF01), ["o_orderkey"])
    plan = c._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "BatchEvalPython" not in plan
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = ingest.classify(sc.orders_source(spark, SF01), sc.orders_target(spark, SF01),
                               ["o_orderkey"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 2


def test_rerun_is_noop(spark):
    src = sc.orders_source(spark, SF01)
    first = ingest.merge_snapshot(src, sc.orders_target(spark, SF01), ["o_orderkey"])
    again = ingest.change_counts(ingest.classify(src, first, ["o_orderkey"])).first()
    assert again.rows_inserted == 0 and again.rows_updated == 0


def test_unchanged_rows_keep_metadata(spark):
    src = sc.orders_with_run(sc.orders_source(spark, SF01), "run_2")
    tgt = sc.orders_with_run(sc.orders_target(spark, SF01), "run_1")
    m = ingest.merge_snapshot(src, tgt, ["o_orderkey"], change_col="ct")
    got = {(r.ct, r.load_run_id): r["count"] for r in m.groupBy("ct", "load_run_id").count().collect()}
    assert got == {("INSERT", "run_2"): 1500, ("UPDATE", "run_2"): 1500,
                   ("UNCHANGED", "run_1"): 10500, ("ABSENT", "run_1"): 1500}


def test_null_collision_default_vs_strict(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    loose = [r[0] for r in df.select(record_hash(["x", "y", "z"])).collect()]
    strict = [r[0] for r in df.select(record_hash(["x", "y", "z"], strict=True)).collect()]
    assert loose[0] == loose[1]
    assert strict[0] != strict[1]


def test_hash_columns_null_means_all_but_metadata(spark):
    df = spark.createDataFrame([(1, "a", "r1")], "k int, v string, load_run_id string")
    assert hash_columns_for(df, None, exclude=["load_run_id"]) == ["k", "v"]
    assert hash_columns_for(df, " v , k ") == ["v", "k"]
    with pytest.raises(ValueError):
        hash_columns_for(df, "nope")


def test_duplicate_or_null_key_is_merge_error(spark):
    dup = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ingest.MergeKeyError):
        ingest.assert_unique_keys(dup, ["k"])
    nul = spark.createDataFrame([(None, "a"), (2, "b")], "k int, v string")
    with pytest.raises(ingest.MergeKeyError):
        ingest.assert_unique_keys(nul, ["k"])
    ingest.assert_unique_keys(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), ["k"])


def test_metadata_name_clash_is_error(spark):
    df = spark.createDataFrame([(1, "x")], "k int, load_run_id string")
    with pytest.raises(ValueError):
        ingest.inject_metadata(df, [ingest.MetadataSpec("load_run_id", "load_run_id", 1)], {"load_run_id": "r"})


def test_metadata_order_and_tokens(spark):
    df = spark.createDataFrame([(1, "x")], "k int, v string")
    specs = [ingest.MetadataSpec("b", "source_object", 2), ingest.MetadataSpec("a", "upper(v)", 1),
             ingest.MetadataSpec("h", "sha2(concat_ws('|', hash_columns), 256)", 3)]
    out = ingest.inject_metadata(df, specs, {"source_object": "obj"}, ["k", "v"])
    assert out.columns == ["k", "v", "a", "b", "h"]
    r = out.first()
    assert (r.a, r.b) == ("X", "obj")
    import hashlib
    assert r.h == hashlib.sha256(b"1|x").hexdigest()


def test_single_watermark_pushes_to_scan(spark):
    e = spark.read.parquet(f"{SF01}/events.parquet")
    q = ingest.extract_since(e, "ts", watermark=dt.datetime(2024, 1, 15))
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(GreaterThanOrEqual(ts," in plan and "IsNull(ts))" in plan
    assert ingest.extract_since(e, "ts").count() == e.count()


def test_soft_delete_flags(spark):
    f = ingest.soft_delete_flags(sc.orders_source(spark, SF01), sc.orders_target(spark, SF01), ["o_orderkey"])
    assert f.filter("is_deleted").count() == 1500


def test_merge_adds_new_source_columns(spark):
    tgt = spark.createDataFrame([(1, "a", "h1")], "k int, v string, record_hash string")
    src = spark.createDataFrame([(1, "b", "h2", 5), (2, "c", "h3", 6)],
                                "k int, v string, record_hash string, extra int")
    out = {r.k: r for r in ingest.merge_snapshot(src, tgt, ["k"]).collect()}
    assert out[1].v == "b" and out[1].extra == 5 and out[2].extra == 6


def test_key_check_reads_key_columns_only(spark):
    o = spark.read.parquet(f"{SF01}/orders.parquet")
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(
        ingest.bad_keys(o, ["o_orderkey"])._jdf.queryExecution(), "formatted")
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan
    assert ingest.bad_keys(o, ["o_orderkey"]).count() == 0
