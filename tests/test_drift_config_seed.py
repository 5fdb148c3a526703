"""Drift, configuration resolution, seeding operators, ranking."""

import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.ranking import sequence_within_groups
from sluice.operators import config, drift, seed
from sluice.sources.documents import ConfigDocumentError, load_config_document
from tests.conftest import FIXTURES


def test_two_events_on_one_column(spark):
    reg = spark.createDataFrame([("o", "a", "INT", False), ("o", "gone", "STRING", True)],
                                "object_id string, column_name string, data_type string, is_nullable boolean")
    cur = drift.describe_schema(spark, T.StructType([T.StructField("a", T.LongType(), True),
                                                     T.StructField("new", T.StringType(), True)]), "o", "p")
    ev = {(r.column_name, r.drift_type): r for r in drift.detect_drift(reg, cur).collect()}
    assert set(ev) == {("a", "TYPE_CHANGE"), ("a", "NULLABLE_CHANGE"), ("gone", "DROPPED_COLUMN"),
                       ("new", "NEW_COLUMN")}
    assert (ev[("a", "NULLABLE_CHANGE")].old_value, ev[("a", "NULLABLE_CHANGE")].new_value) == ("false", "true")
    acts = {(r.column_name, r.drift_type): r.action_taken
            for r in drift.drift_actions(drift.detect_drift(reg, cur), "EVOLVE", ignore=["gone"]).collect()}
    assert acts[("a", "TYPE_CHANGE")] == "EVOLVED"  # INT -> BIGINT widens
    assert acts[("a", "NULLABLE_CHANGE")] == "WARNED"
    assert acts[("gone", "DROPPED_COLUMN")] == "IGNORED"


def test_align_and_evolve_union(spark):
    old = spark.createDataFrame([(1, "x")], "a int, b string")
    new = spark.createDataFrame([(2, 5.0)], "a bigint, c double")
    u = drift.evolve_union(old, new)
    assert u.columns == ["a", "b", "c"] and dict(u.dtypes)["a"] == "bigint"
    sch = T.StructType([T.StructField("c", T.DoubleType()), T.StructField("a", T.LongType())])
    assert drift.align_to(old, sch).columns == ["c", "a"]


def test_override_by_inactive_row_suppresses_default(spark):
    cfg = spark.createDataFrame(
        [("default", "ts", "all", 1, True), ("default", "h", "hash_incremental", 2, True),
         ("p1", "ts", "all", 1, False), ("p1", "extra", "all", 3, True)],
        "pipeline_id string, column_name string, applies_to string, column_order int, active_flag boolean")
    pipes = spark.createDataFrame([("p1",), ("p2",)], "pipeline_id string")
    got = {(r.pipeline_id, r.column_name) for r in config.effective_metadata(cfg, pipes, "full_load").collect()}
    assert got == {("p1", "extra"), ("p2", "ts")}


def test_override_of_inherited_defaults(spark):
    cfg = spark.createDataFrame(
        [("default", f"c{i}", "all", i, True) for i in range(5)] + [("p1", "c1", "all", 9, True)],
        "pipeline_id string, column_name string, applies_to string, column_order int, active_flag boolean")
    pipes = spark.createDataFrame([("p1",), ("p2",)], "pipeline_id string")
    got = {(r.pipeline_id, r.column_name): r.column_order for r in config.effective_metadata(cfg, pipes).collect()}
    assert got == {**{(p, f"c{i}"): i for p in ("p1", "p2") for i in range(5)}, ("p1", "c1"): 9}
    assert config.effective_metadata(cfg.where("pipeline_id = 'p1'"), pipes).count() == 1  # no defaults at all


def test_settings_pivot_try_cast(spark):
    cfg = spark.createDataFrame([("p", "max_retry", "3", True), ("p", "batch_size", "x", True),
                                 ("p", "old", "1", False), ("q", "max_retry", "five", True)],
                                "pipeline_id string, config_key string, config_value string, active_flag boolean")
    got = {r.pipeline_id: r for r in config.pipeline_settings(cfg, {"max_retry": "int", "batch_size": "int"}).collect()}
    assert (got["p"].max_retry, got["p"].batch_size, got["q"].max_retry) == (3, None, None)


def test_resolve_ids_first_wins_and_dropped(spark):
    rows = spark.createDataFrame([("p", "a", 1), ("p", "b", 2)], "pipeline_id string, source_object string, n int")
    lookup = spark.createDataFrame([("p", "a", "id2", 2), ("p", "a", "id1", 1)],
                                   "pipeline_id string, source_object string, object_id string, created_at int")
    res, dropped = config.resolve_ids(rows, lookup, {"pipeline_id": "pipeline_id", "source_object": "source_object"},
                                      "object_id", order_cols=["created_at"])
    assert [(r.source_object, r.object_id) for r in res.collect()] == [("a", "id1")]
    assert [r.source_object for r in dropped.collect()] == ["b"]


def test_first_row_wins_and_outcome(spark):
    batch = spark.createDataFrame([(3, "k1", "late"), (1, "k1", "first"), (2, "k2", "x"), (4, None, "nul")],
                                  "pos int, key string, v string")
    existing = spark.createDataFrame([("k2",)], "key string")
    ins = seed.insert_if_absent(batch, existing, ["key"], "pos").collect()
    assert [(r.key, r.v) for r in ins] == [("k1", "first")]
    out = {r.outcome: r.n for r in seed.seed_outcome(batch, existing, ["key"]).collect()}
    assert out == {"inserted": 1, "skipped": 2, "failed": 1}


def test_config_document_sections(spark, tmp_path):
    doc = load_config_document(spark, os.path.join(FIXTURES, "seed_document.json"))
    assert {k: v.count() for k, v in doc.items()} == {
        "source_object_config": 1, "pipeline_config": 8, "metadata_column_config": 5,
        "connection_config": 1, "dq_rule_config": 5}
    bad = tmp_path / "bad.json"
    bad.write_text('{"source_object_config": [], "pipeline_config": []}')
    with pytest.raises(ConfigDocumentError, match="connection_config, dq_rule_config, metadata_column_config"):
        load_config_document(spark, str(bad))
    worse = tmp_path / "worse.json"
    worse.write_text('{"source_object_config": [], "pipeline_config": {"a": 1}, "metadata_column_config": [],'
                     ' "connection_config": [], "dq_rule_config": []}')
    with pytest.raises(ConfigDocumentError, match="pipeline_config"):
        load_config_document(spark, str(worse))


def test_sequence_matches_row_number_on_hot_group(spark):
    # one group holds a third of the rows
    df = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 97).alias("g"),
        ((F.col("id") * 7919) % 3001).alias("o"), F.col("id").alias("u"))
    got = sequence_within_groups(df, ["g"], ["o", "u"])
    want = df.withColumn("seq", F.row_number().over(Window.partitionBy("g").orderBy("o", "u")))
    assert sorted(map(tuple, got.select("u", "seq").collect())) == sorted(map(tuple, want.select("u", "seq").collect()))
    # the hot group is spread over several sorted partitions, not held by one task
    # (AQE would merge this tiny input into one partition; real sizes are split by the advisory size)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = df.orderBy("g", "o", "u").withColumn("p", F.spark_partition_id()).filter("g = 0") \
            .select("p").distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert spread > 1


def test_resolve_ids_same_result_broadcast_or_shuffled(spark):
    rows = spark.createDataFrame([("p", "a", 1), ("p", "b", 2), ("p", None, 3), ("q", "a", 4)] +
                                 [("p", "a", 10 + i) for i in range(30)],
                                 "pipeline_id string, source_object string, n int")
    lookup = spark.createDataFrame([("p", "a", "id2", 2), ("p", "a", "id1", 1), ("q", "a", "id9", 1),
                                    ("p", None, "idn", 1)],
                                   "pipeline_id string, source_object string, object_id string, created_at int")
    on = {"pipeline_id": "pipeline_id", "source_object": "source_object"}

    def run():
        res, dropped = config.resolve_ids(rows, lookup, on, "object_id", order_cols=["created_at"])
        return sorted(map(tuple, res.select("n", "object_id").collect())), sorted(r.n for r in dropped.collect())
    small = run()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert run() == small
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert small[1] == [2, 3]
