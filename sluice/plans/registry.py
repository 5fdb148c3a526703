"""Registered queries: one per operator, each ``(spark, sf_dir) -> DataFrame``.

Every query reads whole tables from ``sf_dir`` (or data Spark derives from
them, see ``scenarios``).  Config rows (rules, metadata specs) are inline,
as they would be read from the control tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.hashing import record_hash, with_record_hash
from sluice.operators import audit, config, dq, drift, ingest, seed
from sluice.plans import scenarios as sc
from sluice.sources.objects import CLOUD_STORAGE, read_object

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def _t(spark, sf_dir, name):
    return sc.table(spark, sf_dir, name)


# ---- N1, N2: record hash --------------------------------------------------

@register("record_hash")
def record_hash_q(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return o.select("o_orderkey", record_hash(sc.ORDER_HASH_COLUMNS).alias("record_hash"))


@register("record_hash_all_columns")
def record_hash_all_columns(spark, sf_dir):
    return with_record_hash(_t(spark, sf_dir, "events"), None).select("event_id", "record_hash")


@register("record_hash_strict")
def record_hash_strict(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("5-LOW")))
    return o.select("o_orderkey", record_hash(sc.ORDER_HASH_COLUMNS, strict=True).alias("record_hash"))


# ---- N3-N6: classify, merge, soft delete, counts ----------------------------

@register("change_classify")
def change_classify(spark, sf_dir):
    return ingest.classify(sc.orders_source(spark, sf_dir), sc.orders_target(spark, sf_dir), ["o_orderkey"])


@register("merge_key_check")
def merge_key_check(spark, sf_dir):
    bad = ingest.bad_keys(_t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])
    return bad.select("l_orderkey", "l_linenumber", F.col("_n").alias("n"))


@register("merge_upsert")
def merge_upsert(spark, sf_dir):
    return ingest.merge_snapshot(sc.orders_source(spark, sf_dir), sc.orders_target(spark, sf_dir),
                                 ["o_orderkey"], update_unchanged=True)


@register("merge_keep_metadata")
def merge_keep_metadata(spark, sf_dir):
    src = sc.orders_with_run(sc.orders_source(spark, sf_dir), "run_2")
    tgt = sc.orders_with_run(sc.orders_target(spark, sf_dir), "run_1")
    return ingest.merge_snapshot(src, tgt, ["o_orderkey"]).select("o_orderkey", "o_totalprice", "load_run_id")


@register("merge_metrics")
def merge_metrics(spark, sf_dir):
    c = ingest.classify(sc.orders_source(spark, sf_dir), sc.orders_target(spark, sf_dir), ["o_orderkey"])
    return ingest.change_counts(c)


@register("soft_delete")
def soft_delete(spark, sf_dir):
    return ingest.soft_delete_flags(sc.orders_source(spark, sf_dir), sc.orders_target(spark, sf_dir), ["o_orderkey"])


@register("merge_soft_delete")
def merge_soft_delete(spark, sf_dir):
    src = sc.orders_with_run(sc.orders_source(spark, sf_dir), "run_2")
    tgt = sc.orders_with_run(sc.orders_target(spark, sf_dir), "run_1")
    m = ingest.merge_snapshot(src, tgt, ["o_orderkey"], soft_delete=True, change_col="change_type")
    return m.select("o_orderkey", "load_run_id", "is_deleted", "change_type")


@register("merge_dropped_column")
def merge_dropped_column(spark, sf_dir):
    """The source no longer has o_orderpriority: NULL on new and changed rows, kept on the others."""
    src = sc.orders_source(spark, sf_dir).drop("o_orderpriority")
    return ingest.merge_snapshot(src, sc.orders_target(spark, sf_dir), ["o_orderkey"]).select("o_orderkey", "o_orderpriority")


@register("soft_delete_counts")
def soft_delete_counts(spark, sf_dir):
    """Keys flagged by an earlier run are not deleted again: every third target row was flagged before."""
    tgt = sc.orders_target(spark, sf_dir).withColumn("is_deleted", F.col("o_custkey") % 3 == 0)
    m = ingest.merge_snapshot(sc.orders_source(spark, sf_dir), tgt, ["o_orderkey"], soft_delete=True, change_col="change_type")
    return m.groupBy("change_type", "is_deleted").agg(F.count(F.lit(1)).alias("n"))


# ---- N7-N12: watermarks, metadata, full load -------------------------------

@register("watermark_advance")
def watermark_advance(spark, sf_dir):
    e = _t(spark, sf_dir, "events").filter(F.col("event_type") != "error")
    w = ingest.next_watermarks(e, ["user_id"], "ts", "event_id")
    return w.withColumnRenamed("user_id", "object_id")


@register("incremental_extract")
def incremental_extract(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    wm = (e.filter((F.col("event_type") == "purchase") & (F.col("user_id") % 5 != 0))
          .groupBy("user_id").agg(F.max("ts").alias("watermark_value")))
    out = ingest.extract_since(e, "ts", watermarks=wm, object_keys=["user_id"])
    return out.select("event_id", "user_id", "ts")


@register("incremental_extract_single")
def incremental_extract_single(spark, sf_dir):
    import datetime as dt
    e = _t(spark, sf_dir, "events")
    return ingest.extract_since(e, "ts", watermark=dt.datetime(2024, 1, 15, 12, 0, 0)).select("event_id", "ts")


@register("incremental_extract_nulls")
def incremental_extract_nulls(spark, sf_dir):
    """Events without a time are loaded whatever the watermark is."""
    e = _t(spark, sf_dir, "events").withColumn("ts", F.when(F.col("event_type") != "error", F.col("ts")))
    wm = e.groupBy("user_id").agg(F.max("ts").alias("watermark_value"))
    out = ingest.extract_since(e, "ts", watermarks=wm, object_keys=["user_id"])
    return out.select("event_id", "user_id", "ts")


@register("watermark_hash")
def watermark_hash(spark, sf_dir):
    w = ingest.watermark_values(_t(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate")
    return w.withColumnRenamed("o_custkey", "object_id")


@register("metadata_inject")
def metadata_inject(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    specs = ingest.specs_for("hash_incremental", sc.DEFAULT_METADATA)
    out = ingest.inject_metadata(o, specs, sc.run_values("run_1", "orders"), sc.ORDER_HASH_COLUMNS)
    return out.select("o_orderkey", "record_hash", "ingestion_timestamp", "load_run_id", "source_system",
                      "source_object")


@register("full_load_snapshot")
def full_load_snapshot(spark, sf_dir):
    obj = {"source_type": CLOUD_STORAGE, "source_schema": sf_dir, "source_object": "customer.parquet"}
    df = read_object(spark, obj)
    specs = ingest.specs_for("full_load", sc.DEFAULT_METADATA)
    return ingest.inject_metadata(df, specs, sc.run_values("run_1", "customer"))


# ---- C1-C8: configuration --------------------------------------------------

@register("active_objects")
def active_objects(spark, sf_dir):
    return config.active_objects(sc.supplier_objects(spark, sf_dir)).select("pipeline_id", "object_id", "load_order")


@register("pipeline_config_pivot")
def pipeline_config_pivot(spark, sf_dir):
    return config.pipeline_settings(sc.event_settings(spark, sf_dir),
                                    {"click": "int", "purchase": "int", "error": "int"},
                                    order_cols=["ts", "event_id"])


@register("metadata_override")
def metadata_override(spark, sf_dir):
    cfg = sc.order_metadata_overrides(spark, sf_dir).unionByName(sc.default_metadata_rows(spark))
    pipes = _t(spark, sf_dir, "customer").select(
        F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("pipeline_id"))
    return config.effective_metadata(cfg, pipes, "full_load").select("pipeline_id", "column_name", "column_order")


@register("resolve_object_id")
def resolve_object_id(spark, sf_dir):
    lookup = _t(spark, sf_dir, "supplier").filter(F.col("s_nationkey") < 10)
    resolved, _ = config.resolve_ids(_t(spark, sf_dir, "lineitem"), lookup, {"l_suppkey": "s_suppkey"}, "s_suppkey")
    return resolved.select("l_orderkey", "l_linenumber", "l_partkey", "object_id")


@register("resolve_null_id")
def resolve_null_id(spark, sf_dir):
    """Lookup rows without an id resolve nothing."""
    lookup = _t(spark, sf_dir, "supplier").withColumn("id", F.when(F.col("s_acctbal") > 0, F.col("s_suppkey")))
    resolved, dropped = config.resolve_ids(_t(spark, sf_dir, "lineitem"), lookup, {"l_suppkey": "s_suppkey"}, "id")
    counted = [df.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")).withColumn("outcome", F.lit(name))
               for df, name in ((resolved, "resolved"), (dropped, "dropped"))]
    return counted[0].unionByName(counted[1])


@register("resolve_dropped")
def resolve_dropped(spark, sf_dir):
    lookup = _t(spark, sf_dir, "supplier").filter(F.col("s_nationkey") < 10)
    _, dropped = config.resolve_ids(_t(spark, sf_dir, "lineitem"), lookup, {"l_suppkey": "s_suppkey"}, "s_suppkey")
    return dropped.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("dropped"))


# Connection rows of the supplier pipelines (one inactive).
SUPPLIER_CONNECTIONS = [("p0", "erp", "erp_p0", True), ("p1", "erp", "erp_p1_old", False),
                        ("p1", "erp", "erp_p1", True), ("p2", "crm", "crm_p2", True), ("p3", "crm", "crm_p3", True)]


@register("connection_lookup")
def connection_lookup(spark, sf_dir):
    objs = sc.supplier_objects(spark, sf_dir).withColumn(
        "source_system", F.when(F.col("load_order") > 5, F.lit("crm")).otherwise(F.lit("erp")))
    conns = spark.createDataFrame(SUPPLIER_CONNECTIONS, "pipeline_id string, source_system string, "
                                                        "connection_name string, active_flag boolean")
    return config.connections_for(objs.drop("active_flag"), conns).select(
        "object_id", "pipeline_id", "source_system", "connection_name")


@register("expand_list_columns")
def expand_list_columns(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("object_id"),
                                         F.regexp_replace("p_name", " ", ", ").alias("hash_columns"))
    return config.expand_list_column(p, "hash_columns", ["object_id"])


# ---- I1-I8: seeding --------------------------------------------------------

def _seed_inputs(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return o.filter(F.col("o_orderkey") % 3 != 0), o.filter(F.col("o_orderkey") % 3 == 0)


@register("seed_insert_new")
def seed_insert_new(spark, sf_dir):
    batch, existing = _seed_inputs(spark, sf_dir)
    return seed.insert_if_absent(batch, existing, ["o_custkey", "o_orderpriority"], "o_orderkey")


@register("seed_outcome")
def seed_outcome(spark, sf_dir):
    batch, existing = _seed_inputs(spark, sf_dir)
    return seed.seed_outcome(batch, existing, ["o_custkey", "o_orderpriority"])


# ---- Q1-Q12: data quality --------------------------------------------------

_COUNTS = ["rows_checked", "rows_passed", "rows_failed"]


@register("dq_not_null")
def dq_not_null(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("5-LOW")))
    r = dq.Rule("priority_not_null", "NOT_NULL", column_name="o_orderpriority")
    return dq.evaluate_rules(o, [r]).select(*_COUNTS)


@register("dq_unique")
def dq_unique(spark, sf_dir):
    r = dq.Rule("line_unique", "UNIQUE", column_name="l_orderkey,l_linenumber")
    return dq.evaluate_rules(_t(spark, sf_dir, "lineitem"), [r]).select(*_COUNTS)


@register("dq_row_count")
def dq_row_count(spark, sf_dir):
    r = dq.Rule("min_rows", "ROW_COUNT", rule_expression="COUNT(*) > 0", expected_value="1")
    return dq.evaluate_rules(_t(spark, sf_dir, "orders"), [r]).select("rows_checked", "status")


@register("dq_value_range")
def dq_value_range(spark, sf_dir):
    r = dq.Rule("acctbal_positive", "RANGE", "c_acctbal > 0", "c_acctbal", "0", "WARN")
    return dq.evaluate_rules(_t(spark, sf_dir, "customer"), [r]).select(*_COUNTS, "pass_rate")


@register("dq_regex")
def dq_regex(spark, sf_dir):
    r = dq.Rule("priority_pattern", "REGEX", column_name="o_orderpriority", expected_value="^[1-3]-")
    return dq.evaluate_rules(_t(spark, sf_dir, "orders"), [r]).select("rows_checked", "rows_passed")


@register("dq_referential")
def dq_referential(spark, sf_dir):
    r = dq.Rule("doc_labelled", "REFERENTIAL", "labels.doc_id", "doc_id")
    return dq.evaluate_rules(_t(spark, sf_dir, "documents"), [r],
                             parents={"labels": _t(spark, sf_dir, "labels")}).select(*_COUNTS)


# The customer rule set used by the results and quarantine queries.
CUSTOMER_RULES = [
    dq.Rule("name_not_null", "NOT_NULL", column_name="c_name", severity="ERROR"),
    dq.Rule("acctbal_positive", "RANGE", "c_acctbal > 0", "c_acctbal", "0", "WARN"),
    dq.Rule("acctbal_range", "VALUE_RANGE", None, "c_acctbal", "-500|5000", "ERROR"),
    dq.Rule("min_rows", "ROW_COUNT", "COUNT(*) > 0", None, "1", "ERROR"),
]


@register("dq_results")
def dq_results(spark, sf_dir):
    res = dq.evaluate_rules(_t(spark, sf_dir, "customer"), CUSTOMER_RULES, failure_action="HALT")
    return res.select("rule_id", *_COUNTS, "pass_rate", "status", "action_taken")


@register("dq_gate")
def dq_gate(spark, sf_dir):
    res = dq.evaluate_rules(_t(spark, sf_dir, "customer"), CUSTOMER_RULES, failure_action="HALT")
    halted = F.count_if(F.col("action_taken") == dq.HALTED)
    return res.agg(halted.alias("halted_rules"), (halted == 0).alias("may_write"))


@register("dq_quarantine")
def dq_quarantine(spark, sf_dir):
    rules = [dq.Rule("acctbal_positive", "RANGE", "c_acctbal > 0", "c_acctbal", "0", "WARN"),
             dq.Rule("segment_allowed", "CUSTOM", "c_mktsegment <> 'BUILDING'", "c_mktsegment", None, "WARN")]
    _, rejected = dq.quarantine(_t(spark, sf_dir, "customer"), rules)
    return rejected.select("c_custkey", "failed_rules")


# A rule of every type on lineitem; the referential parent is the suppliers of nations below 20.
LINEITEM_RULES = [
    dq.Rule("r1_shipdate_present", "NOT_NULL", column_name="l_shipdate", severity="ERROR"),
    dq.Rule("r2_line_unique", "UNIQUE", column_name="l_orderkey,l_linenumber", severity="ERROR"),
    dq.Rule("r3_known_supplier", "REFERENTIAL", "supplier_main.s_suppkey", "l_suppkey", severity="WARN"),
    dq.Rule("r4_flag_pattern", "REGEX", column_name="l_returnflag", expected_value="^[AR]$", severity="WARN"),
    dq.Rule("r5_discount_range", "VALUE_RANGE", None, "l_discount", "0|0.08", severity="WARN"),
    dq.Rule("r6_min_rows", "ROW_COUNT", "COUNT(*) > 0", None, "1000", severity="ERROR"),
]


def _supplier_main(spark, sf_dir):
    return {"supplier_main": _t(spark, sf_dir, "supplier").filter(F.col("s_nationkey") < 20)}


@register("dq_results_all_types")
def dq_results_all_types(spark, sf_dir):
    res = dq.evaluate_rules(_t(spark, sf_dir, "lineitem"), LINEITEM_RULES, _supplier_main(spark, sf_dir))
    return res.select("rule_id", *_COUNTS, "pass_rate", "status", "action_taken")


@register("dq_quarantine_keys")
def dq_quarantine_keys(spark, sf_dir):
    rules = [dq.Rule("dup_line", "UNIQUE", column_name="l_orderkey,l_linenumber"),
             dq.Rule("known_supplier", "REFERENTIAL", "supplier_main.s_suppkey", "l_suppkey"),
             dq.Rule("qty_cap", "CUSTOM", "l_quantity <= 45")]
    _, rejected = dq.quarantine(_t(spark, sf_dir, "lineitem"), rules, _supplier_main(spark, sf_dir))
    return rejected.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "failed_rules")


@register("range_from_config")
def range_from_config(spark, sf_dir):
    rules = [dq.Rule("a", "VALUE_RANGE", None, "value", "0|100"), dq.Rule("b", "VALUE_RANGE", None, "value", "50|500")]
    return dq.evaluate_rules(_t(spark, sf_dir, "events"), rules).select("rule_id", "rows_checked", "rows_passed")


# ---- R1-R7: schema registry and drift ---------------------------------------

@register("drift_detect")
def drift_detect(spark, sf_dir):
    return drift.detect_drift(sc.part_registry(spark, sf_dir), sc.part_current(spark, sf_dir))


@register("drift_action")
def drift_action(spark, sf_dir):
    ev = drift.detect_drift(sc.part_registry(spark, sf_dir), sc.part_current(spark, sf_dir))
    return drift.drift_actions(ev, "EVOLVE").select("object_id", "column_name", "drift_type", "action_taken")


@register("drift_action_halt")
def drift_action_halt(spark, sf_dir):
    ev = drift.detect_drift(sc.part_registry(spark, sf_dir), sc.part_current(spark, sf_dir))
    return drift.drift_actions(ev, "HALT").select("object_id", "column_name", "drift_type", "action_taken")


@register("schema_reregister")
def schema_reregister(spark, sf_dir):
    out = drift.reregister(sc.part_registry(spark, sf_dir), sc.part_current(spark, sf_dir), sc.run_ts_literal())
    return out.select("object_id", "column_name", "data_type", "is_nullable", "column_order", "active_flag", "is_new")


@register("evolve_align")
def evolve_align(spark, sf_dir):
    evolved = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_orderdate", T.DateType()),
                            T.StructField("o_totalprice", T.DoubleType()),
                            T.StructField("o_shippriority", T.IntegerType()),
                            T.StructField("o_orderstatus", T.StringType())])
    return drift.align_to(_t(spark, sf_dir, "orders"), evolved)


@register("evolve_union")
def evolve_union(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    old = o.filter(F.col("o_orderkey") % 2 == 0).select("o_orderkey", "o_totalprice", "o_orderpriority")
    new = o.filter(F.col("o_orderkey") % 2 == 1).select("o_orderkey", "o_totalprice")
    return drift.evolve_union(old, new)


# ---- A1-A6: audit ----------------------------------------------------------

@register("run_status_rollup")
def run_status_rollup(spark, sf_dir):
    return audit.run_rollup(_t(spark, sf_dir, "events"), "user_id", F.col("event_type") == "error")


@register("run_lifecycle")
def run_lifecycle(spark, sf_dir):
    return audit.run_state(_t(spark, sf_dir, "events"), "user_id", "ts")


@register("run_latest_status")
def run_latest_status(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("started_by", F.col("props"))
    return audit.run_state(e, "user_id", "ts", status_col="event_type", identity_cols=["started_by"], tie_col="event_id")


@register("object_metrics")
def object_metrics(spark, sf_dir):
    return audit.object_metrics(_t(spark, sf_dir, "events"), {"run_id": "user_id", "object_id": "event_type"},
                                F.col("value") <= 0.05)


@register("error_log")
def error_log(spark, sf_dir):
    e = _t(spark, sf_dir, "events").filter(F.col("event_type") == "error") \
        .withColumn("_day", F.to_date("ts"))
    ranked = audit.error_attempts(e, ["user_id", "_day"], ["ts", "event_id"])
    return ranked.select(F.col("event_id").alias("error_id"), F.col("user_id").alias("run_id"),
                         audit.normalise_error_type(F.col("event_type")).alias("error_type"),
                         F.col("props").alias("error_message"), "retry_attempt", F.col("ts").alias("error_ts"))


@register("table_counts")
def table_counts(spark, sf_dir):
    return audit.table_counts({n: _t(spark, sf_dir, n) for n in ("orders", "lineitem", "events")})
