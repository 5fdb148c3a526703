"""Inputs the registered queries derive from the given tables.

Every registered query reads whole tables.  Where an operator needs two
versions of one object (old target and new source, registry and current
schema, existing and incoming seed rows), both versions are derived from
the same table by a rule on its key or its values.  Each version still
covers most of the table, and nothing is sampled or capped.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.hashing import record_hash
from sluice.operators.ingest import MetadataSpec
from sluice.operators.seed import first_per_key

# Columns hashed for the orders object.
ORDER_HASH_COLUMNS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]

# Fixed value: the single run timestamp the registered queries pass through a run.
RUN_TS = dt.datetime(2024, 2, 1, 0, 0, 0)

# The shared metadata columns of the seed document.
DEFAULT_METADATA = [
    MetadataSpec("record_hash", "sha2(concat_ws('|', hash_columns), 256)", 1, "STRING", "hash_incremental"),
    MetadataSpec("ingestion_timestamp", "current_timestamp()", 2, "TIMESTAMP", "all"),
    MetadataSpec("load_run_id", "load_run_id", 3, "STRING", "all"),
    MetadataSpec("source_system", "source_system", 4, "STRING", "all"),
    MetadataSpec("source_object", "source_object", 5, "STRING", "all"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_ts_literal():
    # from text: no dependence on the Python process's time zone
    return F.lit(RUN_TS.isoformat(sep=" ")).cast("timestamp_ntz")


def run_values(run_id: str, source_object: str, source_system: str = "tpch") -> dict:
    return {"load_run_id": run_id, "source_system": source_system,
            "source_object": source_object, "run_ts": run_ts_literal()}


def orders_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old target: every order except keys ending in 0, hashed."""
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 10 != 0)
    return o.withColumn("record_hash", record_hash(ORDER_HASH_COLUMNS))


def orders_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New source: keys ending in 1 are gone, keys ending in 0 are new,
    keys ending in 2 have a new price; hashed the same way."""
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 10 != 1)
    o = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 10 == 2, F.col("o_totalprice") + 1)
                     .otherwise(F.col("o_totalprice")))
    return o.withColumn("record_hash", record_hash(ORDER_HASH_COLUMNS))


def orders_with_run(df: DataFrame, run_id: str) -> DataFrame:
    return df.withColumn("load_run_id", F.lit(run_id))


# Registry type given to each part type, and the type a drifted column moves to.
PART_COLUMN_TYPE = {"ECONOMY": "INT", "LARGE": "STRING", "MEDIUM": "DATE", "PROMO": "BIGINT",
                    "SMALL": "FLOAT", "STANDARD": "INT"}
DRIFTED_TYPE = {"INT": "BIGINT", "FLOAT": "DOUBLE", "STRING": "INT", "DATE": "TIMESTAMP", "BIGINT": "STRING"}


def _lookup(mapping: dict, col):
    return F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), col)


def part_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored registry: every part is a column of the object named by its brand.
    Columns of size above 45 are not registered yet (they arrive as new)."""
    p = table(spark, sf_dir, "part").filter(F.col("p_size") <= 45)
    return p.select(F.col("p_brand").alias("object_id"),
                    F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("column_name"),
                    _lookup(PART_COLUMN_TYPE, F.col("p_type")).alias("data_type"),
                    (F.col("p_size") < 25).alias("is_nullable"),
                    F.col("p_size").alias("column_order"))


def part_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current schema: columns of size below 5 are gone, bolts changed type,
    sizes 25 to 29 became nullable."""
    p = table(spark, sf_dir, "part").filter(F.col("p_size") >= 5)
    base = _lookup(PART_COLUMN_TYPE, F.col("p_type"))
    drifted = F.when(F.col("p_name").like("%bolt%"), _lookup(DRIFTED_TYPE, base)).otherwise(base)
    return p.select(F.col("p_brand").alias("object_id"),
                    F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("column_name"),
                    drifted.alias("data_type"),
                    (F.col("p_size") < 30).alias("is_nullable"),
                    F.col("p_size").alias("column_order"))


def order_metadata_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipeline-specific metadata rows, one per order, pipeline = its customer;
    the first order of a (pipeline, column) is the row that counts."""
    o = table(spark, sf_dir, "orders")
    prio = F.col("o_orderpriority")
    rows = o.select(
        F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("pipeline_id"),
        F.when(prio == "1-URGENT", F.lit("source_system")).when(prio == "2-HIGH", F.lit("load_run_id"))
        .otherwise(F.concat(F.lit("batch_"), F.substring(prio, 1, 1))).alias("column_name"),
        F.when(F.col("o_orderstatus") == "F", F.lit("hash_incremental")).otherwise(F.lit("all")).alias("applies_to"),
        (F.substring(prio, 1, 1).cast("int") + 5).alias("column_order"),
        (F.col("o_orderstatus") != "P").alias("active_flag"),
        F.col("o_orderkey"))
    return first_per_key(rows, ["pipeline_id", "column_name"], "o_orderkey").drop("o_orderkey")


def default_metadata_rows(spark: SparkSession) -> DataFrame:
    rows = [("default", s.column_name, s.applies_to, s.column_order, True) for s in DEFAULT_METADATA]
    return spark.createDataFrame(
        rows, "pipeline_id string, column_name string, applies_to string, column_order int, active_flag boolean")


def event_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key-value settings history: each event sets key ``event_type`` of pipeline
    ``u<user>``; low-value events are inactive; error events carry a non-number."""
    e = table(spark, sf_dir, "events")
    value = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.get_json_object("props", "$.k"))
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("pipeline_id"),
                    F.col("event_type").alias("config_key"), value.alias("config_value"),
                    (F.col("value") >= 1.0).alias("active_flag"), "ts", "event_id")


def supplier_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source-object config: one object per supplier, pipeline per nation,
    active when the balance is positive, load order by balance band."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("object_id"),
                    F.concat(F.lit("p"), F.col("s_nationkey").cast("string")).alias("pipeline_id"),
                    (F.col("s_acctbal") > 0).alias("active_flag"),
                    (F.floor(F.col("s_acctbal") / 1000).cast("int") + 1).alias("load_order"))
