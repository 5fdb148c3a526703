"""Catalog listing: which control tables exist."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_presence(spark: SparkSession, database: str, expected: Iterable[str]) -> DataFrame:
    """Each expected table name with ``present`` true/false."""
    have = [t.name for t in spark.catalog.listTables(database)]
    got = spark.createDataFrame([(n,) for n in have], "table_name string").withColumn("_hit", F.lit(True))
    want = spark.createDataFrame([(n,) for n in expected], "table_name string")
    return want.join(got, "table_name", "left").select(
        "table_name", F.coalesce(F.col("_hit"), F.lit(False)).alias("present"))
