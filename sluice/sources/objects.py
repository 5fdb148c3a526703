"""Read a configured source object: native table, files, or JDBC."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sluice.sources.jdbc import jdbc_options

# The source_type vocabulary.
NATIVE, JDBC, CLOUD_STORAGE = "databricks_native", "jdbc", "cloud_storage"
FILE_FORMATS = ("parquet", "csv", "json", "orc")


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table by name (``db.table`` or ``spark_catalog.db.table``)."""
    return spark.read.table(name)


def read_files(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None,
               options: Mapping[str, str] | None = None) -> DataFrame:
    """Files at a path.  Give ``schema`` for CSV/JSON in production: inference
    costs a pass over the data and guesses types per batch."""
    fmt = fmt.lower()
    if fmt not in FILE_FORMATS:
        raise ValueError(f"unsupported file format {fmt!r}")
    r = spark.read.format(fmt)
    if fmt == "csv":
        r = r.option("header", "true")
    for k, v in (options or {}).items():
        r = r.option(k, v)
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)


def _format_of(path: str, default: str) -> str:
    for f in FILE_FORMATS:
        if path.lower().endswith("." + f):
            return f
    return default


def read_object(spark: SparkSession, obj: Mapping, connection: Mapping | None = None,
                secret: Callable[[str, str], str] | None = None, fmt: str = "parquet",
                schema: T.StructType | str | None = None, fetchsize: int | None = None,
                partitioning: Mapping | None = None) -> DataFrame:
    """Dispatch on ``source_type``.

    - native: ``source_schema.source_object`` from the catalog (the compound
      name is joined, never quoted whole);
    - cloud_storage: files at ``source_schema/source_object``;
    - jdbc: the connection row's options, credentials resolved by ``secret``,
      ``fetchsize`` from the pipeline's batch size, partitioned reads when
      ``partitioning`` gives column and bounds.
    """
    stype = str(obj["source_type"]).strip().lower()
    schema_name, object_name = obj["source_schema"], obj["source_object"]
    if stype == NATIVE:
        return read_table(spark, f"{schema_name}.{object_name}")
    if stype == CLOUD_STORAGE:
        path = f"{str(schema_name).rstrip('/')}/{object_name}"
        return read_files(spark, path, _format_of(path, fmt), schema)
    if stype == JDBC:
        if connection is None:
            raise ValueError(f"jdbc object {object_name} has no active connection")
        opts = jdbc_options(connection, f"{schema_name}.{object_name}", secret=secret,
                            fetchsize=fetchsize, partitioning=partitioning)
        return spark.read.format("jdbc").options(**opts).load()
    raise ValueError(f"unknown source_type {obj['source_type']!r}")
