"""The seed document (one JSON object of named arrays) and test fixtures."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.schemas import NATURAL_KEYS, schema_of


class ConfigDocumentError(ValueError):
    pass


def load_config_document(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Read the document once; return one DataFrame per required section.

    Every required section must be present and every section must be an
    array; sections beyond the required ones are ignored.  Each row carries
    ``_pos``, its position in the file, which decides "first row wins".
    Fields are cast to the control table's types; fields the document does
    not give are NULL (the seeder fills ids and timestamps).
    """
    doc = spark.read.option("multiLine", "true").json(path)
    if "_corrupt_record" in doc.columns:
        raise ConfigDocumentError(f"{path} cannot be parsed as JSON")
    fields = {f.name: f.dataType for f in doc.schema.fields}
    missing = sorted(set(NATURAL_KEYS) - set(fields))
    if missing:
        raise ConfigDocumentError(f"{path} has no section for: {', '.join(missing)}")
    for name, dtype in fields.items():
        if not isinstance(dtype, T.ArrayType):
            raise ConfigDocumentError(f"{path}: the rows of {name} are not given as a list")
    out = {}
    for table in NATURAL_KEYS:
        elem = fields[table].elementType
        have = set(elem.fieldNames()) if isinstance(elem, T.StructType) else set()
        rows = doc.select(F.posexplode(F.col(table)).alias("_pos", "_r"))
        cols = [F.col("_pos").cast("int").alias("_pos")]
        for f in schema_of(table).fields:
            src = F.col(f"_r.{f.name}") if f.name in have else F.lit(None)
            cols.append(src.cast(f.dataType).alias(f.name))
        if "source_object" in have and table == "dq_rule_config":
            cols.append(F.col("_r.source_object").cast("string").alias("source_object"))
        out[table] = rows.select(*cols)
    return out


def load_fixture(spark: SparkSession, path: str) -> DataFrame:
    """JSON fixtures with inferred types, CSV fixtures with every value as text."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix == ".json":
        return spark.read.option("multiLine", "true").json(path)
    if suffix == ".csv":
        return spark.read.option("header", "true").csv(path)
    raise ValueError(f"{suffix or 'no suffix'}: fixtures are .json or .csv files")
