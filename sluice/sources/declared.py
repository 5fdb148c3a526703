"""Text records read by a declared schema, with a channel for those that do not fit.

``from_csv`` and ``from_json`` parse permissively: a record that cannot be parsed, or a field that has not its type, does not stop the read.
Good records get the declared types.  Bad ones come out whole, in the shape of the rejected rows of a data-quality check, with a reason.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.types import type_name
from sluice.sources.objects import read_files


def schema_from_registry(rows: list[Mapping]) -> T.StructType:
    """A declared schema from an object's active registry rows (column_name, data_type, is_nullable, column_order)."""
    ordered = sorted(rows, key=lambda r: (r["column_order"], r["column_name"]))
    return T.StructType([T.StructField(r["column_name"], T._parse_datatype_string(r["data_type"]), bool(r["is_nullable"])) for r in ordered])


def read_registered_files(spark: SparkSession, path: str, fmt: str, schema: T.StructType,
                          options: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame] | None:
    """(good rows, records that do not fit) of CSV or JSON files by their registered schema: no pass for inference, the same types every time.

    Records that do not fit have the columns as far as they parsed, and the whole record as ``record``.  None for CSV files whose header has other
    columns than the schema: those have drifted, and must be read as they are.
    """
    record = "record"
    while record in schema.names:
        record = f"_{record}"
    fields = {f.name.lower(): T.StructField(f.name, f.dataType) for f in schema.fields}
    names = list(fields)
    if fmt == "csv":
        header = spark.read.options(**(options or {})).option("header", "true").csv(path).columns  # the first line alone
        names = [c.lower() for c in header]
        if set(names) != set(fields):
            return None
    whole = T.StructType([*(fields[n] for n in names), T.StructField(record, T.StringType())])
    opts = {**(options or {}), "mode": "PERMISSIVE", "columnNameOfCorruptRecord": record}
    df = read_files(spark, path, fmt, whole, opts)
    return df.where(F.col(record).isNull()).drop(record), df.where(F.col(record).isNotNull())


def _fields(text: Column, fmt: str, schema: T.StructType, options: Mapping[str, str]) -> Column:
    """Each declared field's text, by name."""
    if fmt == "json":
        return F.from_json(text, "map<string,string>", dict(options))
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    parsed = F.from_csv(text, raw.simpleString()[len("struct<"):-1].replace(":", " "), dict(options))
    return F.map_from_arrays(F.array(*[F.lit(f.name) for f in schema.fields]), F.array(*[parsed[f.name] for f in schema.fields]))


def read_declared(df: DataFrame, text_col: str, schema: T.StructType, fmt: str = "csv", options: Mapping[str, str] | None = None,
                  reason_col: str = "failed_rules") -> tuple[DataFrame, DataFrame]:
    """(good, rejected) of the records in ``text_col``; other columns are passed on.

    Good records have the declared columns, in their types, instead of the text.  Rejected ones keep the text and ``reason_col``, a comma list: ``malformed``
    for a record that is no such CSV line or JSON object or has another number of fields, ``<column>:<TYPE>`` for a field that has not its
    type, ``<column>:NULL`` for a required one without value.  Empty text counts as no value; a NULL record is malformed.
    """
    fmt = fmt.lower()
    if fmt not in ("csv", "json"):
        raise ValueError(f"records are csv or json, not {fmt!r}")
    options = {"mode": "PERMISSIVE", **(options or {})}
    text, bad = F.col(f"`{text_col}`"), "_corrupt_record"
    while bad in schema.names:
        bad = f"_{bad}"
    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])
    whole = T.StructType([*nullable.fields, T.StructField(bad, T.StringType())])
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.fields)
    parse = F.from_csv if fmt == "csv" else F.from_json
    typed = parse(text, ddl, {**options, "columnNameOfCorruptRecord": bad})
    # Exploding one parsed record keeps the optimizer from parsing it again for every field that is asked for.
    work = df.select("*", F.explode(F.array(F.struct(typed.alias("typed"), _fields(text, fmt, schema, options).alias("raw")))).alias("__record"))
    typed, fields = F.col("__record.typed"), F.col("__record.raw")
    raw = {f.name: F.nullif(fields[f.name], F.lit("")) for f in schema.fields}
    wrong = [F.when(raw[f.name].isNotNull() & typed[f.name].isNull(), F.lit(f"{f.name}:{type_name(f.dataType)}")) for f in schema.fields]
    lacking = [F.when(raw[f.name].isNull(), F.lit(f"{f.name}:NULL")) for f in schema.fields if not f.nullable]
    shapeless = fields.isNull() | typed.isNull()
    named = F.concat_ws(",", *wrong, *lacking)
    # A record that the parser keeps as corrupt although each field has its type is malformed as a whole.
    reasons = F.when(shapeless, F.lit("malformed")).when(named != "", named).when(typed[bad].isNotNull(), F.lit("malformed")).otherwise(F.lit(""))
    work = work.withColumn("__reason", reasons)
    others = [F.col(f"`{c}`") for c in df.columns if c != text_col]
    good = work.where("__reason = ''").select(*others, *[typed[f.name].alias(f.name) for f in schema.fields])
    rejected = work.where("__reason != ''").select(*others, text, F.col("__reason").alias(reason_col))
    return good, rejected
