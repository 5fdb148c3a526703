"""Schema registry, drift detection, drift action, evolution.

A registry holds one row per (object, column).  Detection and re-registration
are full-outer joins on ``(object_id, column_name)`` between the stored
registry and the current schema rows, so thousands of objects are compared in
one job rather than one query per object.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.types import is_widening, type_name

NEW, DROPPED, TYPE_CHANGE, NULLABLE_CHANGE = "NEW_COLUMN", "DROPPED_COLUMN", "TYPE_CHANGE", "NULLABLE_CHANGE"
EVOLVED, HALTED, WARNED, IGNORED = "EVOLVED", "HALTED", "WARNED", "IGNORED"

KEYS = ["object_id", "column_name"]


def describe_schema(spark: SparkSession, schema: T.StructType, object_id: str, pipeline_id: str,
                    primary_key: Iterable[str] = ()) -> DataFrame:
    """Registry rows for one schema: type name, nullability, key flag, 1-based position."""
    pk = {k.lower() for k in primary_key}
    rows = [(object_id, pipeline_id, f.name, type_name(f.dataType), f.nullable, f.name.lower() in pk, i + 1)
            for i, f in enumerate(schema.fields)]
    ddl = ("object_id string, pipeline_id string, column_name string, data_type string, "
           "is_nullable boolean, is_primary_key boolean, column_order int")
    return spark.createDataFrame(rows, ddl)


def _join(reg: DataFrame, cur: DataFrame, keys: Sequence[str]) -> DataFrame:
    r = reg.select(*keys, *[F.col(c).alias(f"r_{c}") for c in reg.columns if c not in keys],
                   F.lit(1).alias("_r_seen"))
    c = cur.select(*keys, *[F.col(x).alias(f"c_{x}") for x in cur.columns if x not in keys],
                   F.lit(1).alias("_c_seen"))
    return r.join(c, list(keys), "full_outer")


def detect_drift(reg: DataFrame, cur: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Drift events: NEW_COLUMN, DROPPED_COLUMN, TYPE_CHANGE, NULLABLE_CHANGE.

    ``reg`` is the active registry, ``cur`` the current schema rows; both have
    ``data_type`` and ``is_nullable``.  One column may give a type and a
    nullability event at once.  old/new value: NULL old for a new column,
    NULL new for a dropped one; nullability as ``true``/``false`` text.
    """
    j = _join(reg.select(*keys, "data_type", "is_nullable"), cur.select(*keys, "data_type", "is_nullable"), keys)
    r_in, c_in = F.col("_r_seen").isNotNull(), F.col("_c_seen").isNotNull()
    both = r_in & c_in
    null_s = F.lit(None).cast("string")

    def ev(hit: Column, kind: str, old: Column, new: Column) -> Column:
        return F.struct(hit.alias("hit"), F.lit(kind).alias("drift_type"),
                        old.cast("string").alias("old_value"), new.cast("string").alias("new_value"))

    events = F.array(
        ev(~r_in, NEW, null_s, F.col("c_data_type")),
        ev(~c_in, DROPPED, F.col("r_data_type"), null_s),
        ev(both & (F.col("r_data_type") != F.col("c_data_type")), TYPE_CHANGE,
           F.col("r_data_type"), F.col("c_data_type")),
        ev(both & (F.col("r_is_nullable") != F.col("c_is_nullable")), NULLABLE_CHANGE,
           F.col("r_is_nullable"), F.col("c_is_nullable")),
    )
    hits = F.filter(events, lambda e: F.coalesce(e["hit"], F.lit(False)))
    return j.select(*keys, F.inline(hits)).drop("hit")


def drift_actions(events: DataFrame, setting: str | Column, ignore: Iterable[str] = ()) -> DataFrame:
    """Action per event from the ``schema_drift_action`` setting.

    HALT: every event HALTED.  EVOLVE: new and dropped columns EVOLVED (a
    dropped column stays, NULL from then on), widening type changes EVOLVED,
    other type changes HALTED, nullability changes WARNED.  Columns in
    ``ignore`` are IGNORED.  ``setting`` may be a column (per-object setting).
    """
    s = F.upper(setting if isinstance(setting, Column) else F.lit(setting))
    ignore = [c for c in ignore]
    kind = F.col("drift_type")
    action = (F.when(F.col("column_name").isin(ignore) if ignore else F.lit(False), F.lit(IGNORED))
              .when(s == "HALT", F.lit(HALTED))
              .when(kind == NULLABLE_CHANGE, F.lit(WARNED))
              .when((kind == TYPE_CHANGE) & ~is_widening("old_value", "new_value"), F.lit(HALTED))
              .otherwise(F.lit(EVOLVED)))
    return events.withColumn("action_taken", action)


def reregister(reg: DataFrame, cur: DataFrame, run_ts, keys: Sequence[str] = KEYS) -> DataFrame:
    """The registry after this run: current columns active with their current
    definition; first ``registered_at`` kept; ``updated_at`` refreshed;
    columns no longer in the source kept with ``active_flag`` false.
    """
    value_cols = [c for c in cur.columns if c not in keys]
    j = _join(reg, cur, keys)
    c_in = F.col("_c_seen").isNotNull()
    ts = run_ts if isinstance(run_ts, Column) else F.lit(run_ts)
    out = [*keys]
    for c in value_cols:
        r_name = f"r_{c}"
        if r_name in j.columns:
            out.append(F.when(c_in, F.col(f"c_{c}")).otherwise(F.col(r_name)).alias(c))
        else:
            out.append(F.col(f"c_{c}").alias(c))
    if "r_registered_at" in j.columns:
        out.append(F.coalesce(F.col("r_registered_at"), ts).alias("registered_at"))
    else:
        out.append(F.when(F.col("_r_seen").isNull(), ts).alias("registered_at"))
    out += [ts.alias("updated_at"), c_in.alias("active_flag"), F.col("_r_seen").isNull().alias("is_new")]
    return j.select(*out)


def align_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Rewrite ``df`` to ``schema``: same order, types cast, missing columns NULL.

    This is the evolution path for Parquet targets, where ``ALTER TABLE``
    cannot change a type or drop a column.
    """
    have = {c.lower(): c for c in df.columns}
    cols = []
    for f in schema.fields:
        src = have.get(f.name.lower())
        c = F.col(src) if src else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def evolve_union(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new rows under one evolved schema: columns of both, missing
    values NULL, widening types unified by ``unionByName``."""
    return old.unionByName(new, allowMissingColumns=True)


def evolve_table(spark: SparkSession, table: str, events: Sequence[dict], current: T.StructType) -> list[str]:
    """Apply EVOLVED new-column events to a catalog table (``ALTER TABLE ADD COLUMNS``).

    Returns the columns added.  Type changes and drops need a rewrite with
    ``align_to`` because Parquet tables cannot alter or drop columns.
    """
    types = {f.name: f.dataType for f in current.fields}
    added = []
    for e in events:
        if e.get("drift_type") == NEW and e.get("action_taken", EVOLVED) == EVOLVED:
            name = e["column_name"]
            spark.sql(f"ALTER TABLE {table} ADD COLUMNS (`{name}` {types[name].simpleString()})")
            added.append(name)
    return added
