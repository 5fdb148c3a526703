"""Writers: append-only logs, overwrite, staged overwrite, column-subset insert.

Data sinks raise; log sinks catch, report and return False, so logging never
crashes a pipeline.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.schemas import TABLES

log = logging.getLogger(__name__)


def conform(df: DataFrame, schema, required: Sequence[str] = ()) -> DataFrame:
    """Columns in table order and type; missing nullable columns NULL.

    A NULL in a required column fails the write job itself (``raise_error``
    inside the projection), so the check costs no extra pass and no row of a
    bad batch is committed.
    """
    have = {c.lower(): c for c in df.columns}
    missing_required = [c for c in required if c.lower() not in have]
    if missing_required:
        raise ValueError(f"required columns missing: {', '.join(missing_required)}")
    cols = []
    for f in schema.fields:
        src = have.get(f.name.lower())
        c = F.col(src).cast(f.dataType) if src else F.lit(None).cast(f.dataType)
        if f.name in required:
            c = F.when(c.isNull(), F.raise_error(F.lit(f"NULL in required column {f.name}"))
                       ).otherwise(c).cast(f.dataType)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def by_name(df: DataFrame, table: str) -> DataFrame:
    """``df`` in the order and types of an existing table, which first gets the columns it does not have yet."""
    spark = df.sparkSession
    have = {f.name.lower() for f in spark.table(table).schema.fields}
    new = [f for f in df.schema.fields if f.name.lower() not in have]
    if new:
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in new)})")
        spark.catalog.refreshTable(table)
    return conform(df, spark.table(table).schema)


def write_table(df: DataFrame, table: str, mode: str = "append", partition_cols: Sequence[str] = (),
                rebalance: bool = True, bucket_cols: Sequence[str] = (), buckets: int | None = None) -> None:
    """Write to a catalog table: insert by column name when it exists, create otherwise.

    ``REBALANCE`` lets AQE size the output files (fewer, fuller files instead
    of one per shuffle partition).  An overwrite of a partitioned table replaces the
    partitions written.

    ``bucket_cols``/``buckets`` create the table bucketed by its primary key.
    A merge then joins the stored target without shuffling it: only the
    incoming batch moves, not the whole target.  A first bucketed write deals the rows by the same
    hash, so each bucket is one file of one task.
    """
    spark = df.sparkSession
    exists = spark.catalog.tableExists(table)
    bucketed = bool(bucket_cols and buckets) or (exists and _is_bucketed(spark, table))
    if exists:
        df = by_name(df, table)
    if bucketed and not exists:
        out = df.repartition(int(buckets), *bucket_cols)
    elif bucketed or not rebalance:
        out = df
    else:
        out = df.hint("rebalance", *partition_cols) if partition_cols else df.hint("rebalance")
    if exists:
        out.write.option("partitionOverwriteMode", "dynamic").insertInto(table, overwrite=(mode == "overwrite"))
    else:
        w = out.write.mode(mode).format("parquet")
        if partition_cols:
            w = w.partitionBy(*partition_cols)
        if bucket_cols and buckets:
            w = w.bucketBy(int(buckets), *bucket_cols)
        w.saveAsTable(table)


def _is_bucketed(spark: SparkSession, table: str) -> bool:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").filter("col_name = 'Num Buckets'").collect()
    return bool(rows) and rows[0].data_type not in ("", "-1", "0")


def append_log(df: DataFrame, database: str, table: str) -> bool:
    """Append rows to a control log table after the required-column check.

    Never raises: a failure is logged and reported as False.
    """
    try:
        insert_columns(df, database, table)
        return True
    except Exception as e:  # logging must not crash the pipeline
        log.error("log write to %s.%s failed: %s", database, table, str(e).splitlines()[0])
        return False


def insert_columns(df: DataFrame, database: str, table: str) -> None:
    """``INSERT INTO t (cols) VALUES ...`` as a batch: rows with a subset of the
    columns, the others NULL; required columns must be present and non-NULL."""
    name = f"{database}.{table}"
    required = [f.name for f in TABLES[table].fields if not f.nullable]
    # insertInto is positional and a partitioned table lists its partition columns last
    stored = df.sparkSession.table(name).schema
    conform(df, stored, required).write.insertInto(name)


_COMPLETE = "sluice.complete"


def overwrite_via_staging(df: DataFrame, target: str, staging: str, partition_cols: Sequence[str] = (),
                          bucket_cols: Sequence[str] = (), buckets: int | None = None, dynamic: bool = False,
                          touched: DataFrame | None = None) -> None:
    """Replace ``target`` with ``df`` when ``df`` reads ``target`` itself (a merge).

    Spark refuses to overwrite a table it is reading, and a Parquet target
    has no MERGE.  So the result goes to ``staging`` first, then staging
    overwrites the target: all of it, or with ``dynamic`` the partitions in ``touched`` (default: those that ``df``
    has rows in).  A touched partition that is left without rows is dropped.

    Staging is marked when it is complete.  If a crash comes after that, ``recover`` finishes from it; if one
    comes before, the target is untouched and a rerun starts over.
    """
    spark: SparkSession = df.sparkSession
    parts = f"{staging}__parts"
    for t in (staging, parts):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    write_table(df, staging, mode="overwrite", partition_cols=partition_cols, bucket_cols=bucket_cols, buckets=buckets)
    if dynamic and touched is not None:
        touched.select(*partition_cols).distinct().write.format("parquet").saveAsTable(parts)
    spark.sql(f"ALTER TABLE {staging} SET TBLPROPERTIES ('{_COMPLETE}' = '{'partitions' if dynamic else 'table'}')")
    _finish_staging(spark, target, staging)


def _finish_staging(spark: SparkSession, target: str, staging: str) -> None:
    how = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {staging}").collect()}[_COMPLETE]
    columns = _partition_columns(spark, target)
    write_table(spark.table(staging), target, mode="overwrite", partition_cols=columns)
    touched = spark.table(f"{staging}__parts") if spark.catalog.tableExists(f"{staging}__parts") else None
    if columns and how == "table":
        touched = spark.table(target).select(*columns).distinct()
    if touched is not None:
        left, right = touched, spark.table(staging).select(*columns).distinct()
        same = None
        for c in columns:
            term = left[c].eqNullSafe(right[c])
            same = term if same is None else same & term
        for row in left.join(right, same, "left_anti").collect():  # emptied partitions: catalog entries, not data
            spec = ", ".join(f"`{c}` = " + ("null" if row[c] is None else "'" + str(row[c]).replace("'", "\\'") + "'") for c in columns)
            spark.sql(f"ALTER TABLE {target} DROP IF EXISTS PARTITION ({spec})")
    for t in (staging, f"{staging}__parts"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    spark.catalog.refreshTable(target)


def recover(spark: SparkSession, target: str, staging: str) -> None:
    """Finish what a crashed write left: a target that was moved aside comes back, a complete staging copy is applied."""
    if not spark.catalog.tableExists(target) and spark.catalog.tableExists(f"{target}__prev"):
        spark.sql(f"ALTER TABLE {target}__prev RENAME TO {target.split('.')[-1]}")
    if spark.catalog.tableExists(staging) and spark.catalog.tableExists(target):
        if any(r.key == _COMPLETE for r in spark.sql(f"SHOW TBLPROPERTIES {staging}").collect()):
            _finish_staging(spark, target, staging)


def table_location(spark: SparkSession, table: str) -> str:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").filter("col_name = 'Location'").collect()
    return rows[0].data_type


def _partition_columns(spark: SparkSession, table: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(table) if c.isPartition]


def _delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def schema_changed(df: DataFrame, table: str) -> bool:
    """True when ``df`` has columns or types the table does not (by name; order aside)."""
    stored = {f.name: f.dataType for f in df.sparkSession.table(table).schema.fields}
    return any(stored.get(f.name) != f.dataType for f in df.schema.fields)


def replace_table(df: DataFrame, target: str, staging: str, bucket_cols: Sequence[str] = (),
                  buckets: int | None = None, keep_previous: bool = False) -> None:
    """Replace ``target``'s data with ``df`` (which may read ``target``), writing it once.

    The result goes to a fresh folder next to the target's, through an
    external ``staging`` table that carries the bucketing; the target is then
    repointed there with ``ALTER TABLE ... SET LOCATION``, a metadata-only
    switch, and the previous folder is deleted.  Compared with a staged copy
    this halves the bytes written per merge.  A crash before the switch
    leaves the target untouched; after it, the new version is complete.

    A changed schema (new column, widened type) must reach the catalog too:
    the new version is then created as ``<target>__next`` in the target's
    database, the target is renamed to ``<target>__prev`` and the new version to the target, and only then is
    the old one dropped; ``recover`` puts it back if a crash comes between the two renames.  A partitioned
    target with an unchanged schema takes the staged copy (its partitions are catalogued one by one); the
    whole table is replaced, partitions without new rows included.
    """
    import uuid
    spark: SparkSession = df.sparkSession
    if not spark.catalog.tableExists(target):
        write_table(df, target, mode="overwrite", bucket_cols=bucket_cols, buckets=buckets)
        return
    parts = _partition_columns(spark, target)
    evolved = schema_changed(df, target)
    if parts and not evolved:
        overwrite_via_staging(df, target, staging, partition_cols=parts)
        return
    old = table_location(spark, target)
    parent, name = old.rstrip("/").rsplit("/", 1)
    new = f"{parent}/{name.split('__v')[0]}__v{uuid.uuid4().hex[:12]}"
    if not (bucket_cols and buckets) and _is_bucketed(spark, target):
        info = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {target}").collect()}
        buckets = int(info["Num Buckets"])
        bucket_cols = [c.strip(" `") for c in info["Bucket Columns"].strip("[]").split(",")]
    if evolved:
        staging = f"{target}__next"
    spark.sql(f"DROP TABLE IF EXISTS {staging}")
    out = df if bucket_cols and buckets else df.hint("rebalance")
    if parts:
        out = out.select(*[c for c in out.columns if c not in parts], *parts)
    w = out.write.option("path", new).format("parquet").mode("overwrite")
    if parts:
        w = w.partitionBy(*parts)
    if bucket_cols and buckets:
        w = w.bucketBy(int(buckets), *bucket_cols)
    w.saveAsTable(staging)
    if evolved:
        aside = f"{target}__prev"
        spark.sql(f"DROP TABLE IF EXISTS {aside}")
        spark.sql(f"ALTER TABLE {target} RENAME TO {aside.split('.')[-1]}")
        spark.sql(f"ALTER TABLE {staging} RENAME TO {target.split('.')[-1]}")
        old = table_location(spark, aside)
        spark.sql(f"DROP TABLE {aside}")
    else:
        spark.sql(f"ALTER TABLE {target} SET LOCATION '{new}'")
        spark.sql(f"DROP TABLE {staging}")  # external: the folder stays, now the target's
    spark.catalog.refreshTable(target)
    if not keep_previous:
        _delete_path(spark, old)
