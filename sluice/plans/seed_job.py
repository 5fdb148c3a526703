"""Seed the five config tables from the config document, idempotently.

Per table, in fixed order (source objects first, rules last because rules
need object ids): first row per natural key wins, keys already present are
skipped, rows missing a required field fail, rules whose object cannot be
resolved are dropped.  Outcome counts are computed before the insert.
Each table takes one plan rather than a probe query and an insert per row.
"""

from __future__ import annotations

import datetime as dt
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import config, seed
from sluice.schemas import AUTO_ID_COLUMN, NATURAL_KEYS, SEED_ORDER, TABLES, TIMESTAMP_COLUMNS
from sluice.sinks.writers import insert_columns
from sluice.sources.documents import load_config_document

log = logging.getLogger(__name__)


def _valid(batch: DataFrame, table: str) -> "F.Column":
    filled = {AUTO_ID_COLUMN[table], *TIMESTAMP_COLUMNS[table]}
    ok = F.lit(True)
    for f in TABLES[table].fields:
        if not f.nullable and f.name not in filled and f.name in batch.columns:
            ok = ok & F.col(f.name).isNotNull()
    return ok


def seed_table(spark: SparkSession, database: str, table: str, batch: DataFrame, run_ts) -> dict:
    """Insert-if-absent one section; returns outcome -> row count."""
    keys = NATURAL_KEYS[table]
    existing = spark.table(f"{database}.{table}")
    flagged = batch.withColumn("_ok", _valid(batch, table))
    good = flagged.filter("_ok").drop("_ok")
    failed = flagged.filter(~F.col("_ok")).count()
    outcome = {r.outcome: r.n for r in seed.seed_outcome(good, existing, keys).collect()}
    if failed:
        outcome[seed.FAILED] = outcome.get(seed.FAILED, 0) + failed
    rows = seed.insert_if_absent(good, existing, keys, "_pos").drop("_pos")
    rows = seed.stamp(rows, AUTO_ID_COLUMN[table], TIMESTAMP_COLUMNS[table], run_ts)
    if outcome.get(seed.INSERTED, 0):
        insert_columns(rows, database, table)  # the only action on rows: uuid() runs once
    return outcome


class SeedFailed(RuntimeError):
    def __init__(self, report: dict):
        super().__init__(f"{report['failed']} seed rows failed: {report}")
        self.report = report


def seed_from_document(spark: SparkSession, database: str, path: str, target_catalog: str | None = None,
                       run_ts: dt.datetime | None = None, raise_on_failure: bool = False) -> dict:
    """Seed all five tables; returns {table: outcome counts, 'failed': total}.

    A failed row never stops the other rows or tables.  With
    ``raise_on_failure`` the job still fails at the end when any row failed.
    """
    run_ts = run_ts or dt.datetime.now(dt.timezone.utc)
    sections = load_config_document(spark, path)
    report: dict = {}
    failures = 0
    for table in SEED_ORDER:
        batch = sections[table]
        extra = {}
        if table == "source_object_config" and target_catalog:
            batch = batch.withColumn("target_catalog", F.lit(target_catalog))
        if table == "dq_rule_config":
            lookup = spark.table(f"{database}.source_object_config").select(
                "pipeline_id", "source_object", "object_id", "created_at")
            resolved, dropped = config.resolve_ids(
                batch.drop("object_id"), lookup, {"pipeline_id": "pipeline_id", "source_object": "source_object"},
                "object_id", out_col="object_id", order_cols=["created_at"])
            # a rule that names no object is a failed row (its key is NULL), not one whose object is unknown
            nameless = F.col("pipeline_id").isNull() | F.col("source_object").isNull()
            n_nameless, n_dropped = dropped.agg(F.count_if(nameless), F.count_if(~nameless)).first()
            if n_nameless:
                extra[seed.FAILED] = n_nameless
            if n_dropped:
                log.warning("%d rule rows dropped: no source object for their pipeline/source_object", n_dropped)
                extra[seed.DROPPED] = n_dropped
            batch = resolved.drop("source_object")
        try:
            outcome = seed_table(spark, database, table, batch, run_ts)
        except Exception as e:
            log.error("seeding %s failed: %s", table, str(e).splitlines()[0])
            outcome = {seed.FAILED: batch.count()}
        for k, v in extra.items():
            outcome[k] = outcome.get(k, 0) + v
        failures += outcome.get(seed.FAILED, 0)
        report[table] = outcome
    report["failed"] = failures
    if raise_on_failure and failures:
        raise SeedFailed(report)
    return report
