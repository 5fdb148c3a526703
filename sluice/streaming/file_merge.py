"""Merge new files of a cloud_storage object into its target, micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sluice.functions.hashing import with_record_hash
from sluice.operators.ingest import assert_unique_keys, merge_snapshot
from sluice.sinks.writers import replace_table, write_table


def merge_stream(spark: SparkSession, path: str, schema: T.StructType, target: str, staging: str,
                 primary_key: Sequence[str], checkpoint: str, order_cols: Sequence[str] = (), fmt: str = "parquet",
                 hash_columns: Sequence[str] | None = None, available_now: bool = True) -> StreamingQuery:
    """Start a stream over ``path``; each micro-batch is hashed and merged into
    ``target`` (first batch creates it).  ``checkpoint`` must be a shared
    folder on a cluster; ``available_now`` processes what is there and stops.

    A key that occurs several times in a micro-batch counts with its row of the greatest ``order_cols``; without
    them the micro-batch is refused.  Every micro-batch rewrites an unpartitioned target, so
    use large ones.

    ``foreachBatch`` delivers a micro-batch at least once.  The merge is
    idempotent, so a batch replayed after a failure classifies as UNCHANGED and
    leaves the target as it was.
    """
    pk = list(primary_key)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def merge_batch(batch: DataFrame, _epoch: int) -> None:
        session = batch.sparkSession  # the micro-batch runs in its own session
        if order_cols:
            rest = [c for c in batch.columns if c not in pk]
            newest = F.max_by(F.struct(*rest), F.struct(*order_cols)).alias("_n")
            batch = batch.groupBy(*pk).agg(newest).select(*pk, "_n.*").select(*batch.columns)
        assert_unique_keys(batch, pk)
        hashed = with_record_hash(batch, hash_columns)
        if not session.catalog.tableExists(target):
            write_table(hashed, target, mode="overwrite", bucket_cols=pk, buckets=buckets)
        else:
            merged = merge_snapshot(hashed, session.table(target), pk)
            replace_table(merged, target, staging, bucket_cols=pk, buckets=buckets)
        spark.catalog.refreshTable(target)  # the caller's session lists the new files

    stream = spark.readStream.format(fmt).schema(schema).load(path)
    writer = stream.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
