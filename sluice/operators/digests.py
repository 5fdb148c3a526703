"""Comparing two large versions of a table by bucket digests, before any row moves.

Rows go to buckets by a hash of their key.  A bucket's digest is its row count and order-free sums of its rows' hashes: partial sums of
tasks merge, so each task sends one small row a bucket.  Only the rows of buckets whose digests differ are joined and
classified; the others are equal on both sides and stay where they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.operators.ingest import classify

BUCKETS = 1 << 16


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets))


def bucket_digests(df: DataFrame, keys: Sequence[str], hash_col: str, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n, digest) of each bucket that has rows.  The digest adds two different 64-bit hashes of key and record hash, so two versions of
    a bucket have the same one by chance with a probability of about 2^-126."""
    one, two = F.xxhash64(*keys, hash_col), F.xxhash64(F.lit(1), hash_col, *keys)
    return df.groupBy(bucket_of(keys, buckets).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.struct(F.sum(one.cast("decimal(20,0)")).alias("a"), F.sum(two.cast("decimal(20,0)")).alias("b")).alias("digest"))


def unequal_buckets(source: DataFrame, target: DataFrame, keys: Sequence[str], hash_col: str, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n_source, n_target) of the buckets in which the versions differ."""
    s = bucket_digests(source, keys, hash_col, buckets).select("bucket", F.col("n").alias("n_source"), F.col("digest").alias("d_source"))
    t = bucket_digests(target, keys, hash_col, buckets).select("bucket", F.col("n").alias("n_target"), F.col("digest").alias("d_target"))
    both = s.join(t, "bucket", "full_outer").where(~(F.col("n_source").eqNullSafe(F.col("n_target")) & F.col("d_source").eqNullSafe(F.col("d_target"))))
    return both.select("bucket", F.coalesce("n_source", F.lit(0)).alias("n_source"), F.coalesce("n_target", F.lit(0)).alias("n_target"))


def changed_rows(source: DataFrame, target: DataFrame, keys: Sequence[str], hash_col: str = "record_hash", buckets: int = BUCKETS) -> DataFrame:
    """(keys, change_type) of the rows that are new, changed or absent: what ``ingest.classify`` gives but for UNCHANGED rows.

    Both sides are scanned twice, by key and hash columns only; the second time the list of unequal buckets meets the rows before the shuffle.
    """
    keys = list(keys)
    wanted = unequal_buckets(source, target, keys, hash_col, buckets).select("bucket")
    few = [df.select(*keys, hash_col).withColumn("bucket", bucket_of(keys, buckets)).join(wanted, "bucket", "left_semi").drop("bucket") for df in (source, target)]
    return classify(few[0], few[1], keys).where("change_type != 'UNCHANGED'")
