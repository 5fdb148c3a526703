"""Bounded, repeatable samples of labelled and unlabelled documents.

Labels are learned only from rows whose crc32(doc_id as text) mod 4 is not 2.  A sample takes the rows whose
hashed id falls below ``size / rows`` of the hash range, so about ``size`` rows however large the table is, chosen alike at every size.
Only sampled ids are broadcast, and only the sampled documents' texts travel.  Ids are sampled, not rows: of the rows under one id the
least text stands for it, so a sample is no larger than stated however many rows share an id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def chance(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)


def trained(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label) of the rows that may be learned from; one row an id, rows without id or label left out."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(id_col)))
    return rows.groupBy(F.col(id_col).alias("doc_id")).agg((F.max(F.col(label)) > 0).cast("int").alias("label"))


def sample(ids: DataFrame, size: int, seed: int, doc_id: str = "doc_id") -> DataFrame:
    """About ``size`` of the rows (one an id), or all if there are fewer."""
    n = ids.count()
    return ids.where(chance(F.col(doc_id), seed) < size / max(n, 1))


def texts_of(docs: DataFrame, chosen: DataFrame, kind: str) -> DataFrame:
    """(doc_id, ``kind``, text) of the chosen ids, one row for each row of ``chosen``; ids that ``docs`` lacks are left out."""
    # ``chosen`` is bounded by the sizes of its samples.
    return docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", kind).agg(F.min("text").alias("text"))
