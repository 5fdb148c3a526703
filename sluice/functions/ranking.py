"""Position of a row within its group, without putting a hot group in one task.

``row_number() OVER (PARTITION BY g ORDER BY o)`` sends every row of a group
to one task: if one group holds a third of the data, so does that task.
Here the rows are sorted globally by ``(g, o)``.  Spark's range partitioner
cuts the sort into many partitions (a hot group spans many of them), and
each row gets its position within its partition (``monotonically_increasing_id``
keeps the partition in the high bits).  The tagged rows are written once to
the session's checkpoint folder, so the positions are fixed and the lineage
is cut.  A small aggregate then counts each group's rows per partition, and
a running sum over those counts gives each (group, partition) piece its
offset.  The result equals ``row_number()`` exactly when ``o`` ends with a
unique column.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.session import ensure_checkpoint_dir

_PART_SHIFT = 33  # monotonically_increasing_id: partition index in the upper 31 bits


def sequence_within_groups(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                           out_col: str = "seq") -> DataFrame:
    group_cols, order_cols = list(group_cols), list(order_cols)
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/sluice-seq-{uuid.uuid4().hex}"

    tagged = (df.orderBy(*group_cols, *order_cols)
              .withColumn("_pos", F.monotonically_increasing_id()))
    tagged.write.parquet(folder)  # positions fixed once; every later read sees the same ones
    tagged = spark.read.parquet(folder).withColumn("_part", F.shiftright("_pos", _PART_SHIFT))

    pieces = tagged.groupBy(*group_cols, "_part").agg(F.count(F.lit(1)).alias("_n"),
                                                       F.min("_pos").alias("_first"))
    earlier = Window.partitionBy(*group_cols).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(*[F.col(c).alias(f"_o_{i}") for i, c in enumerate(group_cols)],
                            F.col("_part").alias("_o_part"), "_first",
                            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    cond = tagged["_part"] == offsets["_o_part"]
    for i, c in enumerate(group_cols):
        cond = cond & tagged[c].eqNullSafe(offsets[f"_o_{i}"])
    joined = tagged.join(offsets, cond, "inner")
    seq = F.col("_before") + F.col("_pos") - F.col("_first") + F.lit(1)
    out = joined.withColumn(out_col, seq.cast("int"))
    return out.drop("_pos", "_part", "_first", "_before", "_o_part", *[f"_o_{i}" for i in range(len(group_cols))])
