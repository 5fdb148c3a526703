"""Equal-depth read plans: predicates that cut a table by quantiles of a key, for parallel JDBC reads of skewed keys.

Even steps between a least and a greatest bound, as ``partitionColumn`` makes them, give one task nearly all rows where keys are
skewed.  Quantiles give each predicate about the same number of rows; a value with more rows than that has a predicate of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Relative error of a quantile's rank is one part in this many.
ACCURACY = 100_000


def split_plan(keys: DataFrame, column: str, parts: int, accuracy: int = ACCURACY) -> DataFrame:
    """(part, low, high, predicate): disjoint predicates that cover every row, the rows without key in a last one.

    A part is low <= key < high; the first has no low, the last no high bound.  ``keys`` may be the column of an earlier extract of the table, or a query for it.
    """
    kind = keys.schema[column].dataType
    if not isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise ValueError(f"{column} is {kind.simpleString()}: quantiles need numbers, dates or times")
    shares, cells = [k / parts for k in range(1, parts)], T.ArrayType(kind)
    quantiles = F.percentile_approx(column, shares, accuracy) if shares else F.array().cast(cells)
    cuts = keys.agg(F.coalesce(quantiles, F.array().cast(cells)).alias("c")).select(F.array_sort(F.array_distinct("c")).alias("c"))
    edge = F.array(F.lit(None).cast(kind))
    zipped = F.arrays_zip(F.concat(edge, "c"), F.concat(F.col("c"), edge)).cast(T.ArrayType(T.StructType([T.StructField("low", kind), T.StructField("high", kind)])))
    parts_of = cuts.select(F.posexplode(zipped).alias("part", "b")).select("part", "b.low", "b.high")
    name = f'"{column}"' if not column.isidentifier() else column

    def literal(c):
        text = c.cast("string")
        if isinstance(kind, T.DateType):
            return F.concat(F.lit("DATE '"), text, F.lit("'"))
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return F.concat(F.lit("TIMESTAMP '"), text, F.lit("'"))
        return text
    above, below = F.concat(F.lit(f"{name} >= "), literal(F.col("low"))), F.concat(F.lit(f"{name} < "), literal(F.col("high")))
    cut = parts_of.withColumn("predicate", F.coalesce(F.nullif(F.concat_ws(" AND ", above, below), F.lit("")), F.lit(f"{name} IS NOT NULL")))
    last = keys.sparkSession.range(1).select(F.lit(-1).alias("part"), F.lit(None).cast(kind).alias("low"), F.lit(None).cast(kind).alias("high"), F.lit(f"{name} IS NULL").alias("predicate"))
    return cut.unionByName(last)

