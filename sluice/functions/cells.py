"""Order within groups, group by group in bounded pieces.

A window over a whole group puts the group into one task.  Here a group is cut into cells along its order (say, hours): rows are
only ever compared inside their (group, cell), and what earlier cells contribute comes from one small row a cell.  A group's
cells are as many as its time span has, whatever its rows, so the window over them stays small.  Nothing is written or sorted
while the plan is built.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.joins import join_per_key


def running_sum(df: DataFrame, groups: Sequence[str], order: Sequence[str | Column], cell: Column, value: Column, out_col: str) -> DataFrame:
    """The sum of ``value`` over a row's group up to the row.  ``cell`` must not fall while the order rises."""
    groups, mark = list(groups), "__cell"
    rows = df.withColumns({mark: cell, "__value": value})
    own = F.sum("__value").over(Window.partitionBy(*groups, mark).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    sums = rows.groupBy(*groups, mark).agg(F.sum("__value").alias("__sum"))
    earlier = Window.partitionBy(*groups).orderBy(mark).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*groups, mark, F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    out = join_per_key(rows.withColumn("__own", own), before, [*groups, mark])
    return out.withColumn(out_col, F.col("__own") + F.col("__before")).drop(mark, "__value", "__own", "__before")


def numbered(df: DataFrame, groups: Sequence[str], order: Sequence[str], cell: Column, out_col: str = "seq") -> DataFrame:
    """``row_number() OVER (PARTITION BY groups ORDER BY order)``, as an int."""
    return running_sum(df, groups, order, cell, F.lit(1), out_col).withColumn(out_col, F.col(out_col).cast("int"))


def carried(history: DataFrame, lookups: DataFrame, groups: Sequence[str], time_col: str, values: Sequence[str],
            cell: Callable[[Column], Column], ties: Sequence[str] = ()) -> DataFrame:
    """Each lookup with the ``values`` of the last history row of its group at or before its time; NULL where there is none.

    ``cell`` gives the cell of a time.  History and lookups meet in their (group, cell); each cell begins with the last row
    before it, carried over from the cells that have one.  Of history rows of one time the one with the greatest ``ties`` counts.
    """
    groups, at = list(groups), F.col(time_col)
    tie = F.struct(*[F.col(t) for t in ties]) if ties else F.struct(F.lit(0).alias("t"))
    past = history.where(at.isNotNull()).select(*groups, cell(at).alias("__cell"), at.alias("__at"), tie.alias("__tie"), F.struct(*[F.col(v) for v in values]).alias("__held"))
    asked = lookups.select(*groups, cell(at).alias("__cell"), at.alias("__at"), F.struct(*[F.col(f"`{c}`") for c in lookups.columns]).alias("__row"))
    both = past.withColumn("__kind", F.lit(1)).unionByName(asked.withColumn("__kind", F.lit(2)), allowMissingColumns=True)
    cells = both.groupBy(*groups, "__cell").agg(
        F.max_by("__held", F.when(F.col("__kind") == 1, F.struct("__at", "__tie"))).alias("__held"), F.max("__kind").alias("__kind"))
    before = Window.partitionBy(*groups).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    start = cells.withColumn("__held", F.last("__held", ignorenulls=True).over(before)).where("__kind = 2 AND __held IS NOT NULL").withColumn("__kind", F.lit(0))
    # Carried rows come first; then by time, history before lookups, so that a lookup sees history of its own time.
    rows = both.unionByName(start, allowMissingColumns=True)
    by_time = Window.partitionBy(*groups, "__cell").orderBy(F.col("__kind") != 0, "__at", "__kind", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("__seen", F.last("__held", ignorenulls=True).over(by_time)).where("__kind = 2")
    return found.select("__row.*", *[F.col("__seen")[v].alias(v) for v in values])
