"""Schemas from the data: the least type that holds every value of a column, its history, and the type that holds all its versions.

Each value's text falls into one class, a bit.  The classes of a column are the ``bit_or`` of its values', so partial results of tasks,
files or days merge in any order, and one small row a column leaves each task however many values it has.  The lattice then
names the least type above all classes.  Folding the versions of a column works from the other side: the types that a version can become
without loss are bits, ``bit_and`` keeps those that all versions can become, and the least of them is the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.types import WIDENING
from sluice.operators.drift import EVOLVED, HALTED, KEYS

BOOLEAN, INT, BIGINT, DOUBLE, DATE, TIMESTAMP, STRING = (1 << k for k in range(7))
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_WHOLE = r"^[+-]?[0-9]+$"
_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,9})?)?$"


def class_of(text: Column) -> Column:
    """The bit of the narrowest type that holds a text; 0 for NULL."""
    return (F.when(text.isNull(), F.lit(0))
            .when(F.lower(text).isin("true", "false"), F.lit(BOOLEAN))
            .when(text.rlike(_WHOLE) & text.try_cast("int").isNotNull(), F.lit(INT))
            .when(text.rlike(_WHOLE) & text.try_cast("long").isNotNull(), F.lit(BIGINT))
            .when(text.rlike(_NUMBER), F.lit(DOUBLE))
            .when(text.rlike(_DATE) & text.try_cast("date").isNotNull(), F.lit(DATE))
            .when(text.rlike(_TIME) & text.try_cast("timestamp_ntz").isNotNull(), F.lit(TIMESTAMP))
            .otherwise(F.lit(STRING)))


def type_of(classes: Column) -> Column:
    """The least type above all classes of a column; VOID if it has no value."""
    def within(bits: int) -> Column:
        return classes.bitwiseAND(F.lit(127 - bits)) == 0
    return (F.when(classes == 0, F.lit("VOID")).when(within(BOOLEAN), F.lit("BOOLEAN"))
            .when(within(INT), F.lit("INT")).when(within(INT | BIGINT), F.lit("BIGINT")).when(within(INT | BIGINT | DOUBLE), F.lit("DOUBLE"))
            .when(within(DATE), F.lit("DATE")).when(within(DATE | TIMESTAMP), F.lit("TIMESTAMP_NTZ")).otherwise(F.lit("STRING")))


def json_values(df: DataFrame, json_col: str, object_col: str) -> DataFrame:
    """(object_id, column_name, position, text) of every top-level key of a JSON object in a text column; text that is no object has none."""
    parsed = F.from_json(F.col(json_col), "map<string,string>")
    return df.select(F.col(object_col).cast("string").alias("object_id"), F.posexplode(parsed).alias("position", "column_name", "text")).select(
        "object_id", "column_name", "position", "text")


def column_values(df: DataFrame, object_id: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(object_id, column_name, position, text) of every cell of a table of texts, as a headed CSV file gives it."""
    names = list(columns or df.columns)
    cells = df.select(*[F.struct(F.lit(k).alias("position"), F.col(f"`{c}`").cast("string").alias("text")).alias(c) for k, c in enumerate(names)])
    return cells.unpivot([], [f"`{c}`" for c in names], "column_name", "cell").select(
        F.lit(object_id).alias("object_id"), "column_name", "cell.position", "cell.text")


def partial_schema(values: DataFrame) -> DataFrame:
    """(object_id, column_name, classes, first_position, n_values): mergeable by ``merge_schemas``."""
    return values.groupBy(*KEYS).agg(F.bit_or(class_of(F.col("text"))).alias("classes"), F.min("position").alias("first_position"), F.count("text").alias("n_values"))


def merge_schemas(partials: DataFrame) -> DataFrame:
    """Partial schemas of several files, days or tasks as one."""
    return partials.groupBy(*KEYS).agg(F.bit_or("classes").alias("classes"), F.min("first_position").alias("first_position"), F.sum("n_values").alias("n_values"))


def observed_schema(partials: DataFrame, object_rows: DataFrame) -> DataFrame:
    """(object_id, column_name, data_type, is_nullable, column_order, n_values): rows in the shape of the schema registry.

    ``object_rows`` has (object_id, n), the rows of each object: a column with fewer values is nullable.  Columns are
    ordered by the least place that any row has them at, then by name.
    """
    seen = merge_schemas(partials).join(object_rows.select("object_id", "n"), "object_id")
    order = F.row_number().over(Window.partitionBy("object_id").orderBy("first_position", "column_name"))  # one row a column
    return seen.select(*KEYS, type_of(F.col("classes")).alias("data_type"), (F.col("n_values") < F.col("n")).alias("is_nullable"), order.alias("column_order"), "n_values")


def schema_history(registrations: DataFrame, run_col: str = "registered_at") -> DataFrame:
    """The intervals in which each definition of a column was in force, from one row per (object, run, column) registered.

    A definition holds from the run that first shows it until the object's next run that does not; ``valid_to`` is that run's
    time, NULL if it still holds.  A column that vanishes and returns has an interval for each time.  Runs are numbered per object, and a
    stretch of runs without a gap (its number minus its rank) is an island.
    """
    value = [*KEYS, "data_type", "is_nullable"]
    seen = registrations.select(*value, F.col(run_col).alias("at")).distinct()
    runs = seen.select("object_id", "at").distinct()
    by_run = Window.partitionBy("object_id").orderBy("at")
    runs = runs.withColumns({"run": F.row_number().over(by_run), "next_at": F.lead("at").over(by_run)})
    ranked = seen.join(runs, ["object_id", "at"]).withColumn("island", F.col("run") - F.row_number().over(Window.partitionBy(*value).orderBy("run")))
    return ranked.groupBy(*value, "island").agg(
        F.min("at").alias("valid_from"), F.max_by("next_at", "run").alias("valid_to"), F.count(F.lit(1)).alias("runs")).drop("island")


def _upward() -> dict[str, set[str]]:
    """What each type can become without loss, itself included."""
    up = {t: {t} for pair in WIDENING for t in pair} | {"STRING": {"STRING"}, "BOOLEAN": {"BOOLEAN"}}
    for _ in up:
        for old, new in WIDENING:
            for reached in up.values():
                if old in reached:
                    reached.add(new)
    return up


def fold_types(versions: DataFrame, type_col: str = "data_type") -> DataFrame:
    """(object_id, column_name, n_versions, data_type, action_taken): the least type that every version of a column widens to.

    Decimals fold into one with the most digits on both sides of the point, up to 38.  Where no type holds all versions, or one is unknown,
    ``data_type`` is NULL and the action HALTED.  Missing versions (NULL) do not count.
    """
    up = _upward()
    # Of types that hold all versions the least is the one that most others are above, so narrow ones have low bits.
    names = sorted(up, key=lambda t: (-len(up[t]), t))
    place = {t: k for k, t in enumerate(names)}
    kind, every = F.upper(F.regexp_replace(F.col(type_col), r"\s+", "")), (1 << len(names)) - 1
    above = F.lit(0).cast("long")
    for t in reversed(names):
        above = F.when(kind == t, F.lit(sum(1 << place[u] for u in up[t])).cast("long")).otherwise(above)
    digits = [F.regexp_extract(kind, r"^DECIMAL\((\d+),(\d+)\)$", g).try_cast("int") for g in (1, 2)]
    folded = versions.where(F.col(type_col).isNotNull()).groupBy(*KEYS).agg(
        F.count_distinct(kind).alias("n_versions"), F.bit_and(above).alias("common"), F.bool_and(digits[0].isNotNull()).alias("decimals"),
        F.max(digits[0] - digits[1]).alias("whole"), F.max(digits[1]).alias("scale"))
    least = F.lit(None).cast("string")
    for t in reversed(names):
        least = F.when(F.col("common").bitwiseAND(F.lit(1 << place[t]).cast("long")) != 0, F.lit(t)).otherwise(least)
    precision = F.col("whole") + F.col("scale")
    decimal = F.when(precision <= 38, F.concat(F.lit("DECIMAL("), precision.cast("string"), F.lit(","), F.col("scale").cast("string"), F.lit(")")))
    found = F.when(F.col("decimals"), decimal).when(F.col("common") != every, least)
    return folded.select(*KEYS, "n_versions", found.alias("data_type"), F.when(found.isNull(), F.lit(HALTED)).otherwise(F.lit(EVOLVED)).alias("action_taken"))
