"""Data-quality rules as data: the rules of all objects in one plan, whose size does not grow with the rules.

``dq.evaluate_rules`` turns every rule into a column expression.  Here rules stay rows.  The checked columns of every object are
melted to (object, column, value), where the value has a lane for each kind of comparison (text, exact number, floating number, time), and
rule rows meet the values by (object, column):

- NOT_NULL, ranges and patterns are judged value by value and counted per rule;
- UNIQUE and REFERENTIAL rules count per value; a REFERENTIAL rule meets its parent's values too, and only notes that they are there;
- ROW_COUNT compares the objects' row counts.

One scan of each object, one join and one aggregate by (rule, value) serve all: a value of a rule that counts rows is NULL there, so a task sends one
row for such a rule, and one for each value of the others.

Rules that need an SQL expression, or name what no object has, are not judged: they come back FAILED with a ``reason``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.operators.dq import finish

EXACT = "decimal(38,9)"
NEAR = "double"
TIME = "timestamp_ntz"
RANGES = ("VALUE_RANGE", "RANGE")
ROW_KINDS = ("NOT_NULL", *RANGES, "REGEX")


def normal_name(c: Column) -> Column:
    """A column or comma list of columns in one spelling."""
    return F.lower(F.regexp_replace(c, r"\s+", ""))


def _value(c: Column, kind: T.DataType) -> Column:
    """A column's value in the lanes that its type has."""
    exact = isinstance(kind, (T.IntegralType, T.DecimalType))
    near, time = isinstance(kind, T.FractionalType) and not exact, isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))

    def lane(on: bool, name: str) -> Column:
        return (c.try_cast(name) if on else F.lit(None).cast(name)).alias(name.split("(")[0])
    return F.struct(c.cast("string").alias("text"), lane(exact, EXACT), lane(near, NEAR), lane(time, TIME))


def melt(objects: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]]) -> DataFrame:
    """(object_id, column_name, value, key) of each row and each of the object's ``columns``; a comma list is one column.

    ``value`` has the lanes of a single column, ``key`` the texts of all listed ones.  Columns that an object lacks are left out.
    """
    parts = []
    for name, df in objects.items():
        have = {f.name.lower(): f for f in df.schema.fields}
        cells = {}
        for listed in dict.fromkeys(",".join(x.strip().lower() for x in c.split(",")) for c in columns.get(name, df.columns)):
            fields = [have.get(x) for x in listed.split(",")]
            if all(fields):
                one = _value(F.col(f"`{fields[0].name}`"), fields[0].dataType)
                cells[listed] = F.struct(one.alias("value"), F.array(*[F.col(f"`{f.name}`").cast("string") for f in fields]).alias("key"))
        if cells:
            wide = df.select(*[c.alias(listed) for listed, c in cells.items()])
            parts.append(wide.unpivot([], [f"`{c}`" for c in cells], "column_name", "cell").select(F.lit(name).alias("object_id"), "column_name", "cell.value", "cell.key"))
    if not parts:
        raise ValueError("no object has any of the columns")
    return reduce(DataFrame.unionByName, parts)


def _bound(rule_text: Column, lane: Column, kind: str, lower: bool) -> Column:
    """NULL where the rule's bound is no value of the lane: such a rule passes nothing.  A blank bound passes all."""
    limit = rule_text.try_cast(kind)
    return (rule_text == "") | ((lane >= limit) if lower else (lane <= limit))


def in_range(value: Column, low: Column, high: Column) -> Column:
    """Whether a value lies between bounds given as text, compared in the lane of the value's type."""
    out = F.when(value["text"].isNull(), F.lit(None).cast("boolean"))
    for name, kind in (("decimal", EXACT), (NEAR, NEAR), (TIME, TIME)):
        lane = value[name]
        out = out.when(lane.isNotNull(), _bound(low, lane, kind, True) & _bound(high, lane, kind, False))
    return out.otherwise(_bound(low, value["text"], "string", True) & _bound(high, value["text"], "string", False))


def _rule_rows(rules: DataFrame) -> DataFrame:
    blank = F.lit(None).cast("string")

    def text(name: str) -> Column:
        return F.col(name).cast("string") if name in rules.columns else blank
    rows = rules.where(F.col("active_flag")) if "active_flag" in rules.columns else rules
    low_high = F.split(F.coalesce(text("expected_value"), F.lit("")), r"\|", 2)
    parent = F.regexp_extract(F.coalesce(F.when(text("rule_expression").contains("."), text("rule_expression")), text("expected_value"), F.lit("")), r"^\s*(.+)\.([^.]+?)\s*$", 1)
    parent_column = F.regexp_extract(F.coalesce(F.when(text("rule_expression").contains("."), text("rule_expression")), text("expected_value"), F.lit("")), r"^\s*(.+)\.([^.]+?)\s*$", 2)
    return rows.select(
        text("object_id").alias("object_id"), "rule_id", F.coalesce(text("rule_name"), F.col("rule_id")).alias("rule_name"),
        F.upper(F.trim("rule_type")).alias("rule_type"), text("column_name").alias("column_name"), normal_name(text("column_name")).alias("on"),
        F.upper(F.coalesce(text("severity"), F.lit("ERROR"))).alias("severity"), F.nullif(F.trim(text("rule_expression")), F.lit("")).alias("expression"),
        text("expected_value").alias("expected"), F.trim(low_high[0]).alias("low"), F.trim(F.coalesce(F.get(low_high, F.lit(1)), F.lit(""))).alias("high"),
        parent.alias("parent"), normal_name(parent_column).alias("parent_on"), F.trim(text("expected_value")).try_cast("long").alias("least"))


def rule_results(objects: Mapping[str, DataFrame], rules: DataFrame, columns: Mapping[str, Sequence[str]] | None = None,
                 failure_action: str = "HALT") -> DataFrame:
    """One row per rule of all objects: counts, pass rate, status and action as ``dq.evaluate_rules`` gives them, ``object_id`` and ``reason``.

    ``rules`` has the columns of ``dq_rule_config``; inactive ones are left out.  ``columns`` names the columns, or comma lists of columns, of an object that
    rules may ask for (default: each of its columns), so that the scan reads no others.  A REFERENTIAL rule's parent is one of
    the objects, whose column must be named too; its keys are compared as text.  Numbers are compared with bounds as
    decimal(38,9) or double, times as timestamps.  Nothing runs while the plan is built, and it holds no rule.
    """
    columns = columns or {}
    rule = _rule_rows(rules)
    cells = melt(objects, columns)
    needs_expression = F.col("expression").isNotNull() & F.col("rule_type").isin(*ROW_KINDS) | ~F.col("rule_type").isin(*ROW_KINDS, "UNIQUE", "REFERENTIAL", "ROW_COUNT")

    # Each rule meets the values of its own column, and a REFERENTIAL one those of its parent's.
    named = [F.col(c) for c in ("rule_id", "rule_type", "low", "high", "expected")]
    own = F.struct(F.col("object_id").alias("at"), F.col("on").alias("column"), F.lit(False).alias("parent"))
    parent = F.struct(F.col("parent").alias("at"), F.col("parent_on").alias("column"), F.lit(True).alias("parent"))
    roles = rule.where(F.col("rule_type").isin("UNIQUE", "REFERENTIAL") | (F.col("rule_type").isin(*ROW_KINDS) & F.col("expression").isNull()))
    roles = roles.select(F.col("object_id").alias("of"), *named, F.explode(F.when(F.col("rule_type") == "REFERENTIAL", F.array(own, parent)).otherwise(F.array(own))).alias("role"))
    roles = roles.select("of", *named, F.col("role.at").alias("object_id"), F.col("role.column").alias("column_name"), F.col("role.parent").alias("is_parent"))
    met = cells.join(roles, ["object_id", "column_name"])
    by_row = F.col("rule_type").isin(*ROW_KINDS)
    passed = (F.when(F.col("rule_type") == "NOT_NULL", F.col("value.text").isNotNull())
              .when(F.col("rule_type") == "REGEX", F.rlike(F.col("value.text"), F.col("expected")))
              .when(by_row, in_range(F.col("value"), F.col("low"), F.col("high"))))
    per_value = met.select("of", "rule_id", "rule_type", "is_parent", F.when(~by_row, F.col("key")).alias("key"), F.coalesce(passed, F.lit(False)).alias("ok")).groupBy(
        "of", "rule_id", "rule_type", "key").agg(F.count_if(~F.col("is_parent")).alias("n"), F.count_if("ok").alias("ok"), F.bool_or("is_parent").alias("known"))
    whole = ~F.exists("key", lambda x: x.isNull())
    good = (F.when(by_row, F.col("ok")).when((F.col("rule_type") == "UNIQUE") & (~whole | (F.col("n") == 1)), F.col("n"))
            .when((F.col("rule_type") == "REFERENTIAL") & whole & F.col("known"), F.col("n")).otherwise(0))
    judged = per_value.groupBy(F.col("of").alias("object_id"), "rule_id").agg(F.sum("n").alias("checked"), F.sum(good).alias("passed"))

    sizes = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("object_id")) for name, df in objects.items()]).groupBy("object_id").agg(F.count(F.lit(1)).alias("size"))
    found = _known_columns(objects, columns, rules)
    sizes = found.select("object_id").distinct().join(sizes, "object_id", "left").select("object_id", F.coalesce("size", F.lit(0)).alias("size"))
    out = rule.join(judged, ["object_id", "rule_id"], "left").join(sizes, "object_id", "left")
    out = out.join(found.withColumn("has", F.lit(True)), ["object_id", "on"], "left").join(
        found.select(F.col("object_id").alias("parent"), F.col("on").alias("parent_on"), F.lit(True).alias("has_parent")), ["parent", "parent_on"], "left")
    by_size = F.col("rule_type") == "ROW_COUNT"
    reason = (F.when(F.col("size").isNull(), F.concat(F.lit("no object "), F.coalesce("object_id", F.lit("NULL"))))
              .when(by_size, F.when(F.col("least").isNull(), F.lit("no row count is expected")))
              .when(needs_expression, F.lit("needs an expression"))
              .when(F.col("has").isNull(), F.concat(F.lit("no column "), F.coalesce("column_name", F.lit("NULL"))))
              .when((F.col("rule_type") == "REFERENTIAL") & F.col("has_parent").isNull(), F.concat(F.lit("no parent column "), "parent", F.lit("."), "parent_on")))
    checked = F.when(reason.isNull(), F.when(by_size, F.col("size")).otherwise(F.coalesce("checked", F.lit(0))))
    passes = F.when(reason.isNull(), F.when(by_size, F.when(F.col("size") >= F.col("least"), F.col("size")).otherwise(0)).otherwise(F.coalesce("passed", F.lit(0))))
    ok = F.when(by_size, F.col("size") >= F.col("least")).otherwise(passes == checked)
    out = out.select("object_id", "rule_id", "rule_name", "rule_type", "column_name", "severity", checked.alias("rows_checked"), passes.alias("rows_passed"),
                     (reason.isNull() & ok).alias("_ok"), reason.alias("reason"))
    return finish(out, failure_action, extra=("object_id", "reason"))


def _known_columns(objects: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]], rules: DataFrame) -> DataFrame:
    rows = []
    for name, df in objects.items():
        have = {c.lower() for c in df.columns}
        for c in columns.get(name, df.columns):
            listed = [x.strip().lower() for x in c.split(",")]
            if have.issuperset(listed):
                rows.append((name, ",".join(listed)))
    return rules.sparkSession.createDataFrame(sorted(set(rows)), "object_id string, `on` string")
