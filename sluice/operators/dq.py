"""Data-quality rules: evaluate before the write, set failing rows aside, gate.

Rules are config (a handful per object), so a Python loop over rules builds
Column expressions; the data is scanned by Spark:

- every row-level rule (NOT_NULL, VALUE_RANGE/RANGE, REGEX, free SQL) and
  ROW_COUNT fold into **one** aggregate, so one scan serves them all;
- UNIQUE is one ``groupBy(keys).count()`` per rule; partial aggregation
  means a key held by a third of the rows still ships one row per task;
- REFERENTIAL counts the child per value first, then joins those counts to
  the parent's distinct values.  Both sides are unique per value, so a hot
  child value is one row in the join.

``rule_table`` judges the rules of all objects as rows, without a column per rule.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.joins import join_per_key
from sluice.functions.lists import parse_list

log = logging.getLogger(__name__)

PASSED, FAILED, WARNING = "PASSED", "FAILED", "WARNING"
CONTINUED, HALTED = "CONTINUED", "HALTED"


@dataclass(frozen=True)
class Rule:
    rule_id: str
    rule_type: str
    rule_expression: str | None = None
    column_name: str | None = None
    expected_value: str | None = None
    severity: str = "ERROR"
    rule_name: str | None = None
    object_id: str | None = None
    pipeline_id: str | None = None

    @property
    def name(self) -> str:
        return self.rule_name or self.rule_id

    @property
    def kind(self) -> str:
        return self.rule_type.strip().upper()


def rules_from_config(cfg: DataFrame, object_id: str | None = None) -> list[Rule]:
    """Active rules of one object (or all), from ``dq_rule_config`` rows.

    Rules are config rows: they come to the driver, where their expressions become columns.
    """
    q = cfg.filter(F.col("active_flag"))
    if object_id is not None:
        q = q.filter(F.col("object_id") == object_id)
    fields = [f for f in Rule.__dataclass_fields__ if f in q.columns]
    return [Rule(**{f: r[f] for f in fields}) for r in q.select(*fields).orderBy("rule_id").collect()]


def _blank(s: str | None) -> bool:
    return s is None or not str(s).strip()


def _bounds(rule: Rule, df: DataFrame) -> tuple[Column | None, Column | None]:
    """``min|max`` text to literals of the column's type (``try_cast``: a bad bound is NULL)."""
    lo, _, hi = (rule.expected_value or "").partition("|")
    dtype = df.schema[rule.column_name].dataType
    lo_c = F.lit(lo.strip()).try_cast(dtype) if lo.strip() else None
    hi_c = F.lit(hi.strip()).try_cast(dtype) if hi.strip() else None
    return lo_c, hi_c


def pass_predicate(rule: Rule, df: DataFrame) -> Column:
    """The row-level pass predicate of a rule.

    ``rule_expression`` is the predicate when given.  When blank it is built
    from the type: NOT_NULL ``c IS NOT NULL``; VALUE_RANGE / RANGE bounds
    ``min|max`` cast to the column's type; REGEX ``c RLIKE expected_value``.
    """
    kind = rule.kind
    if kind == "REGEX" and not _blank(rule.expected_value) and rule.column_name:
        return F.col(rule.column_name).rlike(rule.expected_value)
    if not _blank(rule.rule_expression):
        return F.expr(rule.rule_expression)
    if kind == "NOT_NULL":
        return F.col(rule.column_name).isNotNull()
    if kind in ("VALUE_RANGE", "RANGE"):
        lo, hi = _bounds(rule, df)
        c = F.col(rule.column_name)
        pred = F.lit(True)
        if lo is not None:
            pred = pred & (c >= lo)
        if hi is not None:
            pred = pred & (c <= hi)
        return pred
    raise ValueError(f"rule {rule.rule_id}: no expression and no default for {kind}")


def broken_columns(df: DataFrame, columns: Mapping[int, Column], aggregated: bool = False) -> dict[int, str]:
    """The reasons why some of the columns are no boolean over ``df``; analysis only, no job runs.

    All are analysed in one array of one projection.  Only if that fails are the columns halved, so a few bad ones among many cost a few analyses.
    """
    if not columns:
        return {}
    try:
        whole = F.array(*columns.values())
        found = (df.agg(whole.alias("_x")) if aggregated else df.select(whole.alias("_x"))).schema["_x"].dataType.elementType.simpleString()
        reason = None if found == "boolean" else f"expression is {found}, not boolean"
    except Exception as e:  # analysis errors come in several classes
        reason = str(e)
    if reason is None or len(columns) == 1:
        return {} if reason is None else {next(iter(columns)): reason}
    keys, half = list(columns), len(columns) // 2
    return {**broken_columns(df, {k: columns[k] for k in keys[:half]}, aggregated), **broken_columns(df, {k: columns[k] for k in keys[half:]}, aggregated)}


def _unique_keys(rule: Rule) -> list[str]:
    if not _blank(rule.rule_expression) and "(" not in rule.rule_expression:
        return parse_list(rule.rule_expression)
    return parse_list(rule.column_name)


def _parent_ref(rule: Rule) -> tuple[str, str]:
    ref = rule.rule_expression if not _blank(rule.rule_expression) and "." in rule.rule_expression \
        else rule.expected_value
    table, _, column = (ref or "").strip().rpartition(".")
    if not table or not column:
        raise ValueError(f"rule {rule.rule_id}: REFERENTIAL needs parent_table.parent_column")
    return table, column


def _min_rows(rule: Rule) -> int | None:
    try:
        return int(str(rule.expected_value).strip()) if not _blank(rule.expected_value) else None
    except ValueError:
        return None


_META = ["rule_id", "rule_name", "rule_type", "column_name", "severity"]


def _meta_values(rule: Rule) -> list[str | None]:
    return [rule.rule_id, rule.name, rule.kind, rule.column_name, rule.severity.upper()]


def _meta(rule: Rule) -> list[Column]:
    return [F.lit(v).cast("string").alias(c) for c, v in zip(_META, _meta_values(rule), strict=True)]


def evaluate_rules(df: DataFrame, rules: Sequence[Rule], parents: Mapping[str, DataFrame] | None = None,
                   failure_action: str = "HALT") -> DataFrame:
    """One result row per rule: rows checked / passed / failed, pass rate,
    status and action.  NULL predicate results count as failed; a rule whose
    expression does not analyse is FAILED with NULL counts and a ``reason``, the others still run.
    """
    parents = parents or {}
    spark = df.sparkSession
    broken, by_row, by_table, reasons = [], {}, {}, {}
    for i, r in enumerate(rules):
        if r.kind in ("UNIQUE", "REFERENTIAL"):
            continue
        try:
            if r.kind == "ROW_COUNT":
                need = _min_rows(r)
                by_table[i] = F.count(F.lit(1)) >= F.lit(need) if need is not None else F.expr(r.rule_expression)
            else:
                by_row[i] = pass_predicate(r, df)
        except Exception as e:
            reasons[i] = str(e)
    reasons |= broken_columns(df, by_row) | broken_columns(df, by_table, aggregated=True)
    broken += [(rules[i], reason) for i, reason in sorted(reasons.items())]
    # One aggregate and one list of rules beside it: rows that pass each rule, -1 where a rule of the whole table does not hold.
    judged = [i for i in sorted(by_row | by_table) if i not in reasons]
    passed = [F.count_if(by_row[i]) if i in by_row else F.when(by_table[i], F.count(F.lit(1))).otherwise(F.lit(-1)) for i in judged]
    parts = []
    if judged:
        listed = json.dumps([dict(zip(_META, _meta_values(rules[i]), strict=True)) for i in judged])
        named = F.from_json(F.lit(listed), "array<struct<" + ", ".join(f"{c}: string" for c in _META) + ">>")
        one = df.agg(F.count(F.lit(1)).alias("_n"), F.array(*passed).alias("_p"))
        each = one.select("_n", F.explode(F.arrays_zip(named.alias("rule"), F.col("_p").alias("passed"))).alias("_r"))
        parts.append(each.select("_r.rule.*", F.col("_n").alias("rows_checked"), F.greatest(F.col("_r.passed"), F.lit(0)).alias("rows_passed"),
                                 (F.col("_r.passed") == F.col("_n")).alias("_ok")))
    for r in rules:
        if r.kind not in ("UNIQUE", "REFERENTIAL"):
            continue
        try:
            part = _unique_result(df, r) if r.kind == "UNIQUE" else _referential_result(df, r, parents)
            part.schema  # analysis only: a missing column or parent table makes this rule FAILED
            parts.append(part)
        except Exception as e:
            broken.append((r, str(e)))
    for r, reason in broken:
        log.warning("rule %s cannot be evaluated: %s", r.rule_id, reason)
        parts.append(spark.range(1).select(*_meta(r), F.lit(None).cast("long").alias("rows_checked"),
                                           F.lit(None).cast("long").alias("rows_passed"),
                                           F.lit(False).alias("_ok"), F.lit(reason).alias("reason")))
    if not parts:
        raise ValueError("no rules to evaluate")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    if "reason" not in out.columns:
        out = out.withColumn("reason", F.lit(None).cast("string"))
    return finish(out, failure_action, extra=["reason"])


def _unique_result(df: DataFrame, r: Rule) -> DataFrame:
    keys = _unique_keys(r)
    any_null = F.lit(False)
    for k in keys:
        any_null = any_null | F.col(k).isNull()
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    single = any_null | (F.col("_c") == 1)
    agg = g.agg(F.sum("_c").alias("rows_checked"),
                F.sum(F.when(single, F.col("_c")).otherwise(F.lit(0))).alias("rows_passed"))
    agg = agg.select(F.coalesce("rows_checked", F.lit(0)).cast("long").alias("rows_checked"),
                     F.coalesce("rows_passed", F.lit(0)).cast("long").alias("rows_passed"))
    return agg.select(*_meta(r), "rows_checked", "rows_passed",
                      (F.col("rows_checked") == F.col("rows_passed")).alias("_ok"))


def _referential_result(df: DataFrame, r: Rule, parents: Mapping[str, DataFrame]) -> DataFrame:
    table, pcol = _parent_ref(r)
    parent = parents.get(table)
    if parent is None:
        parent = df.sparkSession.table(table)
    child_counts = df.groupBy(F.col(r.column_name).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    keys = parent.select(F.col(pcol).alias("_v")).where(F.col("_v").isNotNull()).distinct() \
        .withColumn("_hit", F.lit(1))
    j = child_counts.join(keys, "_v", "left")
    agg = j.agg(F.coalesce(F.sum("_c"), F.lit(0)).cast("long").alias("rows_checked"),
                F.coalesce(F.sum(F.when(F.col("_hit").isNotNull(), F.col("_c"))), F.lit(0)).cast("long")
                .alias("rows_passed"))
    return agg.select(*_meta(r), "rows_checked", "rows_passed",
                      (F.col("rows_checked") == F.col("rows_passed")).alias("_ok"))


def finish(out: DataFrame, failure_action: str, extra: Sequence[str] = ()) -> DataFrame:
    """Status and action of each rule from its counts and ``_ok``; ``extra`` columns are passed on."""
    halt = failure_action.strip().upper() == "HALT"
    ok = F.coalesce(F.col("_ok"), F.lit(False))
    status = (F.when(ok, F.lit(PASSED)).when(F.col("severity") == "WARN", F.lit(WARNING))
              .otherwise(F.lit(FAILED)))
    action = (F.when(~ok & (F.col("severity") == "ERROR") & F.lit(halt), F.lit(HALTED))
              .otherwise(F.lit(CONTINUED)))
    return out.select(
        "rule_id", "rule_name", "rule_type", "column_name", "severity",
        F.col("rows_checked").cast("long").alias("rows_checked"),
        F.col("rows_passed").cast("long").alias("rows_passed"),
        (F.col("rows_checked") - F.col("rows_passed")).cast("long").alias("rows_failed"),
        F.round(F.try_divide(F.col("rows_passed") * F.lit(100.0), F.col("rows_checked")), 4).alias("pass_rate"),
        status.alias("status"), action.alias("action_taken"), *extra)


def quarantine(df: DataFrame, rules: Sequence[Rule], parents: Mapping[str, DataFrame] | None = None,
               out_col: str = "failed_rules") -> tuple[DataFrame, DataFrame]:
    """Split rows into (clean, rejected); rejected rows carry the comma list of
    the row-level rules they fail.  Aggregate rules (ROW_COUNT) judge the table,
    not rows, and are skipped here.

    UNIQUE joins each row to the repeated keys and REFERENTIAL to the parent's
    distinct values, through ``join_per_key``.
    """
    parents = parents or {}
    names: list[Column] = []
    helpers: list[str] = []
    work = df
    for i, r in enumerate(rules):
        kind = r.kind
        if kind == "ROW_COUNT":
            continue
        if kind == "UNIQUE":
            # only keys with several rows can fail: the side to join holds them alone, mostly a few
            keys, n_col = _unique_keys(r), f"__sluice_u{i}"
            full = df
            for k in keys:
                full = full.where(F.col(k).isNotNull())
            again = full.groupBy(*keys).agg(F.count(F.lit(1)).alias(n_col)).where(F.col(n_col) > 1)
            work = join_per_key(work, again, keys)
            bad = F.col(n_col).isNotNull()
            helpers.append(n_col)
        elif kind == "REFERENTIAL":
            table, pcol = _parent_ref(r)
            parent = parents.get(table)
            if parent is None:
                parent = df.sparkSession.table(table)
            ref_col = f"__sluice_r{i}"
            known = (parent.select(F.col(pcol).alias(r.column_name)).where(F.col(r.column_name).isNotNull())
                     .distinct().withColumn(ref_col, F.lit(True)))
            work = join_per_key(work, known, [r.column_name])
            bad = F.col(ref_col).isNull()
            helpers.append(ref_col)
        else:
            bad = ~F.coalesce(pass_predicate(r, df), F.lit(False))
        names.append(F.when(bad, F.lit(r.name)))
    flagged = work.withColumn(out_col, F.concat_ws(",", *names)).drop(*helpers)
    rejected = flagged.filter(F.col(out_col) != "")
    clean = flagged.filter(F.col(out_col) == "").drop(out_col)
    return clean, rejected


def gate(results: DataFrame) -> bool:
    """True when the write may go ahead: no result is HALTED.  Reads one row at most."""
    return results.filter(F.col("action_taken") == HALTED).limit(1).count() == 0


def check_result_rows(results: DataFrame, run_id: str, object_id: str, pipeline_id: str,
                      checked_at, environment: str) -> DataFrame:
    """Results shaped as ``dq_check_results`` rows (``result_id`` is given at write time)."""
    return results.select(
        F.lit(run_id).alias("run_id"), F.lit(object_id).alias("object_id"), "rule_id",
        F.lit(pipeline_id).alias("pipeline_id"), "rule_name", "rule_type", "column_name",
        "rows_checked", "rows_passed", "rows_failed", "pass_rate", "status", "action_taken",
        F.lit(checked_at).cast("timestamp").alias("checked_at"), F.lit(environment).alias("environment"))
