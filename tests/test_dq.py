"""Data-quality rules, results, quarantine, gate."""

from pyspark.sql import functions as F

from sluice.operators import dq
from tests.conftest import SF01


def _by_id(results):
    return {r.rule_id: r for r in results.collect()}


def test_empty_input(spark):
    df = spark.createDataFrame([], "a int, b string")
    rules = [dq.Rule("nn", "NOT_NULL", column_name="a"), dq.Rule("rc", "ROW_COUNT", expected_value="1")]
    got = _by_id(dq.evaluate_rules(df, rules))
    assert got["nn"].rows_checked == 0 and got["nn"].pass_rate is None and got["nn"].status == "PASSED"
    assert got["rc"].status == "FAILED" and got["rc"].action_taken == "HALTED"


def test_null_predicate_fails_and_broken_rule_isolated(spark):
    df = spark.createDataFrame([(1,), (None,), (5,)], "a int")
    rules = [dq.Rule("pos", "CUSTOM", "a > 0", severity="WARN"),
             dq.Rule("bad", "CUSTOM", "no_such_col > 1"),
             dq.Rule("notbool", "CUSTOM", "a + 1")]
    got = _by_id(dq.evaluate_rules(df, rules))
    assert (got["pos"].rows_passed, got["pos"].rows_failed, got["pos"].status) == (2, 1, "WARNING")
    assert got["pos"].action_taken == "CONTINUED"
    assert got["bad"].status == "FAILED" and got["bad"].rows_checked is None
    assert got["notbool"].status == "FAILED"


def test_warn_action_continues(spark):
    df = spark.createDataFrame([(None,)], "a int")
    got = _by_id(dq.evaluate_rules(df, [dq.Rule("nn", "NOT_NULL", column_name="a")], failure_action="WARN"))
    assert (got["nn"].status, got["nn"].action_taken) == ("FAILED", "CONTINUED")


def test_unique_null_keys_pass(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y"), (None, "y"), (2, "z")], "a int, b string")
    got = _by_id(dq.evaluate_rules(df, [dq.Rule("u", "UNIQUE", column_name="a,b")]))
    assert (got["u"].rows_checked, got["u"].rows_passed, got["u"].rows_failed) == (5, 3, 2)


def test_range_from_bounds_and_regex(spark):
    df = spark.createDataFrame([(1.0, "A-1"), (10.0, "B-2"), (None, None)], "v double, s string")
    rules = [dq.Rule("r", "VALUE_RANGE", None, "v", "0|5"), dq.Rule("lo", "VALUE_RANGE", None, "v", "2|"),
             dq.Rule("re", "REGEX", column_name="s", expected_value="^A-")]
    got = _by_id(dq.evaluate_rules(df, rules))
    assert got["r"].rows_passed == 1 and got["lo"].rows_passed == 1 and got["re"].rows_passed == 1


def test_referential_skewed_child(spark):
    child = spark.createDataFrame([(1,)] * 50 + [(2,), (3,), (None,)], "k int")
    parent = spark.createDataFrame([(1,), (2,)], "pk int")
    got = _by_id(dq.evaluate_rules(child, [dq.Rule("ref", "REFERENTIAL", "parent.pk", "k")], {"parent": parent}))
    assert (got["ref"].rows_checked, got["ref"].rows_passed) == (53, 51)


def test_row_rules_share_one_scan(spark):
    cust = spark.read.parquet(f"{SF01}/customer.parquet")
    rules = [dq.Rule("a", "NOT_NULL", column_name="c_name"), dq.Rule("b", "CUSTOM", "c_acctbal > 0"),
             dq.Rule("c", "VALUE_RANGE", None, "c_acctbal", "-500|5000"), dq.Rule("d", "ROW_COUNT", expected_value="1")]
    res = dq.evaluate_rules(cust, rules)
    plan = res._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert res.count() == 4


def test_quarantine_and_gate(spark):
    cust = spark.read.parquet(f"{SF01}/customer.parquet")
    rules = [dq.Rule("acct", "CUSTOM", "c_acctbal > 0"), dq.Rule("dup", "UNIQUE", column_name="c_nationkey")]
    clean, rejected = dq.quarantine(cust, rules)
    assert clean.count() + rejected.count() == cust.count()
    assert rejected.filter(F.col("failed_rules").contains("acct")).count() == 122
    res = dq.evaluate_rules(cust, [dq.Rule("acct", "CUSTOM", "c_acctbal > 0", severity="ERROR")])
    assert dq.gate(res) is False
    res_ok = dq.evaluate_rules(cust, [dq.Rule("acct", "CUSTOM", "c_acctbal > 0", severity="WARN")])
    assert dq.gate(res_ok) is True


def test_broken_aggregate_and_keyed_rules_isolated(spark):
    df = spark.createDataFrame([(1,), (2,)], "a int")
    rules = [dq.Rule("rc_bad", "ROW_COUNT", "COUNT(nope) > 0"), dq.Rule("u_bad", "UNIQUE", column_name="zz"),
             dq.Rule("ref_bad", "REFERENTIAL", "missing_parent.k", "a"), dq.Rule("rc", "ROW_COUNT", "COUNT(*) > 1"),
             dq.Rule("ok", "NOT_NULL", column_name="a")]
    got = _by_id(dq.evaluate_rules(df, rules, {}))
    assert {k: v.status for k, v in got.items()} == {"rc_bad": "FAILED", "u_bad": "FAILED", "ref_bad": "FAILED",
                                                   "rc": "PASSED", "ok": "PASSED"}


def test_quarantine_keeps_columns_named_like_helpers(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "a", 6), (2, "b", -1)], "_run int, _u string, v int")
    clean, rejected = dq.quarantine(df, [dq.Rule("dup", "UNIQUE", column_name="_run,_u"),
                                         dq.Rule("pos", "CUSTOM", "v > 0")])
    assert clean.columns == ["_run", "_u", "v"] and clean.count() == 0
    assert {r.v: r.failed_rules for r in rejected.collect()} == {5: "dup", 6: "dup", -1: "pos"}


def test_quarantine_same_result_broadcast_or_shuffled(spark):
    rows = [(0, i % 3, None if i == 5 else i % 7) for i in range(40)] + [(k, 9, k) for k in range(1, 6)]
    df = spark.createDataFrame(rows, "k int, p int, ref int")
    parent = spark.createDataFrame([(v,) for v in range(0, 5)], "v int")
    rules = [dq.Rule("dup", "UNIQUE", column_name="k,p"), dq.Rule("ref", "REFERENTIAL", "par.v", "ref")]

    def run():
        _, rej = dq.quarantine(df, rules, {"par": parent})
        return sorted(map(tuple, rej.collect()), key=str)
    small = run()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert run() == small and small
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
