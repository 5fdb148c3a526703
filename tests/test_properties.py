"""Property tests: invariants checked against brute force on generated inputs."""

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from sluice.functions.hashing import record_hash
from sluice.functions.ranking import sequence_within_groups
from sluice.operators import dq, ingest, seed

SETTINGS = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

rows = st.lists(st.tuples(st.integers(0, 40), st.sampled_from(["a", "b", "c", None]), st.integers(-5, 5)),
                min_size=0, max_size=60)


def _hashed(spark, data):
    df = spark.createDataFrame(data, "k int, v string, n int").dropDuplicates(["k"])
    return df.withColumn("record_hash", record_hash(["v", "n"]))


@SETTINGS
@given(old=rows, new=rows)
def test_merge_then_classify_is_quiet(spark, old, new):
    src, tgt = _hashed(spark, new), _hashed(spark, old)
    merged = ingest.merge_snapshot(src, tgt, ["k"])
    counts = ingest.change_counts(ingest.classify(src, merged, ["k"])).first()
    assert counts.rows_inserted == 0 and counts.rows_updated == 0
    keys = {r.k for r in src.select("k").collect()} | {r.k for r in tgt.select("k").collect()}
    assert merged.count() == len(keys)


@SETTINGS
@given(data=st.lists(st.tuples(st.sampled_from([0, 0, 0, 1, 2, 3, None]), st.integers(0, 9)), max_size=80),
       parts=st.integers(1, 12))
def test_sequence_equals_row_number(spark, data, parts):
    df = spark.createDataFrame([(g, o, i) for i, (g, o) in enumerate(data)], "g int, o int, u int")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = sequence_within_groups(df, ["g"], ["o", "u"]).select("u", "seq")
        got = sorted(map(tuple, got.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    want = df.withColumn("seq", F.row_number().over(Window.partitionBy("g").orderBy("o", "u"))).select("u", "seq")
    assert got == sorted(map(tuple, want.collect()))


@SETTINGS
@given(batch=st.lists(st.tuples(st.sampled_from(["x", "y", "z", None]), st.integers(0, 3)), max_size=40),
       existing=st.lists(st.sampled_from(["x", "y", "w"]), max_size=5))
def test_seed_outcomes_add_up(spark, batch, existing):
    b = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(batch)], "k string, v int, pos int")
    e = spark.createDataFrame([(k,) for k in existing], "k string")
    out = {r.outcome: r.n for r in seed.seed_outcome(b, e, ["k"]).collect()}
    assert sum(out.values()) == len(batch)
    new_keys = {k for k, _ in batch if k is not None} - set(existing)
    assert out.get("inserted", 0) == len(new_keys)
    ins = seed.insert_if_absent(b, e, ["k"], "pos").collect()
    first = {}
    for i, (k, v) in enumerate(batch):
        if k is not None and k not in first:
            first[k] = (v, i)
    assert {(r.k, r.v, r.pos) for r in ins} == {(k, *first[k]) for k in new_keys}


@SETTINGS
@given(data=rows)
def test_dq_counts_match_brute_force(spark, data):
    df = spark.createDataFrame(data, "k int, v string, n int")
    rules = [dq.Rule("nn", "NOT_NULL", column_name="v"), dq.Rule("pos", "CUSTOM", "n > 0"),
             dq.Rule("rng", "VALUE_RANGE", None, "n", "-2|2"), dq.Rule("u", "UNIQUE", column_name="k,v")]
    got = {r.rule_id: (r.rows_checked, r.rows_passed) for r in dq.evaluate_rules(df, rules).collect()}
    pdf = pd.DataFrame(data, columns=["k", "v", "n"])
    n = len(pdf)
    from collections import Counter
    seen = Counter((k, v) for k, v, _ in data if k is not None and v is not None)
    unique_ok = sum(1 for k, v, _ in data if k is None or v is None or seen[(k, v)] == 1)
    assert got["nn"] == (n, int(pdf["v"].notna().sum()) if n else 0)
    assert got["pos"] == (n, int((pdf["n"] > 0).sum()) if n else 0)
    assert got["rng"] == (n, int(pdf["n"].between(-2, 2).sum()) if n else 0)
    assert got["u"] == (n, unique_ok)


cols = st.dictionaries(st.sampled_from(["a", "b", "c", "d", "e"]),
                       st.tuples(st.sampled_from(["INT", "BIGINT", "STRING", "FLOAT", "DOUBLE"]), st.booleans()),
                       max_size=5)


@SETTINGS
@given(reg=cols, cur=cols)
def test_drift_events_match_brute_force(spark, reg, cur):
    from sluice.operators import drift
    schema = "object_id string, column_name string, data_type string, is_nullable boolean"
    r = spark.createDataFrame([("o", c, t, n) for c, (t, n) in reg.items()], schema)
    c_ = spark.createDataFrame([("o", c, t, n) for c, (t, n) in cur.items()], schema)
    got = {(x.column_name, x.drift_type, x.old_value, x.new_value) for x in drift.detect_drift(r, c_).collect()}
    want = set()
    for name in set(reg) | set(cur):
        if name not in reg:
            want.add((name, "NEW_COLUMN", None, cur[name][0]))
        elif name not in cur:
            want.add((name, "DROPPED_COLUMN", reg[name][0], None))
        else:
            if reg[name][0] != cur[name][0]:
                want.add((name, "TYPE_CHANGE", reg[name][0], cur[name][0]))
            if reg[name][1] != cur[name][1]:
                want.add((name, "NULLABLE_CHANGE", str(reg[name][1]).lower(), str(cur[name][1]).lower()))
    assert got == want


specs = st.dictionaries(st.sampled_from(["m1", "m2", "m3", "m4"]),
                        st.tuples(st.sampled_from(["all", "full_load", "hash_incremental"]), st.booleans()),
                        max_size=4)


@SETTINGS
@given(defaults=specs, own=st.dictionaries(st.sampled_from(["p1", "p2"]), specs, max_size=2),
       load_type=st.sampled_from(["full_load", "hash_incremental"]))
def test_metadata_override_matches_brute_force(spark, defaults, own, load_type):
    from sluice.operators import config
    rows = [("default", c, a, 1, act) for c, (a, act) in defaults.items()]
    rows += [(p, c, a, 2, act) for p, cs in own.items() for c, (a, act) in cs.items()]
    cfg = spark.createDataFrame(rows, "pipeline_id string, column_name string, applies_to string, "
                                      "column_order int, active_flag boolean")
    pipes = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "pipeline_id string")
    got = {(r.pipeline_id, r.column_name) for r in config.effective_metadata(cfg, pipes, load_type).collect()}
    want = set()
    for p in ("p1", "p2", "p3"):
        merged = dict(defaults)
        merged.update(own.get(p, {}))  # the pipeline's own row wins, active or not
        want |= {(p, c) for c, (a, act) in merged.items() if act and a in ("all", load_type)}
    assert got == want


@SETTINGS
@given(events=st.lists(st.tuples(st.sampled_from(["p", "q"]), st.sampled_from(["a", "b"]),
                                 st.sampled_from(["1", "22", "x", " 7"]), st.booleans(), st.integers(0, 50)),
                       max_size=25, unique_by=lambda e: (e[0], e[1], e[4])))
def test_settings_latest_active_value_wins(spark, events):
    from sluice.operators import config
    df = spark.createDataFrame(events, "pipeline_id string, config_key string, config_value string, "
                                       "active_flag boolean, ts int")
    got = {r.pipeline_id: (r.a, r.b) for r in
           config.pipeline_settings(df, {"a": "int", "b": "int"}, order_cols=["ts"]).collect()}
    latest = {}
    for p, k, v, act, ts in events:
        if act and ((p, k) not in latest or ts > latest[(p, k)][0]):
            latest[(p, k)] = (ts, v)

    def typed(v):
        v = v.strip()
        return int(v) if v.lstrip("-").isdigit() else None
    want = {}
    for (p, k), (_, v) in latest.items():
        want.setdefault(p, {"a": None, "b": None})[k] = typed(v)
    assert got == {p: (d["a"], d["b"]) for p, d in want.items()}
