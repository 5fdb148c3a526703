"""Registered queries over rules as data, observed and declared schemas, and runs over time, each with its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.hashing import record_hash
from sluice.operators import audit, digests, ingest, observed, rule_table, sections, timeline
from sluice.plans import scenarios as sc
from sluice.plans.ingestion_run import in_partitions, touched_partitions
from sluice.sources.declared import read_declared
from sluice.sources.split_plan import split_plan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str):
    def deco(fn):
        QUERIES[name], ORACLE_SQL[name] = fn, sql
        return fn
    return deco


def _t(spark, sf_dir, name):
    return sc.table(spark, sf_dir, name)


# ---- C5, Q1-Q9: the rules of all objects as data ---------------------------------------------------

# Rules of seven objects (object, rule, type, column, expected value, severity); the last four cannot be judged.
ALL_RULES = [
    ("customer", "c1", "NOT_NULL", "c_name", None, "ERROR"), ("customer", "c2", "VALUE_RANGE", "c_acctbal", "-500|5000", "WARN"),
    ("customer", "c3", "REGEX", "c_mktsegment", "^[A-M]", "WARN"), ("customer", "c4", "UNIQUE", "c_custkey", None, "ERROR"),
    ("customer", "c5", "RANGE", "c_nationkey", "|20", "WARN"), ("lineitem", "l1", "UNIQUE", "l_orderkey, l_linenumber", None, "ERROR"),
    ("lineitem", "l2", "REFERENTIAL", "l_suppkey", "supplier.s_suppkey", "ERROR"), ("lineitem", "l3", "VALUE_RANGE", "l_discount", "0|0.08", "WARN"),
    ("lineitem", "l4", "REGEX", "l_returnflag", "^[AR]$", "WARN"), ("lineitem", "l5", "RANGE", "l_shipdate", "1995-01-01|1998-12-31 00:00:00", "WARN"),
    ("lineitem", "l6", "ROW_COUNT", None, "1000", "ERROR"), ("orders", "o1", "REFERENTIAL", "o_custkey", "customer.c_custkey", "ERROR"),
    ("orders", "o2", "RANGE", "o_totalprice", "1000.5|", "WARN"), ("orders", "o3", "NOT_NULL", "o_orderpriority", None, "ERROR"),
    ("part", "p1", "RANGE", "p_size", "abc|30", "WARN"), ("part", "p2", "ROW_COUNT", None, "100000000", "ERROR"), ("part", "p3", "REGEX", "p_name", "bolt|ring", "WARN"),
    ("documents", "d1", "REFERENTIAL", "doc_id", "labels.doc_id", "WARN"), ("documents", "d2", "NOT_NULL", "lang", None, "ERROR"),
    ("events", "e1", "RANGE", "event_type", "click|purchase", "WARN"), ("events", "e2", "UNIQUE", "user_id,event_type", None, "WARN"),
    ("events", "x1", "NOT_NULL", "no_such_column", None, "ERROR"), ("nowhere", "x2", "NOT_NULL", "a", None, "WARN"),
    ("events", "x3", "CUSTOM", "value", "1", "ERROR"), ("orders", "x4", "REFERENTIAL", "o_custkey", "customer.nothing", "ERROR"),
]
ALL_COLUMNS = {"customer": ["c_name", "c_acctbal", "c_mktsegment", "c_custkey", "c_nationkey"], "supplier": ["s_suppkey"], "labels": ["doc_id"],
               "lineitem": ["l_orderkey,l_linenumber", "l_suppkey", "l_discount", "l_returnflag", "l_shipdate"], "orders": ["o_custkey", "o_totalprice", "o_orderpriority"],
               "part": ["p_size", "p_name"], "documents": ["doc_id", "lang"], "events": ["event_type", "user_id,event_type", "value"]}


def _row_rule(table: str, rule: str, predicate: str) -> str:
    return f"SELECT '{table}' AS object_id, '{rule}' AS rule_id, count(*) AS n, count(*) FILTER (WHERE {predicate}) AS p FROM {table}"


def _unique_rule(table: str, rule: str, keys: str) -> str:
    return f"SELECT '{table}', '{rule}', sum(c), coalesce(sum(c) FILTER (WHERE c = 1 OR has_null), 0) FROM (SELECT count(*) AS c, bool_or(concat_ws(',', {keys}) IS NULL OR {' OR '.join(k + ' IS NULL' for k in keys.split(','))}) AS has_null FROM {table} GROUP BY {keys})"


_RULES_SQL = " UNION ALL ".join([
    _row_rule("customer", "c1", "c_name IS NOT NULL"), _row_rule("customer", "c2", "c_acctbal BETWEEN -500 AND 5000"), _row_rule("customer", "c3", "regexp_matches(c_mktsegment, '^[A-M]')"),
    _unique_rule("customer", "c4", "c_custkey"), _row_rule("customer", "c5", "c_nationkey <= 20"), _unique_rule("lineitem", "l1", "l_orderkey,l_linenumber"),
    _row_rule("lineitem", "l2", "l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey IS NOT NULL)"), _row_rule("lineitem", "l3", "l_discount BETWEEN 0 AND 0.08::DOUBLE"),
    _row_rule("lineitem", "l4", "regexp_matches(l_returnflag, '^[AR]$')"), _row_rule("lineitem", "l5", "l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1998-12-31'"),
    "SELECT 'lineitem', 'l6', count(*), CASE WHEN count(*) >= 1000 THEN count(*) ELSE 0 END FROM lineitem",
    _row_rule("orders", "o1", "o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey IS NOT NULL)"), _row_rule("orders", "o2", "o_totalprice >= 1000.5"),
    _row_rule("orders", "o3", "o_orderpriority IS NOT NULL"), _row_rule("part", "p1", "false"),
    "SELECT 'part', 'p2', count(*), CASE WHEN count(*) >= 100000000 THEN count(*) ELSE 0 END FROM part", _row_rule("part", "p3", "regexp_matches(p_name, 'bolt|ring')"),
    _row_rule("documents", "d1", "doc_id IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)"), _row_rule("documents", "d2", "lang IS NOT NULL"),
    _row_rule("events", "e1", "event_type BETWEEN 'click' AND 'purchase'"), _unique_rule("events", "e2", "user_id,event_type"),
    "SELECT * FROM (VALUES ('events', 'x1', NULL, NULL), ('nowhere', 'x2', NULL, NULL), ('events', 'x3', NULL, NULL), ('orders', 'x4', NULL, NULL))"])
_SEVERITY_SQL = ", ".join(f"('{r[0]}', '{r[1]}', '{r[5]}')" for r in ALL_RULES)


@register("rules_for_all_objects", f"""WITH c AS ({_RULES_SQL}), s(object_id, rule_id, severity) AS (VALUES {_SEVERITY_SQL}), r AS (
  SELECT c.*, severity, coalesce(CASE WHEN rule_id IN ('l6', 'p2') THEN p > 0 ELSE n = p END, false) AS ok FROM c JOIN s USING (object_id, rule_id))
SELECT object_id, rule_id, n::BIGINT AS rows_checked, p::BIGINT AS rows_passed, (n - p)::BIGINT AS rows_failed, round(p * 100.0::DOUBLE / nullif(n, 0), 4) AS pass_rate,
  CASE WHEN ok THEN 'PASSED' WHEN severity = 'WARN' THEN 'WARNING' ELSE 'FAILED' END AS status,
  CASE WHEN NOT ok AND severity = 'ERROR' THEN 'HALTED' ELSE 'CONTINUED' END AS action_taken,
  CASE rule_id WHEN 'x1' THEN 'no column no_such_column' WHEN 'x2' THEN 'no object nowhere' WHEN 'x3' THEN 'needs an expression' WHEN 'x4' THEN 'no parent column customer.nothing' END AS reason
FROM r""")
def rules_for_all_objects(spark, sf_dir):
    rules = spark.createDataFrame(ALL_RULES, "object_id string, rule_id string, rule_type string, column_name string, expected_value string, severity string")
    out = rule_table.rule_results({name: _t(spark, sf_dir, name) for name in ALL_COLUMNS}, rules, ALL_COLUMNS)
    return out.select("object_id", "rule_id", "rows_checked", "rows_passed", "rows_failed", "pass_rate", "status", "action_taken", "reason")


# ---- R1, S3: schemas from the data ---------------------------------------------------------------

_CLASS_SQL = r"""CASE WHEN v IS NULL THEN 0 WHEN lower(v) IN ('true', 'false') THEN 1
    WHEN regexp_full_match(v, '[+-]?[0-9]+') AND try_cast(v AS INTEGER) IS NOT NULL THEN 2 WHEN regexp_full_match(v, '[+-]?[0-9]+') AND try_cast(v AS BIGINT) IS NOT NULL THEN 4
    WHEN regexp_full_match(v, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN 8
    WHEN regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(v AS DATE) IS NOT NULL THEN 16
    WHEN regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,9})?)?') AND try_cast(v AS TIMESTAMP) IS NOT NULL THEN 32 ELSE 64 END"""


def _observed_values(spark, sf_dir):
    """Keys of the events' JSON (an object per event type; every seventh event also has a time, every third a note), and orders as a table of texts."""
    e = _t(spark, sf_dir, "events")
    more = F.concat(F.expr("substring(props, 1, length(props) - 1)"),
                    F.when(F.col("event_id") % 7 == 0, F.concat(F.lit(', "at": "'), F.to_date("ts").cast("string"), F.lit('"'))).otherwise(F.lit("")),
                    F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(', "note": '), F.when(F.col("user_id") % 2 == 0, F.lit("null")).otherwise(F.col("value").cast("string")))).otherwise(F.lit("")), F.lit("}"))
    e, o = e.withColumn("body", more), _t(spark, sf_dir, "orders")
    cells = o.select("o_orderkey", F.to_date("o_orderdate").alias("o_orderdate"), "o_orderpriority", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"))
    values = observed.json_values(e, "body", "event_type").unionByName(observed.column_values(cells, "orders"))
    sizes = e.groupBy(F.col("event_type").alias("object_id")).agg(F.count(F.lit(1)).alias("n")).unionByName(o.agg(F.count(F.lit(1)).alias("n")).select(F.lit("orders").alias("object_id"), "n"))
    return values, sizes


@register("schema_observed", f"""WITH v AS (
  SELECT event_type AS object_id, 'k' AS column_name, 0 AS pos, json_extract_string(props, '$.k') AS v FROM events
  UNION ALL SELECT event_type, 'at', 1, strftime(ts, '%Y-%m-%d') FROM events WHERE event_id % 7 = 0
  UNION ALL SELECT event_type, 'note', CASE WHEN event_id % 7 = 0 THEN 2 ELSE 1 END, CASE WHEN user_id % 2 <> 0 THEN value::VARCHAR END FROM events WHERE event_id % 3 = 0
  UNION ALL SELECT 'orders', 'o_orderkey', 0, o_orderkey::VARCHAR FROM orders UNION ALL SELECT 'orders', 'o_orderdate', 1, o_orderdate::DATE::VARCHAR FROM orders
  UNION ALL SELECT 'orders', 'o_orderpriority', 2, o_orderpriority FROM orders UNION ALL SELECT 'orders', 'o_orderstatus', 3, nullif(o_orderstatus, 'P') FROM orders
), g AS (SELECT object_id, column_name, bit_or({_CLASS_SQL}) AS c, min(pos) AS pos, count(v) AS n_values FROM v GROUP BY ALL),
s AS (SELECT event_type AS object_id, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'orders', count(*) FROM orders)
SELECT object_id, column_name, CASE WHEN c = 0 THEN 'VOID' WHEN c = 1 THEN 'BOOLEAN' WHEN c = 2 THEN 'INT' WHEN c & ~6 = 0 THEN 'BIGINT' WHEN c & ~14 = 0 THEN 'DOUBLE'
  WHEN c = 16 THEN 'DATE' WHEN c & ~48 = 0 THEN 'TIMESTAMP_NTZ' ELSE 'STRING' END AS data_type, n_values < n AS is_nullable,
  row_number() OVER (PARTITION BY object_id ORDER BY pos, column_name)::INTEGER AS column_order, n_values FROM g JOIN s USING (object_id)""")
def schema_observed(spark, sf_dir):
    values, sizes = _observed_values(spark, sf_dir)
    return observed.observed_schema(observed.partial_schema(values), sizes)


# Fixed value: the declared schema of the order lines below.
ORDER_LINE = T.StructType([T.StructField("o_orderkey", T.LongType(), False), T.StructField("o_totalprice", T.DoubleType()),
                           T.StructField("o_orderdate", T.DateType()), T.StructField("o_orderpriority", T.StringType(), False)])


def _order_lines(spark, sf_dir):
    """Orders as CSV lines.  Every seventh price is no number, every eleventh priority empty, every thirteenth line lacks its last two fields."""
    o, key = _t(spark, sf_dir, "orders"), F.col("o_orderkey")
    price = F.when(key % 7 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    whole = F.concat_ws(",", key.cast("string"), price, F.to_date("o_orderdate").cast("string"), F.when(key % 11 == 0, F.lit("")).otherwise(F.col("o_orderpriority")))
    return o.select(F.col("o_custkey"), F.when(key % 13 == 0, F.concat_ws(",", key.cast("string"), price)).otherwise(whole).alias("line"))


@register("read_declared", """SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS o_totalprice, o_orderdate::DATE AS o_orderdate, o_orderpriority FROM orders
WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0""")
def read_declared_good(spark, sf_dir):
    return read_declared(_order_lines(spark, sf_dir), "line", ORDER_LINE)[0]


@register("read_declared_rejected", """WITH l AS (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE printf('%.2f', o_totalprice) END AS p FROM orders
  WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0)
SELECT o_custkey, o_orderkey || ',' || p || CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE ',' || o_orderdate::DATE || ',' || CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderpriority END END AS line,
  concat_ws(',', CASE WHEN o_orderkey % 7 = 0 THEN 'o_totalprice:DOUBLE' END, CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN 'o_orderpriority:NULL' END) AS failed_rules FROM l""")
def read_declared_rejected(spark, sf_dir):
    return read_declared(_order_lines(spark, sf_dir), "line", ORDER_LINE)[1]


# ---- R2, R7: a column's versions -------------------------------------------------------------------

def _registrations(spark, sf_dir):
    """Every day each event type registers the columns that its users stand for; a column's type changes with the day's least value."""
    e = _t(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    g = e.groupBy("event_type", "day", "user_id").agg(F.min("value").alias("v"))
    return g.select(F.col("event_type").alias("object_id"), F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("column_name"),
                    F.when(F.col("v") < 5, "INT").when(F.col("v") < 12, "BIGINT").when(F.col("v") < 16, "DOUBLE").otherwise("STRING").alias("data_type"),
                    (F.col("user_id") % 2 == 0).alias("is_nullable"), F.col("day").alias("registered_at"))


_REGISTRATIONS_SQL = """reg AS (SELECT event_type AS object_id, 'c' || user_id AS column_name,
  CASE WHEN min(value) < 5 THEN 'INT' WHEN min(value) < 12 THEN 'BIGINT' WHEN min(value) < 16 THEN 'DOUBLE' ELSE 'STRING' END AS data_type, user_id % 2 = 0 AS is_nullable, ts::DATE AS day
  FROM events GROUP BY event_type, user_id, ts::DATE)"""


@register("schema_history", f"""WITH {_REGISTRATIONS_SQL}, run AS (
  SELECT object_id, day, row_number() OVER w AS run, lead(day) OVER w AS next_day FROM (SELECT DISTINCT object_id, day FROM reg) WINDOW w AS (PARTITION BY object_id ORDER BY day)),
isl AS (SELECT reg.*, run, next_day, run - row_number() OVER (PARTITION BY object_id, column_name, data_type, is_nullable ORDER BY run) AS island FROM reg JOIN run USING (object_id, day))
SELECT object_id, column_name, data_type, is_nullable, min(day) AS valid_from, max_by(struct_pack(x := next_day), run).x AS valid_to, count(*) AS runs
FROM isl GROUP BY object_id, column_name, data_type, is_nullable, island""")
def schema_history(spark, sf_dir):
    return observed.schema_history(_registrations(spark, sf_dir))


@register("evolve_type_fold", f"""WITH {_REGISTRATIONS_SQL}, g AS (SELECT object_id, column_name, list_sort(list(DISTINCT data_type)) AS t FROM reg GROUP BY ALL)
SELECT object_id, column_name, len(t)::BIGINT AS n_versions, CASE WHEN len(t) = 1 THEN t[1] WHEN t = ['BIGINT', 'INT'] THEN 'BIGINT' WHEN t = ['DOUBLE', 'INT'] THEN 'DOUBLE' END AS data_type,
  CASE WHEN len(t) = 1 OR t = ['BIGINT', 'INT'] OR t = ['DOUBLE', 'INT'] THEN 'EVOLVED' ELSE 'HALTED' END AS action_taken FROM g""")
def evolve_type_fold(spark, sf_dir):
    return observed.fold_types(_registrations(spark, sf_dir))


# ---- N7, A2: watermarks and runs over time -------------------------------------------------------

@register("watermark_as_of", """SELECT l.event_id AS lookup_id, l.user_id, l.ts, w.event_id, w.value FROM (SELECT * FROM events WHERE event_type = 'error') l
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) w
ON l.user_id = w.user_id AND l.ts >= w.ts""")
def watermark_as_of(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    history = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id", "value")
    lookups = e.where("event_type = 'error'").select(F.col("event_id").alias("lookup_id"), "user_id", "ts")
    return timeline.watermarks_as_of(history, lookups, ["user_id"], "ts", ["event_id", "value"], ["event_id"])


@register("watermark_latest", """SELECT user_id, ts, event_id, value, props FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def watermark_latest(spark, sf_dir):
    return timeline.latest_watermarks(_t(spark, sf_dir, "events").drop("event_type"), ["user_id"], ["ts", "event_id"])


def _timed_runs(spark, sf_dir):
    """Each event as a run of its user that lasts ``value`` minutes; runs of errors have no end."""
    e = _t(spark, sf_dir, "events")
    return e.select("user_id", "event_id", F.col("ts").alias("started"),
                    F.when(F.col("event_type") != "error", F.timestamp_add("SECOND", F.round(F.col("value") * 60).cast("int"), F.col("ts"))).alias("ended"))


_RUNS_SQL = "runs AS (SELECT user_id, event_id, ts AS started, CASE WHEN event_type <> 'error' THEN ts + to_seconds(round(value * 60)::INTEGER) END AS ended FROM events)"


@register("runs_overlapping", f"""WITH {_RUNS_SQL}, last AS (SELECT max(greatest(started, coalesce(ended, started))) + INTERVAL 1 MICROSECOND AS t FROM runs),
r AS (SELECT user_id, event_id, started, coalesce(ended, (SELECT t FROM last)) AS e FROM runs)
SELECT a.user_id, a.event_id AS earlier, b.event_id AS later, b.started AS overlap_from, least(a.e, b.e) AS overlap_to FROM r a JOIN r b
ON a.user_id = b.user_id AND b.started < a.e AND a.started < b.e AND a.started < a.e AND b.started < b.e AND (a.started < b.started OR (a.started = b.started AND a.event_id < b.event_id))""")
def runs_overlapping(spark, sf_dir):
    return timeline.overlapping_runs(_timed_runs(spark, sf_dir), ["user_id"], "event_id", "started", "ended", bin_seconds=6 * 3600)


@register("runs_at_once", f"""WITH {_RUNS_SQL}
SELECT a.user_id, a.event_id, a.started, count(*) AS running FROM runs a JOIN runs b ON a.user_id = b.user_id
AND (b.event_id = a.event_id OR ((b.started < a.started OR (b.started = a.started AND b.event_id < a.event_id)) AND (b.ended IS NULL OR b.ended > a.started OR (b.ended <= b.started AND b.started = a.started))))
GROUP BY ALL""")
def runs_at_once(spark, sf_dir):
    return timeline.runs_at_once(_timed_runs(spark, sf_dir), ["user_id"], "event_id", "started", "ended", grain="DAY")


# ---- N3, K7, S2, A4 --------------------------------------------------------------------------------

@register("digest_compare", """SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey, CASE WHEN t.o_orderkey IS NULL THEN 'INSERT' WHEN s.o_orderkey IS NULL THEN 'ABSENT' ELSE 'UPDATE' END AS change_type
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 500 = 2 THEN o_totalprice + 1 ELSE o_totalprice END AS p FROM orders WHERE o_orderkey % 500 <> 1) s
FULL OUTER JOIN (SELECT o_orderkey, o_totalprice AS p FROM orders WHERE o_orderkey % 500 <> 0) t ON s.o_orderkey = t.o_orderkey
WHERE s.o_orderkey IS NULL OR t.o_orderkey IS NULL OR s.p <> t.p""")
def digest_compare(spark, sf_dir):
    """Two versions of orders that differ in one order of some 170."""
    o, key = _t(spark, sf_dir, "orders"), F.col("o_orderkey")
    new = o.where(key % 500 != 1).withColumn("o_totalprice", F.when(key % 500 == 2, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    source, target = (df.withColumn("record_hash", record_hash(sc.ORDER_HASH_COLUMNS)) for df in (new, o.where(key % 500 != 0)))
    return digests.changed_rows(source, target, ["o_orderkey"])


@register("merge_partition_move", """WITH b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 2 THEN '1-URGENT' ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 10 = 2 AND o_orderpriority IN ('2-HIGH', '3-MEDIUM')),
t AS (SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority <> '2-HIGH' OR o_orderkey % 10 = 2),
parts AS (SELECT o_orderpriority FROM b UNION SELECT t.o_orderpriority FROM t JOIN b USING (o_orderkey))
SELECT o_orderkey, o_orderpriority FROM b UNION ALL SELECT o_orderkey, o_orderpriority FROM t WHERE o_orderpriority IN (SELECT o_orderpriority FROM parts) AND o_orderkey NOT IN (SELECT o_orderkey FROM b)""")
def merge_partition_move(spark, sf_dir):
    """A target partitioned by priority; the batch moves orders of two priorities to a third, which empties one of them.

    The rows of the partitions that the merge rewrites: those of the batch, and those where its keys are today.
    """
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    moved = o.where("o_orderkey % 10 = 2 AND o_orderpriority IN ('2-HIGH', '3-MEDIUM')").withColumn("o_orderpriority", F.lit("1-URGENT"))
    target = o.where("o_orderpriority <> '2-HIGH' OR o_orderkey % 10 = 2")
    batch, target = (df.withColumn("record_hash", record_hash(["o_orderpriority"])) for df in (moved, target))
    touched = touched_partitions(batch, target, ["o_orderkey"], ["o_orderpriority"])
    return ingest.merge_snapshot(batch, in_partitions(target, touched, ["o_orderpriority"]), ["o_orderkey"]).select("o_orderkey", "o_orderpriority")


@register("jdbc_split_plan", "SELECT count(*) AS rows_covered, count(*) FILTER (WHERE ts IS NULL) AS rows_without_key, 17::BIGINT AS parts, true AS even FROM events")
def jdbc_split_plan(spark, sf_dir):
    """A sixteen-way plan over the events' times, and what its predicates cover: every row once, none with over 1.1 times its share."""
    e = _t(spark, sf_dir, "events").select("ts")
    plan = split_plan(e, "ts", 16)
    cuts = plan.where("part >= 0").agg(F.collect_list("high")).scalar()  # NULL, the last part's high, is not listed
    e = e.withColumn("cuts", cuts)
    part = F.size(F.filter("cuts", lambda c: c <= F.col("ts")))
    counts = e.groupBy(F.when(F.col("ts").isNull(), F.lit(-1)).otherwise(part).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    both = plan.join(counts, "part", "left")
    total, most = F.sum("n"), F.max(F.when(F.col("part") >= 0, F.col("n")))
    return both.agg(total.alias("rows_covered"), F.coalesce(F.max(F.when(F.col("part") == -1, F.col("n"))), F.lit(0)).alias("rows_without_key"), F.count(F.lit(1)).alias("parts"),
                    (most <= total / 16 * 1.1).alias("even"))


@register("object_metrics_config", """WITH m AS (SELECT user_id AS run_id, event_type AS object_id, count(*) AS rows_read, count(*) FILTER (WHERE value <= 0.05) AS rows_rejected FROM events GROUP BY ALL),
c AS (SELECT event_type AS object_id, max(props) AS target_table, CASE WHEN max(value) > 100 THEN 'hash_incremental' ELSE 'full_load' END AS load_type FROM events WHERE event_type <> 'view' GROUP BY 1)
SELECT m.*, CASE WHEN rows_rejected = 0 THEN 'SUCCESS' ELSE 'FAILED' END AS status, target_table, load_type FROM m LEFT JOIN c USING (object_id)""")
def object_metrics_config(spark, sf_dir):
    """Metrics with their object's config; views have no config row."""
    e = _t(spark, sf_dir, "events")
    objects = e.where("event_type <> 'view'").groupBy(F.col("event_type").alias("object_id")).agg(
        F.max("props").alias("target_table"), F.when(F.max("value") > 100, "hash_incremental").otherwise("full_load").alias("load_type"))
    return audit.object_metrics(e, {"run_id": "user_id", "object_id": "event_type"}, F.col("value") <= 0.05, objects)


# ---- S4, S5: configuration documents ---------------------------------------------------------------

def _documents(spark, sf_dir):
    """One config document per customer: its orders as source objects; some lack a section, hold an empty or a wrong one, or are cut off."""
    o, key = _t(spark, sf_dir, "orders"), F.col("o_custkey")
    entry = F.struct(F.col("o_orderkey").alias("source_object"), F.col("o_orderpriority").alias("load_type"), F.round("o_totalprice", 2).alias("load_order"))
    g = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(entry)).alias("objects"))
    objects = F.concat(F.lit('"source_objects": '), F.to_json("objects"))
    settings = (F.when(key % 5 == 0, F.lit("")).when(key % 7 == 0, F.lit(', "pipeline_config": []')).when(key % 11 == 0, F.lit(', "pipeline_config": {"a": 1}'))
                .otherwise(F.lit(', "pipeline_config": [{"config_key": "batch_size"}, {"config_key": "max_retry"}]')))
    return g.select("o_custkey", F.concat(F.lit("{"), objects, settings, F.when(key % 13 == 0, F.lit("")).otherwise(F.lit("}"))).alias("document"))


@register("config_document_sections", """WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT o_custkey, 'source_objects' AS section, CASE WHEN o_custkey % 13 = 0 THEN 'MALFORMED' ELSE 'PRESENT' END AS status, CASE WHEN o_custkey % 13 <> 0 THEN n END AS n_entries FROM c
UNION ALL SELECT o_custkey, 'pipeline_config', CASE WHEN o_custkey % 13 = 0 THEN 'MALFORMED' WHEN o_custkey % 5 = 0 THEN 'MISSING' WHEN o_custkey % 7 = 0 THEN 'EMPTY' WHEN o_custkey % 11 = 0 THEN 'NO_LIST' ELSE 'PRESENT' END,
  CASE WHEN o_custkey % 13 = 0 OR o_custkey % 5 = 0 THEN NULL WHEN o_custkey % 7 = 0 THEN 0 WHEN o_custkey % 11 = 0 THEN NULL ELSE 2 END FROM c""")
def config_document_sections(spark, sf_dir):
    return sections.section_check(_documents(spark, sf_dir), "o_custkey", "document", ["source_objects", "pipeline_config"])


@register("config_document_entries", """SELECT o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INTEGER AS position, o_orderkey AS source_object, o_orderpriority AS load_type,
  round(o_totalprice, 2) AS load_order FROM orders WHERE o_custkey % 13 <> 0""")
def config_document_entries(spark, sf_dir):
    return sections.section_entries(_documents(spark, sf_dir), "o_custkey", "document", "source_objects",
                                    {"source_object": "bigint", "load_type": "string", "load_order": "double"})
