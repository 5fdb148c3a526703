"""DuckDB SQL equal in result to each registered query (the correctness oracle)."""

from __future__ import annotations

_SRC_TGT = """src AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 10 = 2 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 10 <> 1),
  tgt AS (SELECT * FROM orders WHERE o_orderkey % 10 <> 0),
  s AS (SELECT *, sha256(concat_ws('|', o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)) AS record_hash FROM src),
  t AS (SELECT *, sha256(concat_ws('|', o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)) AS record_hash FROM tgt)"""

_PART_TYPE = ("CASE p_type WHEN 'ECONOMY' THEN 'INT' WHEN 'LARGE' THEN 'STRING' WHEN 'MEDIUM' THEN 'DATE' "
              "WHEN 'PROMO' THEN 'BIGINT' WHEN 'SMALL' THEN 'FLOAT' WHEN 'STANDARD' THEN 'INT' END")

_REG_CUR = f"""reg AS (SELECT p_brand AS object_id, 'c' || p_partkey AS column_name, {_PART_TYPE} AS data_type, p_size < 25 AS is_nullable, p_size AS column_order FROM part WHERE p_size <= 45),
  cur0 AS (SELECT p_brand AS object_id, 'c' || p_partkey AS column_name, {_PART_TYPE} AS base, p_name, p_size FROM part WHERE p_size >= 5),
  cur AS (SELECT object_id, column_name, CASE WHEN p_name LIKE '%bolt%' THEN CASE base WHEN 'INT' THEN 'BIGINT' WHEN 'FLOAT' THEN 'DOUBLE' WHEN 'STRING' THEN 'INT' WHEN 'DATE' THEN 'TIMESTAMP' WHEN 'BIGINT' THEN 'STRING' END ELSE base END AS data_type, p_size < 30 AS is_nullable, p_size AS column_order FROM cur0)"""

_DRIFT = f"""{_REG_CUR},
  j AS (SELECT coalesce(r.object_id, c.object_id) AS object_id, coalesce(r.column_name, c.column_name) AS column_name, r.data_type AS rt, c.data_type AS ct, r.is_nullable AS rn, c.is_nullable AS cn FROM reg r FULL OUTER JOIN cur c ON r.object_id = c.object_id AND r.column_name = c.column_name),
  d AS (SELECT object_id, column_name, 'NEW_COLUMN' AS drift_type, CAST(NULL AS VARCHAR) AS old_value, ct AS new_value FROM j WHERE rt IS NULL
    UNION ALL SELECT object_id, column_name, 'DROPPED_COLUMN', rt, CAST(NULL AS VARCHAR) FROM j WHERE ct IS NULL
    UNION ALL SELECT object_id, column_name, 'TYPE_CHANGE', rt, ct FROM j WHERE rt <> ct
    UNION ALL SELECT object_id, column_name, 'NULLABLE_CHANGE', CAST(rn AS VARCHAR), CAST(cn AS VARCHAR) FROM j WHERE rn <> cn)"""

_WIDENING_SQL = ("('TINYINT>SMALLINT','TINYINT>INT','TINYINT>BIGINT','SMALLINT>INT','SMALLINT>BIGINT','INT>BIGINT',"
                 "'INT>DOUBLE','FLOAT>DOUBLE','DATE>TIMESTAMP','DATE>TIMESTAMP_NTZ')")

_RUN_TS = "TIMESTAMP '2024-02-01 00:00:00'"

ORACLE_SQL: dict[str, str] = {
    "record_hash": "SELECT o_orderkey, sha256(concat_ws('|', o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)) AS record_hash FROM orders",

    "record_hash_all_columns": "SELECT event_id, sha256(concat_ws('|', event_id, ts, user_id, event_type, value, props)) AS record_hash FROM events",

    "record_hash_strict": """WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, nullif(o_orderpriority, '5-LOW') AS o_orderpriority FROM orders)
SELECT o_orderkey, sha256(concat_ws(chr(1), coalesce(CAST(o_custkey AS VARCHAR), chr(0)), coalesce(CAST(o_orderstatus AS VARCHAR), chr(0)), coalesce(CAST(o_totalprice AS VARCHAR), chr(0)), coalesce(CAST(o_orderdate AS VARCHAR), chr(0)), coalesce(CAST(o_orderpriority AS VARCHAR), chr(0)))) AS record_hash FROM o""",

    "change_classify": f"""WITH {_SRC_TGT}
SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey, CASE WHEN t.o_orderkey IS NULL THEN 'INSERT' WHEN s.o_orderkey IS NULL THEN 'ABSENT' WHEN s.record_hash <> t.record_hash THEN 'UPDATE' ELSE 'UNCHANGED' END AS change_type FROM s FULL OUTER JOIN t ON s.o_orderkey = t.o_orderkey""",

    "merge_key_check": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 OR l_orderkey IS NULL OR l_linenumber IS NULL",

    "merge_upsert": f"""WITH {_SRC_TGT}
SELECT * FROM s
  UNION ALL SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.o_orderkey = t.o_orderkey)""",

    "merge_keep_metadata": f"""WITH {_SRC_TGT}
SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey, CASE WHEN t.o_orderkey IS NULL OR s.record_hash <> t.record_hash THEN s.o_totalprice ELSE t.o_totalprice END AS o_totalprice, CASE WHEN t.o_orderkey IS NULL OR s.record_hash <> t.record_hash THEN 'run_2' ELSE 'run_1' END AS load_run_id FROM s FULL OUTER JOIN t ON s.o_orderkey = t.o_orderkey""",

    "merge_metrics": f"""WITH {_SRC_TGT}
SELECT count(s.o_orderkey) AS rows_read, count(*) FILTER (WHERE t.o_orderkey IS NULL) AS rows_inserted, count(*) FILTER (WHERE s.record_hash <> t.record_hash) AS rows_updated, count(*) FILTER (WHERE s.o_orderkey IS NULL) AS rows_deleted, count(*) FILTER (WHERE s.record_hash = t.record_hash) AS rows_unchanged FROM s FULL OUTER JOIN t ON s.o_orderkey = t.o_orderkey""",

    "soft_delete": f"""WITH {_SRC_TGT}
SELECT t.o_orderkey, s.o_orderkey IS NULL AS is_deleted FROM t LEFT JOIN s ON s.o_orderkey = t.o_orderkey""",

    "merge_soft_delete": f"""WITH {_SRC_TGT}
SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey, CASE WHEN t.o_orderkey IS NULL OR (s.o_orderkey IS NOT NULL AND s.record_hash <> t.record_hash) THEN 'run_2' ELSE 'run_1' END AS load_run_id, s.o_orderkey IS NULL AS is_deleted, CASE WHEN t.o_orderkey IS NULL THEN 'INSERT' WHEN s.o_orderkey IS NULL THEN 'ABSENT' WHEN s.record_hash <> t.record_hash THEN 'UPDATE' ELSE 'UNCHANGED' END AS change_type FROM s FULL OUTER JOIN t ON s.o_orderkey = t.o_orderkey""",

    "watermark_advance": "SELECT user_id AS object_id, max(ts) AS last_run_ts, max_by(event_id, (ts, event_id)) AS last_run_id, count(*) AS rows_last_loaded FROM events WHERE event_type <> 'error' GROUP BY user_id",

    "incremental_extract": """WITH wm AS (SELECT user_id, max(ts) AS w FROM events WHERE event_type = 'purchase' AND user_id % 5 <> 0 GROUP BY user_id)
SELECT e.event_id, e.user_id, e.ts FROM events e LEFT JOIN wm ON e.user_id = wm.user_id WHERE wm.w IS NULL OR e.ts >= wm.w""",

    "incremental_extract_nulls": """WITH e AS (SELECT event_id, user_id, CASE WHEN event_type <> 'error' THEN ts END AS ts FROM events),
  wm AS (SELECT user_id, max(ts) AS w FROM e GROUP BY user_id)
SELECT e.event_id, e.user_id, e.ts FROM e LEFT JOIN wm ON e.user_id = wm.user_id WHERE e.ts IS NULL OR wm.w IS NULL OR e.ts >= wm.w""",

    "merge_dropped_column": f"""WITH {_SRC_TGT}
SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey, CASE WHEN s.o_orderkey IS NULL OR s.record_hash = t.record_hash THEN t.o_orderpriority END AS o_orderpriority FROM s FULL OUTER JOIN t ON s.o_orderkey = t.o_orderkey""",

    "soft_delete_counts": f"""WITH {_SRC_TGT}
SELECT CASE WHEN t.o_orderkey IS NULL THEN 'INSERT' WHEN s.o_orderkey IS NULL THEN CASE WHEN t.o_custkey % 3 = 0 THEN 'UNCHANGED' ELSE 'ABSENT' END WHEN s.record_hash <> t.record_hash THEN 'UPDATE' ELSE 'UNCHANGED' END AS change_type, s.o_orderkey IS NULL AS is_deleted, count(*) AS n FROM s FULL OUTER JOIN t ON s.o_orderkey = t.o_orderkey GROUP BY 1, 2""",

    "resolve_null_id": """SELECT l.l_suppkey, count(*) AS n, CASE WHEN s.s_acctbal > 0 THEN 'resolved' ELSE 'dropped' END AS outcome FROM lineitem l LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY 1, 3""",

    "incremental_extract_single": "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-15 12:00:00'",

    "watermark_hash": "SELECT o_custkey AS object_id, max(o_orderdate) AS watermark_value, sha256(CAST(max(o_orderdate) AS VARCHAR)) AS watermark_hash FROM orders GROUP BY o_custkey",

    "metadata_inject": f"SELECT o_orderkey, sha256(concat_ws('|', o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)) AS record_hash, {_RUN_TS} AS ingestion_timestamp, 'run_1' AS load_run_id, 'tpch' AS source_system, 'orders' AS source_object FROM orders",

    "full_load_snapshot": f"SELECT *, {_RUN_TS} AS ingestion_timestamp, 'run_1' AS load_run_id, 'tpch' AS source_system, 'customer' AS source_object FROM customer",

    "active_objects": "SELECT 'p' || s_nationkey AS pipeline_id, s_suppkey AS object_id, CAST(floor(s_acctbal / 1000) AS INT) + 1 AS load_order FROM supplier WHERE s_acctbal > 0 ORDER BY 1, 3, 2",

    "pipeline_config_pivot": """WITH cfg AS (SELECT 'u' || user_id AS pipeline_id, event_type AS config_key, CASE WHEN event_type = 'error' THEN 'n/a' ELSE json_extract_string(props, '$.k') END AS config_value, value >= 1.0 AS active_flag, ts, event_id FROM events),
  latest AS (SELECT pipeline_id, config_key, config_value FROM (SELECT *, row_number() OVER (PARTITION BY pipeline_id, config_key ORDER BY ts DESC, event_id DESC) AS rn FROM cfg WHERE active_flag AND config_key IN ('click', 'purchase', 'error')) WHERE rn = 1)
SELECT pipeline_id, max(CASE WHEN config_key = 'click' THEN try_cast(config_value AS INT) END) AS click, max(CASE WHEN config_key = 'purchase' THEN try_cast(config_value AS INT) END) AS purchase, max(CASE WHEN config_key = 'error' THEN try_cast(config_value AS INT) END) AS "error" FROM latest GROUP BY pipeline_id""",

    "metadata_override": """WITH d(pipeline_id, column_name, applies_to, column_order, active_flag) AS (VALUES ('default', 'record_hash', 'hash_incremental', 1, true), ('default', 'ingestion_timestamp', 'all', 2, true), ('default', 'load_run_id', 'all', 3, true), ('default', 'source_system', 'all', 4, true), ('default', 'source_object', 'all', 5, true)),
  o AS (SELECT 'p' || o_custkey AS pipeline_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'source_system' WHEN '2-HIGH' THEN 'load_run_id' ELSE 'batch_' || substr(o_orderpriority, 1, 1) END AS column_name, CASE WHEN o_orderstatus = 'F' THEN 'hash_incremental' ELSE 'all' END AS applies_to, CAST(substr(o_orderpriority, 1, 1) AS INT) + 5 AS column_order, o_orderstatus <> 'P' AS active_flag, o_orderkey FROM orders),
  own AS (SELECT pipeline_id, column_name, applies_to, column_order, active_flag FROM (SELECT *, row_number() OVER (PARTITION BY pipeline_id, column_name ORDER BY o_orderkey) AS rn FROM o) WHERE rn = 1),
  pipes AS (SELECT DISTINCT 'p' || c_custkey AS pipeline_id FROM customer),
  eff AS (SELECT * FROM own WHERE pipeline_id IN (SELECT pipeline_id FROM pipes)
    UNION ALL SELECT p.pipeline_id, d.column_name, d.applies_to, d.column_order, d.active_flag FROM pipes p JOIN d ON d.pipeline_id = 'default' WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.pipeline_id = p.pipeline_id AND own.column_name = d.column_name))
SELECT pipeline_id, column_name, column_order FROM eff WHERE active_flag AND applies_to IN ('all', 'full_load')""",

    "resolve_object_id": "SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, s.s_suppkey AS object_id FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey AND s.s_nationkey < 10",

    "resolve_dropped": "SELECT l.l_suppkey, count(*) AS dropped FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = l.l_suppkey AND s.s_nationkey < 10) GROUP BY l.l_suppkey",

    "expand_list_columns": """WITH c AS (SELECT p_partkey AS object_id, string_split(replace(p_name, ' ', ', '), ',') AS parts FROM part),
  x AS (SELECT object_id, parts, unnest(generate_series(1, len(parts))) AS pos FROM c)
SELECT object_id, CAST(pos AS INT) AS position, trim(parts[pos]) AS column_name FROM x WHERE trim(parts[pos]) <> ''""",

    "seed_insert_new": """WITH existing AS (SELECT * FROM orders WHERE o_orderkey % 3 = 0),
  batch AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderkey % 3 <> 0)
SELECT b.o_orderkey, b.o_custkey, b.o_orderpriority FROM batch b WHERE b.rn = 1 AND NOT EXISTS (SELECT 1 FROM existing e WHERE e.o_custkey = b.o_custkey AND e.o_orderpriority = b.o_orderpriority)""",

    "seed_outcome": """WITH existing AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 3 = 0),
  batch AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderkey % 3 <> 0)
SELECT CASE WHEN e.o_custkey IS NULL AND b.rn = 1 THEN 'inserted' ELSE 'skipped' END AS outcome, count(*) AS n FROM batch b LEFT JOIN existing e ON e.o_custkey = b.o_custkey AND e.o_orderpriority = b.o_orderpriority GROUP BY 1""",

    "dq_not_null": "SELECT count(*) AS rows_checked, count(nullif(o_orderpriority, '5-LOW')) AS rows_passed, count(*) - count(nullif(o_orderpriority, '5-LOW')) AS rows_failed FROM orders",

    "dq_unique": """WITH g AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT CAST(sum(n) AS BIGINT) AS rows_checked, CAST(sum(CASE WHEN n = 1 THEN n ELSE 0 END) AS BIGINT) AS rows_passed, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS rows_failed FROM g""",

    "dq_row_count": "SELECT count(*) AS rows_checked, CASE WHEN count(*) >= 1 THEN 'PASSED' ELSE 'FAILED' END AS status FROM orders",

    "dq_value_range": "SELECT count(*) AS rows_checked, count(*) FILTER (WHERE c_acctbal > 0) AS rows_passed, count(*) - count(*) FILTER (WHERE c_acctbal > 0) AS rows_failed, round(100.0::DOUBLE * count(*) FILTER (WHERE c_acctbal > 0) / nullif(count(*), 0), 4) AS pass_rate FROM customer",

    "dq_regex": "SELECT count(*) AS rows_checked, count(*) FILTER (WHERE regexp_matches(o_orderpriority, '^[1-3]-')) AS rows_passed FROM orders",

    "dq_referential": "SELECT count(*) AS rows_checked, count(l.doc_id) AS rows_passed, count(*) - count(l.doc_id) AS rows_failed FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id",

    "dq_results": """WITH r AS (SELECT count(*) AS n, count(*) FILTER (WHERE c_name IS NOT NULL) AS p1, count(*) FILTER (WHERE c_acctbal > 0) AS p2, count(*) FILTER (WHERE c_acctbal >= -500 AND c_acctbal <= 5000) AS p3 FROM customer),
  u AS (SELECT 'name_not_null' AS rule_id, 'ERROR' AS severity, n, p1 AS p FROM r
  UNION ALL SELECT 'acctbal_positive', 'WARN', n, p2 FROM r
  UNION ALL SELECT 'acctbal_range', 'ERROR', n, p3 FROM r
  UNION ALL SELECT 'min_rows', 'ERROR', n, CASE WHEN n >= 1 THEN n ELSE 0 END FROM r)
SELECT rule_id, n AS rows_checked, p AS rows_passed, n - p AS rows_failed, round(100.0::DOUBLE * p / nullif(n, 0), 4) AS pass_rate, CASE WHEN p = n THEN 'PASSED' WHEN severity = 'WARN' THEN 'WARNING' ELSE 'FAILED' END AS status, CASE WHEN p < n AND severity = 'ERROR' THEN 'HALTED' ELSE 'CONTINUED' END AS action_taken FROM u""",

    "dq_quarantine": "SELECT c_custkey, concat_ws(',', CASE WHEN coalesce(c_acctbal > 0, false) THEN NULL ELSE 'acctbal_positive' END, CASE WHEN coalesce(c_mktsegment <> 'BUILDING', false) THEN NULL ELSE 'segment_allowed' END) AS failed_rules FROM customer WHERE NOT coalesce(c_acctbal > 0, false) OR NOT coalesce(c_mktsegment <> 'BUILDING', false)",

    "dq_results_all_types": """WITH s AS (SELECT (SELECT count(*) FROM lineitem) AS n,
    (SELECT count(*) FROM lineitem WHERE l_shipdate IS NOT NULL) AS p1,
    (SELECT coalesce(CAST(sum(c) AS BIGINT), 0) FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber) WHERE c = 1) AS p2,
    (SELECT count(*) FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 20)) AS p3,
    (SELECT count(*) FROM lineitem WHERE regexp_matches(l_returnflag, '^[AR]$')) AS p4,
    (SELECT count(*) FROM lineitem WHERE l_discount >= 0 AND l_discount <= 0.08) AS p5),
  r AS (SELECT 'r1_shipdate_present' AS rule_id, 'ERROR' AS severity, n, p1 AS p, p1 = n AS ok FROM s
    UNION ALL SELECT 'r2_line_unique', 'ERROR', n, p2, p2 = n FROM s
    UNION ALL SELECT 'r3_known_supplier', 'WARN', n, p3, p3 = n FROM s
    UNION ALL SELECT 'r4_flag_pattern', 'WARN', n, p4, p4 = n FROM s
    UNION ALL SELECT 'r5_discount_range', 'WARN', n, p5, p5 = n FROM s
    UNION ALL SELECT 'r6_min_rows', 'ERROR', n, CASE WHEN n >= 1000 THEN n ELSE 0 END, n >= 1000 FROM s)
SELECT rule_id, n AS rows_checked, p AS rows_passed, n - p AS rows_failed, round(100.0::DOUBLE * p / nullif(n, 0), 4) AS pass_rate, CASE WHEN ok THEN 'PASSED' WHEN severity = 'WARN' THEN 'WARNING' ELSE 'FAILED' END AS status, CASE WHEN NOT ok AND severity = 'ERROR' THEN 'HALTED' ELSE 'CONTINUED' END AS action_taken FROM r""",

    "dq_quarantine_keys": """WITH c AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber),
  p AS (SELECT DISTINCT s_suppkey FROM supplier WHERE s_nationkey < 20),
  f AS (SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, concat_ws(',', CASE WHEN c.n > 1 THEN 'dup_line' END, CASE WHEN p.s_suppkey IS NULL THEN 'known_supplier' END, CASE WHEN coalesce(l.l_quantity <= 45, false) THEN NULL ELSE 'qty_cap' END) AS failed_rules
    FROM lineitem l JOIN c ON l.l_orderkey = c.l_orderkey AND l.l_linenumber = c.l_linenumber LEFT JOIN p ON l.l_suppkey = p.s_suppkey)
SELECT * FROM f WHERE failed_rules <> ''""",

    "range_from_config": """SELECT 'a' AS rule_id, count(*) AS rows_checked, count(*) FILTER (WHERE value >= 0 AND value <= 100) AS rows_passed FROM events
  UNION ALL SELECT 'b', count(*), count(*) FILTER (WHERE value >= 50 AND value <= 500) FROM events""",

    "drift_detect": f"""WITH {_DRIFT}
SELECT * FROM d""",

    "drift_action": f"""WITH {_DRIFT}
SELECT object_id, column_name, drift_type, CASE WHEN drift_type = 'NULLABLE_CHANGE' THEN 'WARNED' WHEN drift_type = 'TYPE_CHANGE' AND (old_value || '>' || new_value) NOT IN {_WIDENING_SQL} THEN 'HALTED' ELSE 'EVOLVED' END AS action_taken FROM d""",

    "drift_action_halt": f"""WITH {_DRIFT}
SELECT object_id, column_name, drift_type, 'HALTED' AS action_taken FROM d""",

    "schema_reregister": f"""WITH {_REG_CUR}
SELECT coalesce(c.object_id, r.object_id) AS object_id, coalesce(c.column_name, r.column_name) AS column_name, coalesce(c.data_type, r.data_type) AS data_type, coalesce(c.is_nullable, r.is_nullable) AS is_nullable, coalesce(c.column_order, r.column_order) AS column_order, c.column_name IS NOT NULL AS active_flag, r.column_name IS NULL AS is_new FROM reg r FULL OUTER JOIN cur c ON r.object_id = c.object_id AND r.column_name = c.column_name""",

    "evolve_union": """SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT o_orderkey, o_totalprice, CAST(NULL AS VARCHAR) FROM orders WHERE o_orderkey % 2 = 1""",

    "run_status_rollup": "SELECT user_id AS run_id, count(*) AS total_objects, count(*) FILTER (WHERE event_type <> 'error') AS success_objects, count(*) FILTER (WHERE event_type = 'error') AS failed_objects, CASE WHEN count(*) FILTER (WHERE event_type = 'error') = 0 THEN 'SUCCESS' WHEN count(*) FILTER (WHERE event_type <> 'error') = 0 THEN 'FAILED' ELSE 'PARTIAL' END AS status FROM events GROUP BY user_id",

    "run_lifecycle": "SELECT user_id AS run_id, min(ts) AS start_time, max(ts) AS end_time, CAST(floor(epoch(max(ts)) - epoch(min(ts))) AS BIGINT) AS duration_seconds FROM events GROUP BY user_id",

    "object_metrics": "SELECT user_id AS run_id, event_type AS object_id, count(*) AS rows_read, count(*) FILTER (WHERE value <= 0.05) AS rows_rejected, CASE WHEN count(*) FILTER (WHERE value <= 0.05) = 0 THEN 'SUCCESS' ELSE 'FAILED' END AS status FROM events GROUP BY user_id, event_type",

    "error_log": "SELECT event_id AS error_id, user_id AS run_id, 'UNKNOWN' AS error_type, props AS error_message, CAST(row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS INT) AS retry_attempt, ts AS error_ts FROM events WHERE event_type = 'error'",

    "connection_lookup": """WITH c(pipeline_id, source_system, connection_name, active_flag) AS (VALUES ('p0', 'erp', 'erp_p0', true), ('p1', 'erp', 'erp_p1_old', false), ('p1', 'erp', 'erp_p1', true), ('p2', 'crm', 'crm_p2', true), ('p3', 'crm', 'crm_p3', true)),
  o AS (SELECT s_suppkey AS object_id, 'p' || s_nationkey AS pipeline_id, CASE WHEN CAST(floor(s_acctbal / 1000) AS INT) + 1 > 5 THEN 'crm' ELSE 'erp' END AS source_system FROM supplier)
SELECT o.object_id, o.pipeline_id, o.source_system, c.connection_name FROM o LEFT JOIN (SELECT * FROM c WHERE active_flag) c ON o.pipeline_id = c.pipeline_id AND o.source_system = c.source_system""",

    "dq_gate": """WITH r AS (SELECT count(*) AS n, count(*) FILTER (WHERE c_name IS NOT NULL) AS p1, count(*) FILTER (WHERE c_acctbal >= -500 AND c_acctbal <= 5000) AS p3 FROM customer),
  h AS (SELECT (CASE WHEN p1 < n THEN 1 ELSE 0 END) + (CASE WHEN p3 < n THEN 1 ELSE 0 END) + (CASE WHEN n < 1 THEN 1 ELSE 0 END) AS k FROM r)
SELECT CAST(k AS BIGINT) AS halted_rules, k = 0 AS may_write FROM h""",

    "evolve_align": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice, CAST(NULL AS INTEGER) AS o_shippriority, o_orderstatus FROM orders",

    "run_latest_status": "SELECT user_id AS run_id, min(ts) AS start_time, max(ts) AS end_time, max_by(event_type, (ts, event_id)) AS status, min_by(props, (ts, event_id)) AS started_by, CAST(floor(epoch(max(ts)) - epoch(min(ts))) AS BIGINT) AS duration_seconds FROM events GROUP BY user_id",

    "table_counts": """SELECT 'orders' AS table_name, count(*) AS n FROM orders
  UNION ALL SELECT 'lineitem', count(*) FROM lineitem
  UNION ALL SELECT 'events', count(*) FROM events""",
}
