"""The twelve control tables as StructTypes, plus their keys and partitioning."""

from __future__ import annotations

from pyspark.sql import types as T

# Control table columns in declared order with types and NOT NULL flags.
_TABLE_DDL = {
    "source_object_config": """
        object_id STRING NOT NULL, pipeline_id STRING NOT NULL, source_system STRING NOT NULL,
        source_type STRING NOT NULL, source_schema STRING NOT NULL, source_object STRING NOT NULL,
        target_catalog STRING NOT NULL, target_schema STRING NOT NULL, target_table STRING NOT NULL,
        staging_table STRING, load_type STRING NOT NULL, write_mode STRING NOT NULL,
        primary_key STRING NOT NULL, watermark_column STRING, hash_columns STRING,
        active_flag BOOLEAN NOT NULL, load_order INT NOT NULL, created_at TIMESTAMP NOT NULL,
        updated_at TIMESTAMP NOT NULL, created_by STRING NOT NULL, updated_by STRING NOT NULL""",
    "watermark_control": """
        object_id STRING NOT NULL, pipeline_id STRING NOT NULL, last_run_ts TIMESTAMP,
        last_run_id STRING, rows_last_loaded BIGINT, updated_at TIMESTAMP NOT NULL,
        watermark_col STRING, watermark_col_value STRING, watermark_col_hash STRING""",
    "pipeline_config": """
        config_id STRING NOT NULL, pipeline_id STRING NOT NULL, config_key STRING NOT NULL,
        config_value STRING NOT NULL, description STRING, active_flag BOOLEAN NOT NULL,
        created_at TIMESTAMP NOT NULL, updated_at TIMESTAMP NOT NULL""",
    "job_run_audit": """
        run_id STRING NOT NULL, pipeline_id STRING NOT NULL, job_id STRING, job_run_id STRING,
        triggered_by STRING NOT NULL, triggered_mode STRING NOT NULL, start_time TIMESTAMP NOT NULL,
        end_time TIMESTAMP, duration_seconds BIGINT, status STRING NOT NULL, total_objects INT,
        success_objects INT, failed_objects INT, environment STRING NOT NULL,
        created_at TIMESTAMP NOT NULL""",
    "job_run_error": """
        error_id STRING NOT NULL, run_id STRING NOT NULL, pipeline_id STRING NOT NULL,
        object_id STRING NOT NULL, source_object STRING NOT NULL, error_type STRING NOT NULL,
        error_message STRING, stack_trace STRING, retry_attempt INT NOT NULL,
        error_ts TIMESTAMP NOT NULL, environment STRING NOT NULL""",
    "ingestion_metrics": """
        metric_id STRING NOT NULL, run_id STRING NOT NULL, pipeline_id STRING NOT NULL,
        object_id STRING NOT NULL, source_object STRING NOT NULL, target_table STRING NOT NULL,
        load_type STRING NOT NULL, write_mode STRING NOT NULL, rows_read BIGINT,
        rows_inserted BIGINT, rows_updated BIGINT, rows_deleted BIGINT, rows_rejected BIGINT,
        duration_seconds BIGINT, status STRING NOT NULL, metric_ts TIMESTAMP NOT NULL,
        environment STRING NOT NULL""",
    "object_schema_registry": """
        schema_id STRING NOT NULL, object_id STRING NOT NULL, pipeline_id STRING NOT NULL,
        column_name STRING NOT NULL, data_type STRING NOT NULL, is_nullable BOOLEAN NOT NULL,
        is_primary_key BOOLEAN NOT NULL, column_order INT NOT NULL,
        registered_at TIMESTAMP NOT NULL, updated_at TIMESTAMP NOT NULL,
        active_flag BOOLEAN NOT NULL""",
    "schema_drift_log": """
        drift_id STRING NOT NULL, run_id STRING NOT NULL, object_id STRING NOT NULL,
        pipeline_id STRING NOT NULL, source_object STRING NOT NULL, column_name STRING NOT NULL,
        drift_type STRING NOT NULL, old_value STRING, new_value STRING,
        action_taken STRING NOT NULL, detected_at TIMESTAMP NOT NULL, environment STRING NOT NULL""",
    "dq_rule_config": """
        rule_id STRING NOT NULL, object_id STRING NOT NULL, pipeline_id STRING NOT NULL,
        rule_name STRING NOT NULL, rule_type STRING NOT NULL, column_name STRING,
        rule_expression STRING NOT NULL, expected_value STRING, severity STRING NOT NULL,
        active_flag BOOLEAN NOT NULL, created_at TIMESTAMP NOT NULL, updated_at TIMESTAMP NOT NULL""",
    "dq_check_results": """
        result_id STRING NOT NULL, run_id STRING NOT NULL, object_id STRING NOT NULL,
        rule_id STRING NOT NULL, pipeline_id STRING NOT NULL, rule_name STRING NOT NULL,
        rule_type STRING NOT NULL, column_name STRING, rows_checked BIGINT, rows_passed BIGINT,
        rows_failed BIGINT, pass_rate DOUBLE, status STRING NOT NULL, action_taken STRING NOT NULL,
        checked_at TIMESTAMP NOT NULL, environment STRING NOT NULL""",
    "metadata_column_config": """
        config_id STRING NOT NULL, pipeline_id STRING NOT NULL, column_name STRING NOT NULL,
        data_type STRING NOT NULL, applies_to STRING NOT NULL, computation STRING NOT NULL,
        column_order INT NOT NULL, is_merge_key BOOLEAN NOT NULL, active_flag BOOLEAN NOT NULL,
        created_at TIMESTAMP NOT NULL""",
    "connection_config": """
        connection_id STRING NOT NULL, pipeline_id STRING NOT NULL, source_system STRING NOT NULL,
        connection_name STRING NOT NULL, secret_scope STRING NOT NULL,
        jdbc_url_secret_key STRING NOT NULL, jdbc_user_secret_key STRING NOT NULL,
        jdbc_password_secret_key STRING NOT NULL, driver_class STRING NOT NULL,
        extra_jdbc_options STRING, active_flag BOOLEAN NOT NULL, created_at TIMESTAMP NOT NULL,
        updated_at TIMESTAMP NOT NULL""",
}

# Who writes and who reads each control table (table comments).
TABLE_COMMENTS = {
    "source_object_config": "Seeded; a run loads the active rows of its pipeline by load_order.",
    "watermark_control": "Appended after a load; extracts start from the latest row of an object.",
    "pipeline_config": "Seeded; read as one typed row of settings a pipeline.",
    "job_run_audit": "Appended at start and end; the first event names who ran it, the last its status.",
    "job_run_error": "Appended by every failed attempt, with the whole message.",
    "ingestion_metrics": "Appended once a run with the counts observed during its writes.",
    "object_schema_registry": "Appended after a load; drift compares with the latest row of each column.",
    "schema_drift_log": "Appended before the write that a drift halts or changes.",
    "dq_rule_config": "Seeded; expressions become columns of the check before a write.",
    "dq_check_results": "Appended by every check; HALTED rows stopped a write.",
    "metadata_column_config": "Seeded; a pipeline's row replaces the default of its name.",
    "connection_config": "Seeded; names the secrets of a JDBC source, and how to read it in parallel.",
}

# What a column holds, by name; (table, name) where a name means something else in one table.
COLUMN_COMMENTS = {
    "object_id": "Id of the source object.", "pipeline_id": "The pipeline that the row belongs to.", "source_system": "Name of the system that the object comes from.",
    "source_type": "How the object is read: from the catalog, by JDBC, or from files.", "source_schema": "Schema, or folder, of the object.", "source_object": "Table or file name of the object.",
    "target_catalog": "Catalog of the target, where one is configured.", "target_schema": "Schema of the target.", "target_table": "Table that loads write.",
    "staging_table": "Table for copies on the way to the target; named after the target if empty.", "load_type": "Whole loads, or changed rows found by hash.", "write_mode": "How a load writes its rows.",
    "primary_key": "Comma list of the columns that name a row.", "watermark_column": "Column whose greatest value says what was loaded.", "hash_columns": "Comma list of the columns that the record hash covers; empty: all.",
    "active_flag": "Only rows with true are used.", "load_order": "Objects of a lower number are loaded first.", "created_at": "When the row was written.", "updated_at": "When the row was written last.",
    "created_by": "Who wrote the row.", "updated_by": "Who wrote the row last.", "last_run_ts": "Time of the load that set the mark.", "last_run_id": "Run that set the mark.",
    "rows_last_loaded": "Rows of that load.", "watermark_col": "Column of the mark.", "watermark_col_value": "The mark, as text.", "watermark_col_hash": "SHA-256 of the mark's text.",
    "config_id": "Id of the row.", "config_key": "Name of the setting.", "config_value": "Value of the setting, as text.", "description": "What the setting is for.", "run_id": "Id of the run.",
    "job_id": "Id of the job in the scheduler.", "job_run_id": "Id of the job's run in the scheduler.", "triggered_by": "Who or what started the run.", "triggered_mode": "By hand or by schedule.",
    "start_time": "When the run started.", "end_time": "When the run ended; NULL while it runs.", "duration_seconds": "Whole seconds from start to end.", "status": "Outcome; RUNNING before there is one.",
    "total_objects": "Objects that the run took on.", "success_objects": "Those that were loaded.", "failed_objects": "Those that were not.", "environment": "Deployment that the row comes from.",
    "error_id": "Id of the row.", "error_type": "One of the listed kinds of error.", "error_message": "The message, whole.", "stack_trace": "Where it was raised, if known.",
    "retry_attempt": "Number of the object's failed attempt in the run; 0 for a rule that could not be judged.", "error_ts": "When it happened.", "metric_id": "Id of the row.", "rows_read": "Rows that the source gave.",
    "rows_inserted": "Rows that were new.", "rows_updated": "Rows that had changed.", "rows_deleted": "Rows newly marked as deleted.", "rows_rejected": "Rows that were set aside.", "metric_ts": "When the load was measured.",
    "schema_id": "Id of the row.", "column_name": "Name of the column.", "data_type": "Type of the column.", "is_nullable": "Whether the column may be NULL.", "is_primary_key": "Whether the column is part of the key.",
    "column_order": "Place of the column, from 1.", "registered_at": "When the column was seen first.", "drift_id": "Id of the row.", "drift_type": "What changed.", "old_value": "Registered before; NULL for a new column.",
    "new_value": "Seen now; NULL for a dropped column.", "action_taken": "What the run did about it.", "detected_at": "When the change was seen.", "rule_id": "Id of the rule.", "rule_name": "Name of the rule.",
    "rule_type": "Kind of rule.", "rule_expression": "SQL of the rule, or the columns it is about.", "expected_value": "Bounds, pattern, count or parent that the rule compares with.", "severity": "ERROR rules can stop a write, WARN rules cannot.",
    "result_id": "Id of the row.", "rows_checked": "Rows that the rule judged.", "rows_passed": "Rows that passed.", "rows_failed": "Rows that did not.", "pass_rate": "Passed rows in per cent.", "checked_at": "When the rule was judged.",
    "applies_to": "Load types that get the column.", "computation": "How the value is computed.", "is_merge_key": "Whether merges match by the column.", "connection_id": "Id of the row.", "connection_name": "Name of the connection.",
    "secret_scope": "Where the secrets are kept.", "jdbc_url_secret_key": "Secret with the address.", "jdbc_user_secret_key": "Secret with the user.", "jdbc_password_secret_key": "Secret with the password.",
    "driver_class": "JDBC driver.", "extra_jdbc_options": "Further reader options, as JSON.",
    ("metadata_column_config", "column_order"): "Metadata columns of a lower number come first.", ("metadata_column_config", "column_name"): "Name of the metadata column.",
    ("dq_rule_config", "column_name"): "Column, or comma list of columns, that the rule is about.", ("dq_check_results", "column_name"): "Column that the rule was about.",
}

# Tables partitioned by environment (the drift log has the column but is not partitioned).
PARTITION_COLUMNS = {
    "job_run_audit": ["environment"],
    "job_run_error": ["environment"],
    "ingestion_metrics": ["environment"],
    "dq_check_results": ["environment"],
}

# Natural keys of the seeded tables, their generated id column, stamped timestamps, seed order.
NATURAL_KEYS = {
    "source_object_config": ["pipeline_id", "source_object"],
    "pipeline_config": ["pipeline_id", "config_key"],
    "metadata_column_config": ["pipeline_id", "column_name"],
    "connection_config": ["pipeline_id", "connection_name"],
    "dq_rule_config": ["rule_id"],
}
AUTO_ID_COLUMN = {
    "source_object_config": "object_id",
    "pipeline_config": "config_id",
    "metadata_column_config": "config_id",
    "connection_config": "connection_id",
    "dq_rule_config": None,
}
TIMESTAMP_COLUMNS = {
    "source_object_config": ["created_at", "updated_at"],
    "pipeline_config": ["created_at", "updated_at"],
    "metadata_column_config": ["created_at"],
    "connection_config": ["created_at", "updated_at"],
    "dq_rule_config": ["created_at", "updated_at"],
}
SEED_ORDER = ["source_object_config", "pipeline_config", "metadata_column_config",
              "connection_config", "dq_rule_config"]


# Closed vocabularies.
ERROR_TYPES = ["JDBC_ERROR", "SCHEMA_MISMATCH", "MERGE_ERROR", "VALIDATION_ERROR", "DQ_ERROR", "UNKNOWN"]


def _parse(ddl: str) -> T.StructType:
    fields = []
    for part in " ".join(ddl.split()).split(", "):
        tokens = part.split(" ")
        name, type_name = tokens[0], tokens[1]
        nullable = not (len(tokens) >= 4 and tokens[2] == "NOT" and tokens[3] == "NULL")
        fields.append(T.StructField(name, _TYPES[type_name](), nullable))
    return T.StructType(fields)


_TYPES = {"STRING": T.StringType, "BOOLEAN": T.BooleanType, "INT": T.IntegerType,
          "BIGINT": T.LongType, "DOUBLE": T.DoubleType, "TIMESTAMP": T.TimestampType}

TABLES: dict[str, T.StructType] = {name: _parse(ddl) for name, ddl in _TABLE_DDL.items()}


def schema_of(table: str) -> T.StructType:
    return TABLES[table]


def required_columns(table: str) -> list[str]:
    """Columns declared NOT NULL; Parquet does not enforce them, the sinks do."""
    return [f.name for f in TABLES[table].fields if not f.nullable]
