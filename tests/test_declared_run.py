"""A run reads JSON and CSV files by the registered schema; misfits are set aside, rules that cannot be judged are logged."""

import json

import pytest
from pyspark.sql import functions as F

from sluice.plans.control import ControlPlane
from sluice.plans.ingestion_run import run_pipeline
from sluice.plans.seed_job import seed_from_document
from sluice.sinks.ddl import create_control_tables
from tests.test_run import DOC, _setup


def _file_object(spark, db, folder, name, declared=True):
    """The seeded object becomes a file that is loaded whole."""
    _setup(spark, db)
    seed_from_document(spark, db, DOC, target_catalog="lake")
    spark.sql("DROP TABLE IF EXISTS raw.people")
    spark.sql("DROP TABLE IF EXISTS raw.people__unreadable")
    row = spark.table(f"{db}.source_object_config").limit(1).withColumns({
        "source_type": F.lit("cloud_storage"), "source_schema": F.lit(str(folder)), "source_object": F.lit(name), "target_schema": F.lit("raw"), "target_table": F.lit("people"),
        "staging_table": F.lit(None).cast("string"), "load_type": F.lit("full_load"), "primary_key": F.lit("id"), "watermark_column": F.lit(None).cast("string"), "hash_columns": F.lit(None).cast("string")})
    row.write.saveAsTable(f"{db}.so_file")
    spark.sql(f"INSERT OVERWRITE {db}.source_object_config SELECT * FROM {db}.so_file")
    rules = spark.table(f"{db}.dq_rule_config").limit(1).withColumns({
        "rule_id": F.lit("odd"), "rule_name": F.lit("odd"), "rule_type": F.lit("CUSTOM"), "rule_expression": F.lit("no_such_column > 1"), "severity": F.lit("WARN"),
        "object_id": F.lit(row.first()["object_id"]), "active_flag": F.lit(True)})
    rules.write.saveAsTable(f"{db}.rule_file")
    spark.sql(f"INSERT OVERWRITE {db}.dq_rule_config SELECT * FROM {db}.rule_file")
    if declared:
        spark.sql(f"INSERT INTO {db}.pipeline_config SELECT 'cfg-ds', 'orders_pipeline', 'declared_schema', 'true', 'types of the registry', true, current_timestamp(), current_timestamp()")
    return ControlPlane(spark, db, "orders_pipeline")


def test_json_files_keep_their_registered_types(spark, db, tmp_path):
    path = tmp_path / "people.json"
    path.write_text("\n".join(json.dumps({"id": k, "age": k * 1.5, "name": f"n{k}"}) for k in range(20)))
    cp = _file_object(spark, db, tmp_path, "people.json")
    assert run_pipeline(cp)["status"] == "SUCCESS" and spark.table("raw.people").count() == 20
    # Inference would make every age a text; by the registered schema one record does not fit.
    path.write_text("\n".join([json.dumps({"id": k, "age": k, "name": None}) for k in range(5)] + ['{"id": 6, "age": "old"}', "{broken"]))
    res = run_pipeline(cp)
    assert res["status"] == "SUCCESS", res
    assert dict(spark.table("raw.people").dtypes)["age"] == "double" and spark.table("raw.people").count() == 5
    aside = spark.table("raw.people__unreadable")
    assert {r["record"] for r in aside.collect()} == {'{"id": 6, "age": "old"}', "{broken"} and set(aside.columns) >= {"id", "age", "name", "load_run_id"}
    counts = res["objects"][0].counts
    assert (counts["rows_read"], counts["rows_rejected"]) == (7, 2)
    errors = spark.table(f"{db}.job_run_error").where("retry_attempt = 0").collect()
    assert len(errors) == 2 and all(e["error_type"] == "DQ_ERROR" and e["error_message"].startswith("rule odd cannot be judged") for e in errors)


def test_csv_header_decides_whether_the_schema_still_fits(spark, db, tmp_path):
    path = tmp_path / "people.csv"
    path.write_text("id,name\n1,a\n2,b\n")
    cp = _file_object(spark, db, tmp_path, "people.csv")
    assert run_pipeline(cp)["status"] == "SUCCESS"
    path.write_text("name,id\nc,3\n")
    assert run_pipeline(cp)["status"] == "SUCCESS" and [(r["id"], r["name"]) for r in spark.table("raw.people").collect()] == [("3", "c")]
    path.write_text("id,name,town\n1,a,x\n")
    res = run_pipeline(cp)
    assert res["status"] == "SUCCESS" and spark.table("raw.people").columns[:3] == ["id", "name", "town"]
    assert spark.table(f"{db}.schema_drift_log").where("drift_type = 'NEW_COLUMN' AND column_name = 'town'").count() == 1


@pytest.mark.parametrize("table", ["source_object_config", "dq_rule_config", "metadata_column_config", "ingestion_metrics"])
def test_every_control_column_has_a_comment(spark, db, table):
    create_control_tables(spark, db)
    rows = spark.sql(f"DESCRIBE TABLE {db}.{table}").where("col_name NOT LIKE '#%' AND col_name != ''").collect()
    assert rows and all(r["comment"] for r in rows)
