"""Command line: ``python -m sluice {ddl,seed,run} ...``.

- ``ddl``: create the namespaces and the twelve control tables (a failed table does not stop the others);
- ``seed``: idempotent seeding of the five config tables from a config document;
- ``run``: one ingestion run of a pipeline.

Each exits non-zero on failure, as a job step should.
"""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sluice")
    sub = p.add_subparsers(dest="cmd", required=True)
    d = sub.add_parser("ddl", help="create namespaces and control tables")
    d.add_argument("--control-schema", required=True)
    d.add_argument("--raw-schema", default="raw")
    d.add_argument("--staging-schema", default="staging")
    s = sub.add_parser("seed", help="seed the config tables from a config document")
    s.add_argument("--control-schema", required=True)
    s.add_argument("--config-path", required=True)
    s.add_argument("--target-catalog")
    r = sub.add_parser("run", help="run one pipeline")
    r.add_argument("--control-schema", required=True)
    r.add_argument("--pipeline-id", required=True)
    r.add_argument("--environment", default="dev", choices=["dev", "qa", "prod"])
    r.add_argument("--triggered-by", default="api")
    r.add_argument("--triggered-mode", default="manual", choices=["schedule", "manual"])
    args = p.parse_args(argv)

    from sluice.session import get_spark
    spark = get_spark(master=None)
    if args.cmd == "ddl":
        from sluice.sinks.ddl import check_identifier, create_control_tables, create_namespaces
        names = {check_identifier(args.raw_schema): "Raw layer: targets of ingestion.",
                 check_identifier(args.staging_schema): "Staging layer: intermediate copies for merges.",
                 check_identifier(args.control_schema): "Control tables of the ingestion framework."}
        create_namespaces(spark, names)
        failed = {t: e for t, e in create_control_tables(spark, args.control_schema).items() if e}
        print(json.dumps({"created": 12 - len(failed), "failed": failed}))
        return 1 if failed else 0
    if args.cmd == "seed":
        from sluice.plans.seed_job import SeedFailed, seed_from_document
        try:
            report = seed_from_document(spark, args.control_schema, args.config_path,
                                        target_catalog=args.target_catalog, raise_on_failure=True)
        except SeedFailed as e:
            print(json.dumps(e.report))
            return 1
        print(json.dumps(report))
        return 0
    from sluice.plans.control import ControlPlane
    from sluice.plans.ingestion_run import run_pipeline
    cp = ControlPlane(spark, args.control_schema, args.pipeline_id, environment=args.environment)
    res = run_pipeline(cp, triggered_by=args.triggered_by, triggered_mode=args.triggered_mode)
    print(json.dumps({"run_id": res["run_id"], "status": res["status"],
                      "objects": [{"object_id": o.object_id, "status": o.status, **o.counts}
                                  for o in res["objects"]]}, default=str))
    return 0 if res["status"] == "SUCCESS" else 1


if __name__ == "__main__":
    sys.exit(main())
