"""Command line: each command prints its answer as JSON or text. Exit codes: 0 fine, 1 internal, 2 usage, 3 configuration or gate, 4 files."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from catalens.model import ConfigError
from catalens.operators import report
from catalens.plans.engine import Engine
from catalens.plans.project import Config, Project

EXIT_OK, EXIT_INTERNAL, EXIT_USAGE, EXIT_CONFIG, EXIT_IO = 0, 1, 2, 3, 4


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="catalens")
    top.add_argument("--project", default=".")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, /, **options):
        p = commands.add_parser(name)
        for key, how in options.items():
            named = how.pop("flag", True)
            p.add_argument("--" + key.replace("_", "-") if named else key, **how)
        return p

    yes = {"action": "store_true"}
    command("init", force=dict(yes), provider={"default": "sqlite"}, connection={}, connection_env={})
    command("status")
    command("doctor", check_db=dict(yes))
    command("snapshot", profile={"choices": ["schema", "stats", "sample"]}, max_rows_per_table={"type": int}, store_raw_samples=dict(yes), infer=dict(yes))
    command("sync")
    command("benchmark", tables={"type": int, "default": 1000}, columns_per_table={"type": int, "default": 4})
    command("benchmark-context", cases={"required": True})
    p = command("validate-sql", dialect={})
    only = p.add_mutually_exclusive_group(required=True)
    only.add_argument("--sql")
    only.add_argument("--file")
    command("search", query={"flag": False}, kind={}, limit={"type": int, "default": 20})
    command("table", name={"flag": False})
    command("relations", name={"flag": False}, depth={"type": int, "default": 1, "choices": [1, 2]}, direction={"default": "both", "choices": ["incoming", "outgoing", "both"]})
    command("context", query={"flag": False}, tokens={"type": int, "default": 800})
    command("diff")
    command("impact", name={"flag": False}, depth={"type": int, "default": 2, "choices": [1, 2]})
    command("workload")
    command("analyze", scope={"default": "all", "choices": ["all", "risk", "quality", "performance"]}, format={"default": "text", "choices": ["text", "json", "markdown"]}, output={}, include_suppressed=dict(yes), fail_on={}, baseline={}, fail_on_new={})
    command("serve")
    return top


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("catalens").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None, spark=None, out=None) -> int:
    out = out or sys.stdout
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return EXIT_USAGE if e.code else EXIT_OK
    try:
        answer, code = run(a, spark, out)
    except ConfigError as e:
        print(f"error: {e}", file=sys.stderr)
        return EXIT_CONFIG
    except OSError as e:
        print(f"error: {e}", file=sys.stderr)
        return EXIT_IO
    if answer is not None:
        print(answer if isinstance(answer, str) else json.dumps(answer, indent=2, default=str), file=out)
    return code


def run(a: argparse.Namespace, spark, out) -> tuple[dict | list | str | None, int]:
    if a.command == "init":
        env = a.connection_env or (None if a.connection else "CATALENS_DATABASE_URL")
        project = Project.init(a.project, Config(provider=a.provider, connection=a.connection, connection_env=env), a.force)
        return {"created": str(project.state)}, EXIT_OK
    engine = Engine(spark or session(), Project.find(a.project))
    if a.command == "status":
        return engine.status(), EXIT_OK
    if a.command == "doctor":
        found = engine.doctor(a.check_db)
        return found, EXIT_OK if found["status"] != "error" else EXIT_CONFIG
    if a.command == "snapshot":
        config = engine.project.config()
        config.profiling_mode = a.profile or config.profiling_mode
        config.max_rows_per_table = a.max_rows_per_table or config.max_rows_per_table
        config.store_raw_samples = a.store_raw_samples or config.store_raw_samples
        return engine.snapshot(config, a.infer), EXIT_OK
    if a.command == "sync":
        return engine.sync(), EXIT_OK
    if a.command == "benchmark":
        return engine.benchmark(a.tables, a.columns_per_table), EXIT_OK
    if a.command == "benchmark-context":
        return engine.benchmark_context(json.loads(Path(a.cases).read_text())), EXIT_OK
    if a.command == "validate-sql":
        found = engine.validate_sql(a.sql if a.sql is not None else Path(a.file).read_text(), a.dialect)
        return found, EXIT_OK
    if a.command == "search":
        return engine.search(a.query, a.kind, a.limit), EXIT_OK
    if a.command == "table":
        return engine.table(a.name), EXIT_OK
    if a.command == "relations":
        return engine.relations(a.name, a.depth, a.direction), EXIT_OK
    if a.command == "context":
        return engine.context(a.query, a.tokens), EXIT_OK
    if a.command == "diff":
        return engine.diff(), EXIT_OK
    if a.command == "impact":
        return engine.impact(a.name, a.depth), EXIT_OK
    if a.command == "workload":
        return engine.workload(), EXIT_OK
    if a.command == "serve":
        from catalens.rpc import serve

        serve(engine, sys.stdin, out)
        return None, EXIT_OK
    found = engine.analyze(a.scope, a.include_suppressed, a.fail_on, a.baseline, a.fail_on_new)
    text = report.render(found, a.format)
    code = EXIT_CONFIG if found["gate"]["failed"] else EXIT_OK
    if a.output:
        Path(a.output).write_text(text)
        return None, code
    return text, code


if __name__ == "__main__":
    sys.exit(main())
