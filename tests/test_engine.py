import importlib.util
import io
import json
import shutil
import sqlite3
import subprocess
import sys
from pathlib import Path

import pytest

from catalens import cli, rpc
from catalens import testbed as T
from catalens.model import ConfigError
from catalens.plans.engine import Engine
from catalens.plans.project import Config, Project
from catalens.plans.store import Store, from_json, to_json
from catalens.sources.base import provider, redacted
from catalens.sources.canonical import canonicalize, staging
from catalens.sources.postgres import QUERIES, PostgresProvider
from catalens.streaming import sync

REPO = Path(__file__).resolve().parents[1]


@pytest.fixture
def shop(tmp_path):
    db = sqlite3.connect(tmp_path / "shop.db")
    db.executescript(
        """CREATE TABLE users (id INTEGER PRIMARY KEY, email TEXT NOT NULL UNIQUE);
        CREATE TABLE orders (id INTEGER PRIMARY KEY, user_id INTEGER NOT NULL REFERENCES users(id) ON DELETE CASCADE, status TEXT NOT NULL DEFAULT 'open');
        CREATE INDEX idx_orders_status ON orders(status); CREATE INDEX idx_users_lower ON users(lower(email)); CREATE VIEW open_orders AS SELECT * FROM orders WHERE status = 'open';
        INSERT INTO users VALUES (1, 'a@example.com'); INSERT INTO orders VALUES (1, 1, 'open'), (2, 1, 'paid');"""
    )
    db.close()
    (tmp_path / "sql").mkdir()
    (tmp_path / "sql" / "q.sql").write_text("SELECT * FROM orders o JOIN users u ON u.id = o.user_id WHERE o.status = 'paid'")
    (tmp_path / "node_modules" / "sql").mkdir(parents=True)
    (tmp_path / "node_modules" / "sql" / "x.sql").write_text("SELECT 1")
    config = Config(provider="sqlite", connection=str(tmp_path / "shop.db"), profiling_mode="sample", data_access=[{"table": "main.orders", "mode": "sample", "columns": ["status"], "limit": 10}, {"table": "*", "mode": "schema"}])
    Project.init(tmp_path, config)
    return tmp_path


def test_sqlite_project_end_to_end(spark, shop, capsys):
    engine = Engine(spark, Project.find(shop / "sql"))
    made = engine.snapshot()
    assert (made["tables"], made["columns"], made["queries"], made["sqlArtifacts"]) == (2, 5, 1, 1)
    g = engine.store.latest()
    kinds = {r["kind"] for r in g.objects.collect()}
    assert {"primary_key", "foreign_key", "unique_constraint", "index", "view", "query", "schema"} <= kinds
    status = g.column_profiles.where("object_id = 'column:main.orders.status'").first()["summary"]
    assert status["distinct_count"] == 2 and status["examples"] == ["[REDACTED]"] * 2
    index = json.loads(g.objects.where("name = 'idx_users_lower'").first()["metadata_json"])
    assert index["expressionIndex"] is True
    card = engine.table("orders", most=2)
    assert card["profile"]["row_estimate"] == 2 and card["omitted"]["columns"] == 1 and card["truncated"]
    assert engine.sync()["changed"] is False
    with pytest.raises(ConfigError):
        engine.diff()
    db = sqlite3.connect(shop / "shop.db")
    db.execute("ALTER TABLE orders ADD COLUMN note TEXT")
    db.commit()
    db.close()
    assert engine.sync()["changed"] is True
    assert ("added", "main.orders.note") in {(c["change"], c["full_name"]) for c in engine.diff()["changes"]}
    found = {f["rule_id"] for f in engine.analyze()["findings"]}
    assert {"risk.sensitive_column", "risk.select_star", "data.enum_like_without_constraint"} <= found
    assert engine.doctor()["status"] == "ok"
    assert engine.workload()[0]["frequency"] >= 1

    out = io.StringIO()
    assert cli.main(["--project", str(shop), "search", "orders", "--limit", "3"], spark, out) == 0 and "main.orders" in out.getvalue()
    assert cli.main(["--project", str(shop), "analyze", "--fail-on", "high"], spark, io.StringIO()) == 3
    assert cli.main(["--project", str(shop), "relations", "orders", "--depth", "9"], spark, io.StringIO()) == 2
    assert cli.main(["--project", str(shop.parent), "status"], spark, io.StringIO()) == 3
    capsys.readouterr()

    asked = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize"}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/list"},
        {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "validate_sql", "arguments": {"sql": "SELECT 1 FROM nowhere"}}},
        {"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "search", "arguments": {"query": " "}}}, {"jsonrpc": "2.0", "id": 5, "method": "nothing"},
    ]
    said = io.StringIO()
    rpc.serve(engine, [*(json.dumps(a) for a in asked), "{"], said)
    answers = [json.loads(x) for x in said.getvalue().splitlines()]
    assert [a.get("id") for a in answers] == [1, 2, 3, 4, 5, None] and len(answers[1]["result"]["tools"]) == 9
    assert json.loads(answers[2]["result"]["content"][0]["text"])["valid"] is False
    assert answers[3]["result"]["isError"] and answers[4]["error"]["code"] == rpc.UNKNOWN and answers[5]["error"]["code"] == rpc.PARSE


def test_canonical_catalog_drops_system_schemas(spark):
    stage = staging(
        spark, schemas=[("public", None), ("pg_catalog", None)], tables=[("public", "users", "BASE TABLE", None), ("public", "orders", "BASE TABLE", None), ("pg_catalog", "x", "t", None)],
        columns=[("public", "orders", "user_id", 1, "int8", "numeric", False, None, None)], constraints=[("public", "orders", "orders_user_id_fkey", "f", ["user_id"], "public", "users", ["id"], None, "c", "a")],
        triggers=[("public", "orders", "orders_touch", "public", "touch_updated_at", "x")], routines=[("public", "touch_updated_at", "", "function", "trigger")], enums=[("public", "order_status", ["pending", "active"])],
        sequences=[("public", "order_id_seq", None, None)], views=[("public", "active_orders", False, "SELECT 1")], table_stats=[("public", "orders", 42, None, 4096, "s")],
        column_stats=[("public", "orders", "user_id", 0.1, 3.0, 8, 2, 3)],
    )
    g = canonicalize(stage, "postgres", "db")
    ids = {r["id"] for r in g.objects.collect()}
    assert not any("pg_catalog" in i for i in ids) and {"routine:public.touch_updated_at()", "enum:public.order_status", "trigger:public.orders.orders_touch"} <= ids
    edge = g.edges.where("kind = 'references'").first()
    assert edge["to_id"] == "table:public.users" and edge["evidence"][0]["detail"] == "orders_user_id_fkey references public.users(id)" and edge["confidence"] == 1.0
    assert g.table_profiles.first()["row_count_kind"] == "estimate"
    meta = json.loads(g.objects.where("kind = 'foreign_key'").first()["metadata_json"])
    assert (meta["onDelete"], meta["onUpdate"]) == ("CASCADE", "NO ACTION")
    assert [r["obj_ord"] for r in g.objects.orderBy("kind", "full_name", "id").collect()] == list(range(len(ids)))


def test_postgres_provider_reads_through_one_reader(spark):
    def reader(session, query):
        if query == QUERIES["tables"]:
            return session.sql("SELECT 'public' AS schema_name, 't' AS table_name, 'BASE TABLE' AS table_type, NULL AS comment")
        if query == QUERIES["constraints"]:
            return session.sql("SELECT 'public' AS schema_name, 't' AS table_name, 't_pkey' AS constraint_name, 'p' AS constraint_type, concat('a', char(1), 'b') AS columns, NULL AS ref_schema, NULL AS ref_table, NULL AS ref_columns, NULL AS check_expression, NULL AS on_delete, NULL AS on_update")
        name = next(k for k, v in QUERIES.items() if v == query)
        return staging(session)[name].select("*") if name not in ("indexes", "enums") else staging(session)[name].selectExpr(*[f"cast(null as string) AS `{c}`" if t.startswith("array") else f"`{c}`" for c, t in staging(session)[name].dtypes])

    g = PostgresProvider("postgres://u:secret@host/db", reader).snapshot(spark)
    assert g.objects.where("kind = 'primary_key'").first()["constraint"]["columns"] == ["a", "b"] and g.database == "db"
    options = PostgresProvider("postgres://u:s%40@h:1/db").jdbc_options("SELECT 1")
    assert options["password"] == "s@" and "read_only" in options["sessionInitStatement"]
    assert "secret" not in redacted("postgres://u:secret@host/db?password=secret")


@pytest.mark.parametrize("name", ["mysql", "sql-server"])
def test_placeholders_refuse(spark, name):
    with pytest.raises(ConfigError):
        provider(name).snapshot(spark)


def test_unknown_provider_and_own_state():
    with pytest.raises(ConfigError):
        provider("oracle")
    with pytest.raises(ConfigError):
        provider("sqlite", "/x/.catalens/a.db")


def test_store_refuses_repeated_ids_and_exchanges_json(spark, tmp_path):
    g = T.shop(spark).with_(created_at_ms=1)
    store = Store(spark, str(tmp_path / "w"))
    with pytest.raises(ConfigError):
        store.write(g.with_(objects=g.objects.union(g.objects)))
    assert store.snapshots().count() == 0
    mark = store.write(g)
    assert store.content_hash(g.snapshot_id) == mark and store.latest().objects.count() == g.objects.count()
    to_json(g, str(tmp_path / "j"))
    assert from_json(spark, str(tmp_path / "j")).edges.count() == g.edges.count()


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.sql").write_text("SELECT 1 FROM orders")
    store = Store(spark, str(tmp_path / "w"))
    run = lambda: sync.sync_artifacts(sync.sql_file_stream(spark, str(folder)), store, "s", str(tmp_path / "c")).awaitTermination()
    run()
    (folder / "b.sql").write_text("DELETE FROM t; SELECT 2")
    (folder / "c.sql").write_text("select 1 from orders;")
    run()
    assert [r["source_path"].rsplit("/", 1)[-1] for r in store.artifacts("s").collect()] == ["b.sql", "c.sql"]


def test_project_configuration(tmp_path):
    with pytest.raises(ConfigError):
        Project(tmp_path).config()
    Project.init(tmp_path, Config(connection="x"))
    with pytest.raises(ConfigError):
        Project.init(tmp_path)
    for bad in (Config(connection="x", version=0), Config(connection="x", provider="nope"), Config(), Config(connection="x", profiling_mode="sample", max_rows_per_table=0), Config(connection="x", store_raw_samples=True)):
        with pytest.raises(ConfigError):
            bad.check()


def test_entry_works_without_the_optional_parts(tmp_path):
    kept = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "tests")
    shutil.copytree(REPO, tmp_path / "r", ignore=kept)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q); assert set(o) <= set(q) and len(q) > 50"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True)


def test_queries_agree_with_their_sql(spark):
    import duckdb

    spec = importlib.util.spec_from_file_location("entry", REPO / "__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    assert entry.entry(spark).count() > 0
    sf_dir, db = "/root/testdata/sf0.001", duckdb.connect()
    for t in T.TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    for name in ("profile_orders", "relations_depth2_both", "impact_region", "workload_events", "search_parts", "diff_orders", "context_budget_documents", "token_estimates", "catalog_columns"):
        got = entry.queries()[name](spark, sf_dir)
        cols = sorted(got.columns)
        want = db.execute(entry.oracle_sql()[name]).fetchall()
        order = [d[0] for d in db.description]
        key = lambda rows: sorted(str(r) for r in rows)
        assert key([tuple(r[c] for c in cols) for r in got.collect()]) == key([tuple(r[order.index(c)] for c in cols) for r in want]), name
