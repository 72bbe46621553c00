"""SQLite files: opened read-only on the driver, since a file is one machine's; its rows become DataFrames."""

from __future__ import annotations

import sqlite3
from pathlib import Path
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession

from catalens.model import CAPABILITIES, ConfigError, Graph
from catalens.operators.policy import Rule, jdbc_query
from catalens.sources.base import Provider
from catalens.sources.canonical import canonicalize, staging
from catalens.sources.families import sqlite_family

SCHEMA = "main"
STATE_DIR = ".catalens"


def file_of(url: str) -> Path:
    for head in ("sqlite://", "sqlite:", "file://", "file:"):
        if url.startswith(head):
            url = unquote(url[len(head) :].split("?")[0])
            break
    if not url:
        raise ConfigError("a SQLite source needs the path of its file")
    path = Path(url)
    if STATE_DIR in path.parts:
        raise ConfigError(f"{path} belongs to this engine's own state and is not a source")
    return path


class SqliteProvider(Provider):
    id = "sqlite"
    capabilities = dict.fromkeys(CAPABILITIES, "supported") | {"routines": "unsupported", "triggers": "unsupported"}

    def __init__(self, url: str):
        self.path = file_of(url)

    def _open(self) -> sqlite3.Connection:
        if not self.path.is_file():
            raise ConfigError(f"{self.path} is not a file")
        return sqlite3.connect(f"file:{quote(str(self.path))}?mode=ro", uri=True)

    def connect(self) -> dict:
        with self._open() as db:
            return {"database": self.path.stem, "version": db.execute("SELECT sqlite_version()").fetchone()[0]}

    def snapshot(self, spark: SparkSession) -> Graph:
        db = self._open()
        tables = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite\\_%' ESCAPE '\\' ORDER BY name")]
        views = db.execute("SELECT name, sql FROM sqlite_master WHERE type = 'view' ORDER BY name").fetchall()
        columns, constraints, indexes, stats = [], [], [], []
        for t in tables:
            info = db.execute("SELECT cid, name, type, \"notnull\", dflt_value, pk FROM pragma_table_info(?)", (t,)).fetchall()
            columns += [(SCHEMA, t, c, i, kind, sqlite_family(kind), not notnull and not pk, default, None) for i, c, kind, notnull, default, pk in info]
            if keyed := [c for pk, c in sorted((r[5], r[1]) for r in info if r[5])]:
                constraints.append((SCHEMA, t, f"sqlite_auto_pk_{t}", "p", keyed, None, None, None, None, None, None))
            for number, seq, target, own, to, on_update, on_delete in db.execute("SELECT id, seq, \"table\", \"from\", \"to\", on_update, on_delete FROM pragma_foreign_key_list(?) ORDER BY id, seq", (t,)):
                del seq
                constraints.append((SCHEMA, t, f"sqlite_fk_{t}_{number}_{own}", "f", [own], SCHEMA, target, [to] if to else [], None, _code(on_delete), _code(on_update)))
            for name, unique, origin, partial in db.execute("SELECT name, \"unique\", origin, partial FROM pragma_index_list(?) ORDER BY name", (t,)):
                if origin == "pk":
                    continue
                keys = db.execute("SELECT name FROM pragma_index_xinfo(?) WHERE \"key\" = 1 ORDER BY seqno", (name,)).fetchall()
                named = [k for (k,) in keys if k is not None]
                text = db.execute("SELECT sql FROM sqlite_master WHERE type = 'index' AND name = ?", (name,)).fetchone()
                spelt = text[0] if text and text[0] and len(named) < len(keys) else None
                indexes.append((SCHEMA, t, name, bool(unique), named, spelt, "partial" if partial else None))
                if origin == "u":
                    constraints.append((SCHEMA, t, name, "u", named, None, None, None, None, None, None))
            quoted = t.replace('"', '""')
            stats.append((SCHEMA, t, db.execute(f'SELECT count(*) FROM "{quoted}"').fetchone()[0], "exact", None, "sqlite.count"))
        db.close()
        stage = staging(
            spark, schemas=[(SCHEMA, None)], tables=[(SCHEMA, t, "BASE TABLE", None) for t in tables], columns=columns, constraints=constraints, indexes=indexes,
            views=[(SCHEMA, v, False, text) for v, text in views], table_stats=stats,
        )
        return canonicalize(stage, self.id, self.path.stem, capabilities=self.capabilities)

    def _rows(self, spark: SparkSession, query: str) -> DataFrame:
        with self._open() as db:
            found = db.execute(query)
            names = [d[0] for d in found.description]
            rows = [tuple(_text(v) for v in r) for r in found.fetchall()]
        return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))

    def sample(self, spark: SparkSession, schema: str, name: str, rule: Rule, most: int) -> DataFrame:
        return self._rows(spark, jdbc_query(None, name, rule, most, as_text=False))


def _code(action: str | None) -> str:
    return {"NO ACTION": "a", "RESTRICT": "r", "CASCADE": "c", "SET NULL": "n", "SET DEFAULT": "d"}.get((action or "").upper(), "a")


def _text(value) -> str | None:
    """A value as the text that profiles see: blobs only by their size, numbers that are none as null."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bytes):
        return f"<{len(value)} bytes>"
    if isinstance(value, float) and value not in (float("inf"), float("-inf")) and value == value:
        return repr(value)
    return str(value) if isinstance(value, int) else None
