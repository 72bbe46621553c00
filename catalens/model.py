"""The catalog graph: four relations over which all operators work, and the kinds that they hold."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The kinds of objects and edges.
OBJECT_KINDS = (
    "database", "schema", "table", "column", "primary_key", "foreign_key", "unique_constraint", "check_constraint", "index", "view",
    "materialized_view", "function", "procedure", "trigger", "enum", "sequence", "query", "migration", "sql_artifact",
)
EDGE_KINDS = (
    "contains", "has_column", "has_constraint", "has_index", "references", "depends_on", "used_by_view", "triggered_by", "reads_from",
    "writes_to", "joins_on", "filters_by", "groups_by", "orders_by", "inferred_reference",
)

OBJECTS = """id string, kind string, name string, full_name string, schema_name string, table_name string, column_name string,
`table` struct<table_type:string,comment:string>,
`column` struct<data_type:string,data_type_family:string,nullable:boolean,`default`:string,comment:string>,
`index` struct<unique:boolean,columns:array<string>,expression:string>,
`constraint` struct<columns:array<string>,referenced_table:string,referenced_columns:array<string>>,
comment string, normalized_sql string, fingerprint string, semantic_description string, deprecated boolean,
metadata_json string, obj_ord bigint"""
EDGES = """id string, kind string, from_id string, to_id string, confidence double,
evidence array<struct<source:string,detail:string>>, unresolved boolean, metadata_json string, edge_ord bigint"""
TABLE_PROFILES = "object_id string, row_estimate bigint, row_count_kind string, size_bytes bigint, profile_json string"
SUMMARY = """struct<observed_non_null:bigint,observed_null:bigint,sensitive:boolean,examples:array<string>,distinct_count:bigint,
inferred_shape:string,numeric_min:double,numeric_max:double,format_shapes:array<string>,source:string>"""
COLUMN_PROFILES = f"""object_id string, data_type_family string, null_fraction double, distinct_estimate double, pii_score double,
pii_reasons array<string>, summary {SUMMARY}, profile_json string"""

CAPABILITIES = ("schemas", "constraints", "indexes", "views", "routines", "triggers", "statistics", "sampling")


class ConfigError(ValueError):
    """What a user must change: exit code 3."""


@dataclass(frozen=True)
class Graph:
    objects: DataFrame
    edges: DataFrame
    table_profiles: DataFrame
    column_profiles: DataFrame
    provider: str = "unknown"
    database: str = "unknown"
    created_at_ms: int = 0
    capabilities: dict = field(default_factory=dict)
    metadata: dict = field(default_factory=dict)

    @property
    def snapshot_id(self) -> str:
        base = f"{self.provider}:{self.database}"
        return f"{base}:{self.created_at_ms}" if self.created_at_ms else base

    def with_(self, **changes) -> Graph:
        return replace(self, **changes)


def canonical_json(value: dict | None) -> str:
    """JSON with sorted keys: equal values are equal strings."""
    return json.dumps(value or {}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def graph(spark: SparkSession, objects: list[dict], edges: list[dict] = (), table_profiles: list[dict] = (), column_profiles: list[dict] = (), **about) -> Graph:
    """A graph from plain rows: what a provider has read on the driver, or a fixture. Places in the lists are the order of rows."""
    made = []
    for i, o in enumerate(objects):
        meta = dict(o.get("metadata") or {})
        semantic = meta.get("semantic") or {}
        made.append(
            {
                "name": o["full_name"].rsplit(".", 1)[-1],
                "comment": meta.get("comment"),
                "normalized_sql": meta.get("normalizedSql"),
                "fingerprint": meta.get("fingerprint"),
                "semantic_description": semantic.get("description"),
                "deprecated": bool(semantic.get("deprecated", False)),
                "obj_ord": i,
            }
            | {k: v for k, v in o.items() if k != "metadata"}
            | {"metadata_json": canonical_json(meta)}
        )
    linked = [
        {"confidence": 1.0, "evidence": [], "unresolved": (e.get("metadata") or {}).get("unresolved"), "edge_ord": i, "id": f"{e['kind']}:{e['from_id']}->{e['to_id']}"}
        | {k: v for k, v in e.items() if k != "metadata"}
        | {"metadata_json": canonical_json(e.get("metadata"))}
        for i, e in enumerate(edges)
    ]
    tables = [{"profile_json": canonical_json(p.get("profile"))} | {k: v for k, v in p.items() if k != "profile"} for p in table_profiles]
    columns = [{"profile_json": canonical_json(p.get("profile"))} | {k: v for k, v in p.items() if k != "profile"} for p in column_profiles]
    return Graph(_frame(spark, made, OBJECTS), _frame(spark, linked, EDGES), _frame(spark, tables, TABLE_PROFILES), _frame(spark, columns, COLUMN_PROFILES), **about)


def _frame(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    kinds = spark.createDataFrame([], schema).schema
    unknown = {k for r in rows for k in r} - set(kinds.names)
    if unknown:
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    return spark.createDataFrame([tuple(r.get(f.name) for f in kinds.fields) for r in rows], kinds)


def ordered_objects(objects: DataFrame) -> DataFrame:
    """obj_ord by (kind, full name, id): the order that a finished catalog has."""
    return objects.withColumn("obj_ord", (F.row_number().over(W.orderBy("kind", "full_name", "id")) - 1).cast("bigint"))


def ordered_edges(edges: DataFrame) -> DataFrame:
    return edges.withColumn("edge_ord", (F.row_number().over(W.orderBy("kind", "from_id", "to_id", "id")) - 1).cast("bigint"))
