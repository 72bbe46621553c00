"""Staging relations of any provider to the canonical graph: one projection for each entity, then a union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalens.functions.scalars import is_system_schema
from catalens.model import COLUMN_PROFILES, EDGES, OBJECTS, TABLE_PROFILES, Graph, ordered_edges, ordered_objects

STAGING = {
    "schemas": "schema_name string, comment string",
    "tables": "schema_name string, table_name string, table_type string, comment string",
    "columns": "schema_name string, table_name string, column_name string, ordinal int, data_type string, data_type_family string, nullable boolean, `default` string, comment string",
    "constraints": "schema_name string, table_name string, constraint_name string, constraint_type string, columns array<string>, ref_schema string, ref_table string, ref_columns array<string>, check_expression string, on_delete string, on_update string",
    "indexes": "schema_name string, table_name string, index_name string, `unique` boolean, columns array<string>, expression string, predicate string",
    "views": "schema_name string, view_name string, materialized boolean, definition string",
    "routines": "schema_name string, routine_name string, arguments string, routine_kind string, returns string",
    "triggers": "schema_name string, table_name string, trigger_name string, function_schema string, function_name string, definition string",
    "enums": "schema_name string, enum_name string, labels array<string>",
    "sequences": "schema_name string, sequence_name string, table_name string, column_name string",
    "table_stats": "schema_name string, table_name string, row_estimate bigint, row_count_kind string, size_bytes bigint, source string",
    "column_stats": "schema_name string, table_name string, column_name string, null_fraction double, distinct_estimate double, avg_width int, histogram_bounds int, common_values int",
}
# Codes of constraint kinds and of referential actions.
CONSTRAINT_KINDS = {"p": "primary_key", "f": "foreign_key", "u": "unique_constraint", "c": "check_constraint"}
ACTIONS = {"a": "NO ACTION", "r": "RESTRICT", "c": "CASCADE", "n": "SET NULL", "d": "SET DEFAULT"}


def staging(spark: SparkSession, **rows: list[tuple]) -> dict[str, DataFrame]:
    """Staging relations from what a provider read on the driver; those not given are empty."""
    return {k: spark.createDataFrame(rows.get(k, []), schema) for k, schema in STAGING.items()}


def _lookup(codes: dict[str, str], key: Column, other: str | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    found = F.try_element_at(table, key)
    return found if other is None else F.coalesce(found, F.lit(other))


def action_name(code: Column) -> Column:
    return F.when(code.isNotNull(), _lookup(ACTIONS, code, "UNKNOWN"))


def _id(kind: str | Column, *parts: str | Column) -> Column:
    return F.concat_ws(":", F.lit(kind) if isinstance(kind, str) else kind, F.concat_ws(".", *parts))


def _meta(**fields) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])) if fields else F.lit("{}")


def _objects(rows: DataFrame, kind: str | Column, id_: Column, full_name: Column, **more: Column) -> DataFrame:
    cols = {"id": id_, "kind": F.lit(kind) if isinstance(kind, str) else kind, "full_name": full_name, "metadata_json": F.lit("{}"), "deprecated": F.lit(False)} | more
    return rows.select(*[c.alias(k) for k, c in cols.items()])


def _edges(rows: DataFrame, kind: str, from_id: Column, to_id: Column, source: str, detail: Column) -> DataFrame:
    return rows.select(
        F.concat_ws(":", F.lit(kind), F.concat_ws("->", from_id, to_id)).alias("id"), F.lit(kind).alias("kind"), from_id.alias("from_id"), to_id.alias("to_id"),
        F.lit(1.0).alias("confidence"), F.array(F.struct(F.lit(source).alias("source"), detail.alias("detail"))).alias("evidence"), F.lit("{}").alias("metadata_json"),
    )


def canonicalize(stage: dict[str, DataFrame], provider: str, database: str, **about) -> Graph:
    """The graph of a catalog, without system schemas, in the one order of its objects and edges."""
    s = {k: v.where(~is_system_schema(F.col("schema_name"))) for k, v in stage.items()}
    C = F.col
    table_id = _id("table", "schema_name", "table_name")
    full = F.concat_ws(".", "schema_name", "table_name")
    place = {"schema_name": C("schema_name"), "table_name": C("table_name")}
    column_facet = F.struct("data_type", "data_type_family", "nullable", "default", "comment")
    kind = _lookup(CONSTRAINT_KINDS, C("constraint_type"), "check_constraint")
    ref_table = F.when(C("ref_schema").isNotNull() & C("ref_table").isNotNull(), F.concat_ws(".", "ref_schema", "ref_table"))
    constraint_facet = F.struct(C("columns"), ref_table.alias("referenced_table"), C("ref_columns").alias("referenced_columns"))
    routine = F.concat(F.concat_ws(".", "schema_name", "routine_name"), F.lit("("), F.coalesce("arguments", F.lit("")), F.lit(")"))
    expression_only = C("expression").isNotNull() & (F.coalesce(F.size("columns"), F.lit(0)) <= 0)
    objects = [
        _objects(s["schemas"], "schema", _id("schema", "schema_name"), C("schema_name"), schema_name=C("schema_name"), comment=C("comment"), metadata_json=_meta(comment=C("comment"))),
        _objects(s["tables"], "table", table_id, full, **place, table=F.struct("table_type", "comment"), comment=C("comment"), metadata_json=_meta(comment=C("comment"))),
        _objects(s["columns"], "column", _id("column", "schema_name", "table_name", "column_name"), F.concat_ws(".", "schema_name", "table_name", "column_name"), **place, column_name=C("column_name"), column=column_facet, comment=C("comment"), metadata_json=_meta(comment=C("comment"), ordinal=C("ordinal"))),
        _objects(s["constraints"], kind, _id("constraint", "schema_name", "table_name", "constraint_name"), F.concat_ws(".", "schema_name", "table_name", "constraint_name"), **place, constraint=constraint_facet, metadata_json=_meta(checkExpression=C("check_expression"), onDelete=action_name(C("on_delete")), onUpdate=action_name(C("on_update")))),
        _objects(s["indexes"], "index", _id("index", "schema_name", "table_name", "index_name"), F.concat_ws(".", "schema_name", "table_name", "index_name"), **place, index=F.struct("unique", "columns", "expression"), metadata_json=_meta(expressionIndex=F.when(expression_only, F.lit(True)), predicate=C("predicate"))),
        _objects(s["views"], F.when(C("materialized"), "materialized_view").otherwise("view"), _id("view", "schema_name", "view_name"), F.concat_ws(".", "schema_name", "view_name"), schema_name=C("schema_name"), table_name=C("view_name"), metadata_json=_meta(definition=C("definition"))),
        _objects(s["routines"], F.when(C("routine_kind") == "procedure", "procedure").otherwise("function"), F.concat(F.lit("routine:"), routine), routine, schema_name=C("schema_name"), metadata_json=_meta(returns=C("returns"))),
        _objects(s["triggers"], "trigger", _id("trigger", "schema_name", "table_name", "trigger_name"), F.concat_ws(".", "schema_name", "table_name", "trigger_name"), **place, metadata_json=_meta(definition=C("definition"))),
        _objects(s["enums"], "enum", _id("enum", "schema_name", "enum_name"), F.concat_ws(".", "schema_name", "enum_name"), schema_name=C("schema_name"), metadata_json=_meta(labels=C("labels"))),
        _objects(s["sequences"], "sequence", _id("sequence", "schema_name", "sequence_name"), F.concat_ws(".", "schema_name", "sequence_name"), schema_name=C("schema_name"), metadata_json=_meta(ownedBy=F.concat_ws(".", "table_name", "column_name"))),
    ]
    constraint_id = _id("constraint", "schema_name", "table_name", "constraint_name")
    keys = s["constraints"].where("constraint_type = 'f' AND ref_schema IS NOT NULL AND ref_table IS NOT NULL")
    told = F.concat(C("constraint_name"), F.lit(" references "), ref_table, F.lit("("), F.array_join(F.coalesce("ref_columns", F.array()), ", "), F.lit(")"))
    trigger_id = _id("trigger", "schema_name", "table_name", "trigger_name")
    edges = [
        _edges(s["columns"], "has_column", table_id, _id("column", "schema_name", "table_name", "column_name"), "catalog.columns", C("column_name")),
        _edges(s["constraints"], "has_constraint", table_id, constraint_id, "catalog.constraints", C("constraint_name")),
        _edges(keys, "references", constraint_id, _id("table", "ref_schema", "ref_table"), "catalog.constraints", told),
        _edges(s["indexes"], "has_index", table_id, _id("index", "schema_name", "table_name", "index_name"), "catalog.indexes", C("index_name")),
        _edges(s["triggers"], "triggered_by", table_id, trigger_id, "catalog.triggers", C("trigger_name")),
        _edges(s["triggers"].where("function_name IS NOT NULL"), "depends_on", trigger_id, F.concat(F.lit("routine:"), F.concat_ws(".", "function_schema", "function_name"), F.lit("()")), "catalog.triggers", C("function_name")),
    ]
    spark = stage["tables"].sparkSession
    named = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), objects, spark.createDataFrame([], OBJECTS))
    named = named.withColumn("name", F.when(C("kind").isin("function", "procedure"), F.regexp_extract("full_name", r"([^.]*\(.*)$", 1)).otherwise(F.substring_index("full_name", ".", -1)))
    linked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), edges, spark.createDataFrame([], EDGES))
    count_kind = F.coalesce("row_count_kind", F.when(C("row_estimate").isNotNull(), F.lit("estimate")))
    tables = _last(s["table_stats"].select(table_id.alias("object_id"), "row_estimate", count_kind.alias("row_count_kind"), "size_bytes", F.to_json(F.struct("source")).alias("profile_json")))
    family = s["columns"].select(_id("column", "schema_name", "table_name", "column_name").alias("object_id"), "data_type_family")
    columns = _last(s["column_stats"].select(_id("column", "schema_name", "table_name", "column_name").alias("object_id"), "null_fraction", "distinct_estimate", F.to_json(F.struct(C("avg_width").alias("avgWidth"), C("histogram_bounds").alias("histogramBoundsCount"), C("common_values").alias("mostCommonValueCount"))).alias("profile_json")))
    columns = spark.createDataFrame([], COLUMN_PROFILES).unionByName(columns.join(family, "object_id", "left"), allowMissingColumns=True)
    tables = spark.createDataFrame([], TABLE_PROFILES).unionByName(tables)
    return Graph(ordered_objects(named), ordered_edges(linked), tables, columns, provider, database, **about)


def _last(rows: DataFrame) -> DataFrame:
    """One profile for an object: of several the greatest, field by field, so that reruns agree."""
    rest = [c for c in rows.columns if c != "object_id"]
    best = W.partitionBy("object_id").orderBy(*[F.col(c).desc_nulls_last() for c in rest])
    return rows.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")
