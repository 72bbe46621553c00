"""Inferred references: columns whose names point to another table's identifier. An opt-in stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalens.functions import scalars as S
from catalens.model import Graph


def infer(g: Graph, ignored: tuple[str, ...] = ()) -> DataFrame:
    """Edges column -> identifier column, in the shape of the edges relation, ordered by their ends."""
    last = W.partitionBy("table_key").orderBy(F.desc("obj_ord"))
    tables = g.objects.where("kind = 'table'").select(S.normalize_name(F.col("full_name")).alias("table_key"), F.coalesce("table_name", "name").alias("target_table"), F.col("schema_name").alias("target_schema"), "obj_ord")
    tables = tables.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n", "obj_ord")
    columns = g.objects.where("kind = 'column'")
    ids = columns.where(F.lower("column_name") == "id").select(F.col("table_name").alias("target_table"), F.col("schema_name").alias("target_schema"), F.col("id").alias("to_id"), F.col("full_name").alias("to_name"), F.col("column.data_type_family").alias("to_family"))

    hint = S.target_table_hint(F.col("column_name"))
    pointing = columns.select("id", "full_name", "schema_name", "table_name", "column_name", F.col("column.data_type_family").alias("family"), hint.alias("hint"))
    pointing = pointing.where("hint IS NOT NULL AND lower(column_name) != 'id'")
    if ignored:
        pointing = pointing.where(~F.col("id").isin(*ignored) & ~F.col("full_name").isin(*ignored))
    # The hint itself, its singular, its plural: the first that names a table counts.
    spelt = pointing.select("*", F.posexplode(F.array("hint", S.singularize(F.col("hint")), S.pluralize(F.col("hint")))).alias("rank", "table_key"))
    found = spelt.join(tables, "table_key")
    first = W.partitionBy("id").orderBy("rank")
    found = found.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    linked = found.join(ids, (found["target_table"] == ids["target_table"]) & found["target_schema"].eqNullSafe(ids["target_schema"])).where(F.col("id") != F.col("to_id"))
    linked = linked.where("family IS NULL OR to_family IS NULL OR family = to_family")
    explicit = g.edges.where("kind = 'references'").select(F.col("from_id").alias("id"), "to_id").distinct()
    # Declared keys stand on constraints, not columns: their columns need no inference either.
    keyed = g.objects.where("kind = 'foreign_key'").select("schema_name", "table_name", F.explode("constraint.columns").alias("column_name"))
    linked = linked.join(explicit, ["id", "to_id"], "left_anti")
    linked = linked.join(keyed, linked["schema_name"].eqNullSafe(keyed["schema_name"]) & (linked["table_name"] == keyed["table_name"]) & (linked["column_name"] == keyed["column_name"]), "left_anti")
    top = g.edges.agg(F.coalesce(F.max("edge_ord"), F.lit(-1))).first()[0]
    order = F.row_number().over(W.orderBy("id", "to_id"))
    out = linked.select(
        F.concat(F.lit("inferred:"), "id", F.lit("->"), "to_id").alias("edge_id"), F.lit("inferred_reference").alias("kind"), F.col("id").alias("from_id"), "to_id",
        S.inference_confidence(F.col("column_name")).alias("confidence"),
        F.array(F.struct(F.lit("naming").alias("source"), F.concat("full_name", F.lit(" looks like it references "), "to_name").alias("detail"))).alias("evidence"),
        F.lit(None).cast("boolean").alias("unresolved"), F.lit("{}").alias("metadata_json"), (order + top).cast("bigint").alias("edge_ord"),
    )
    return out.withColumnRenamed("edge_id", "id")


def with_inferred(g: Graph, ignored: tuple[str, ...] = ()) -> Graph:
    return g.with_(edges=g.edges.unionByName(infer(g, ignored)))
