"""Synthetic catalogs of any size, made in Spark."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from catalens.model import EDGES, OBJECTS, Graph, graph


def synthetic(spark: SparkSession, tables: int, columns: int) -> Graph:
    """`tables` tables with `columns` bigint columns each: tables x (columns + 1) objects, tables x columns edges."""
    empty = graph(spark, [])
    t = spark.range(tables).select(F.col("id").alias("t"), F.format_string("table_%05d", "id").alias("table_name"))
    full = F.concat(F.lit("public."), "table_name")
    made = t.select(
        F.concat(F.lit("table:"), full).alias("id"), F.lit("table").alias("kind"), F.col("table_name").alias("name"), full.alias("full_name"), F.lit("public").alias("schema_name"), "table_name",
        F.struct(F.lit("BASE TABLE").alias("table_type"), F.lit(None).cast("string").alias("comment")).alias("table"), (F.col("t") * (columns + 1)).alias("obj_ord"),
    )
    c = t.select("t", "table_name", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("c")) if columns > 0 else t.limit(0).withColumn("c", F.lit(0))
    c = c.withColumn("column_name", F.format_string("column_%04d", "c"))
    name = F.concat(F.lit("public."), "table_name", F.lit("."), "column_name")
    facet = F.struct(F.lit("bigint").alias("data_type"), F.lit("numeric").alias("data_type_family"), (F.col("c") != 0).alias("nullable"), F.lit(None).cast("string").alias("default"), F.lit(None).cast("string").alias("comment"))
    cols = c.select(
        F.concat(F.lit("column:"), name).alias("id"), F.lit("column").alias("kind"), F.col("column_name").alias("name"), name.alias("full_name"), F.lit("public").alias("schema_name"), "table_name", "column_name",
        facet.alias("column"), (F.col("t") * (columns + 1) + F.col("c") + 1).alias("obj_ord"),
    )
    base = spark.createDataFrame([], OBJECTS)
    objects = base.unionByName(made, allowMissingColumns=True).unionByName(cols, allowMissingColumns=True).fillna({"metadata_json": "{}", "deprecated": False})
    links = c.select(
        F.concat(F.lit("has_column:"), name).alias("id"), F.lit("has_column").alias("kind"), F.concat(F.lit("table:public."), "table_name").alias("from_id"), F.concat(F.lit("column:"), name).alias("to_id"),
        F.lit(1.0).alias("confidence"), F.lit("{}").alias("metadata_json"), (F.col("t") * columns + F.col("c")).alias("edge_ord"),
    )
    edges = spark.createDataFrame([], EDGES).unionByName(links, allowMissingColumns=True)
    return empty.with_(objects=objects, edges=edges, provider="synthetic", database="synthetic")
