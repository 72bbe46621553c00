"""SQL texts as query objects and edges of the catalog, and what their references resolve to."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalens.functions import scalars as S
from catalens.lineage.parse import parse
from catalens.model import EDGES, OBJECTS, Graph

RESOLVED, UNRESOLVED = 0.9, 0.45
REFERENCE = "array<struct<kind:string,object_name:string,alias:string,resolved:boolean>>"
PARSED = f"source_path string, content string, status string, normalized_sql string, fingerprint string, kinds array<string>, diagnostics array<string>, refs {REFERENCE}"
#: Kinds in the order in which a name may mean them.
NAMED = ("table", "view")


def _parse_rows(dialect: str):
    def run(batches):
        for rows in batches:
            out = []
            for path, content in zip(rows["source_path"], rows["content"], strict=True):
                got = parse(content or "", dialect)
                refs = [{"kind": r.kind, "object_name": r.name, "alias": r.alias, "resolved": r.resolved} for r in got.references]
                out.append((path, content, got.status, got.normalized, got.fingerprint, [k for k, _ in got.statements], got.diagnostics, refs))
            yield pd.DataFrame(out, columns=["source_path", "content", "status", "normalized_sql", "fingerprint", "kinds", "diagnostics", "refs"])

    return run


def parse_files(files: DataFrame, dialect: str = "postgres") -> DataFrame:
    """files (source_path, content) with what each says; texts are parsed where they lie."""
    return files.select("source_path", "content").mapInPandas(_parse_rows(dialect), PARSED)


def artifacts(parsed: DataFrame, snapshot_id: str) -> DataFrame:
    """One stored row for each statement text of a snapshot; of equal ones the last path counts."""
    last = W.partitionBy("fingerprint").orderBy(F.desc("source_path"))
    rows = parsed.withColumn("n", F.row_number().over(last)).where("n = 1")
    return rows.select(F.concat(F.lit("query:"), "fingerprint").alias("id"), F.lit(snapshot_id).alias("snapshot_id"), "source_path", F.col("content").alias("raw_sql"), "normalized_sql", "fingerprint", "status", F.to_json("diagnostics").alias("diagnostics"), F.to_json("refs").alias("references_json"))


def references(parsed: DataFrame) -> DataFrame:
    """(source_path, fingerprint, ref_ord, kind, object_name, alias, resolved) of every reference."""
    return parsed.select("source_path", "fingerprint", F.posexplode("refs").alias("ref_ord", "r")).select("source_path", "fingerprint", "ref_ord", "r.*")


def resolve_names(objects: DataFrame, names: DataFrame) -> DataFrame:
    """(object_name, object_id, resolved_name) of the names that mean an object: an id or a full name; else a column by
    table.column or schema.table.column; else a table or view by its name, or schema and name. The first object counts."""
    table = F.coalesce("table_name", "name")
    exact = objects.select("id", "full_name", "obj_ord", F.lit(0).alias("rank"), F.explode(F.array("id", "full_name")).alias("object_name"))
    columns = objects.where("kind = 'column'").select(
        "id", "full_name", "obj_ord", F.lit(1).alias("rank"),
        F.explode(F.array(F.concat_ws(".", "table_name", "column_name"), F.concat_ws(".", "schema_name", "table_name", "column_name"))).alias("object_name"),
    )
    tables = objects.where(F.col("kind").isin(*NAMED)).select("id", "full_name", "obj_ord", F.lit(2).alias("rank"), F.explode(F.array(table, F.concat_ws(".", "schema_name", table))).alias("object_name"))
    known = exact.unionByName(columns).unionByName(tables)
    first = W.partitionBy("object_name").orderBy("rank", "obj_ord")
    best = known.withColumn("n", F.row_number().over(first)).where("n = 1")
    return names.select("object_name").distinct().join(best, "object_name").select("object_name", F.col("id").alias("object_id"), F.col("full_name").alias("resolved_name"))


def enrich(g: Graph, files: DataFrame, dialect: str = "postgres") -> tuple[Graph, DataFrame]:
    """The graph with a query object for each statement text and an edge for each reference, and the artifacts to store.

    Query objects and edges come after the catalog's own, by path and place in the text. Texts with equal fingerprints are
    one object with several paths.
    """
    parsed = parse_files(files, dialect).cache()
    tops = g.objects.agg(F.coalesce(F.max("obj_ord"), F.lit(-1))).first()[0], g.edges.agg(F.coalesce(F.max("edge_ord"), F.lit(-1))).first()[0]
    one = parsed.groupBy("fingerprint").agg(F.min("source_path").alias("source_path"), F.first("normalized_sql").alias("normalized_sql"), F.sort_array(F.collect_set("source_path")).alias("paths"))
    place = F.row_number().over(W.orderBy("source_path", "fingerprint")) + tops[0]
    meta = F.to_json(F.struct("fingerprint", F.col("normalized_sql").alias("normalizedSql"), F.col("source_path").alias("sourcePath"), F.col("paths").alias("sourcePaths")))
    made = one.select(
        F.concat(F.lit("query:"), "fingerprint").alias("id"), F.lit("query").alias("kind"), F.concat(F.lit("sql."), "source_path", F.lit(":"), "fingerprint").alias("full_name"),
        "normalized_sql", "fingerprint", F.lit(False).alias("deprecated"), meta.alias("metadata_json"), place.cast("bigint").alias("obj_ord"),
    ).withColumn("name", F.substring_index("full_name", ".", -1))
    empty_objects, empty_edges = (g.objects.sparkSession.createDataFrame([], s) for s in (OBJECTS, EDGES))
    objects = g.objects.unionByName(empty_objects.unionByName(made, allowMissingColumns=True).select(*g.objects.columns))

    refs = references(parsed)
    first = W.partitionBy("fingerprint", "ref_ord").orderBy("source_path")
    refs = refs.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    found = resolve_names(g.objects, refs)
    met = refs.join(found, "object_name", "left")
    base = F.when(F.col("resolved"), RESOLVED).otherwise(UNRESOLVED)
    hit = F.col("object_id").isNotNull()
    meta = F.to_json(F.struct("alias", F.col("object_name").alias("objectName"), F.col("resolved_name").alias("resolvedName"), (~hit & ~F.col("resolved")).alias("unresolved")))
    edges = met.select(
        F.concat_ws(":", F.lit("sql"), "fingerprint", "kind", F.col("ref_ord").cast("string")).alias("id"), "kind", F.concat(F.lit("query:"), "fingerprint").alias("from_id"),
        F.coalesce("object_id", "object_name").alias("to_id"), F.when(hit, F.greatest(base, F.lit(RESOLVED))).otherwise(base).alias("confidence"),
        F.array(F.struct(F.lit("sqlparser").alias("source"), F.concat("kind", F.lit(" "), "object_name").alias("detail"))).alias("evidence"),
        (~hit & ~F.col("resolved")).alias("unresolved"), meta.alias("metadata_json"),
        (F.row_number().over(W.orderBy("source_path", "fingerprint", "ref_ord")) + tops[1]).cast("bigint").alias("edge_ord"),
    )
    enriched = g.with_(objects=objects, edges=g.edges.unionByName(empty_edges.unionByName(edges)))
    return enriched, artifacts(parsed, g.snapshot_id)


def exists(objects: DataFrame, names: DataFrame) -> DataFrame:
    """The rows of names (object_name) whose last segment names a table, view or column."""
    kinds = objects.where(F.col("kind").isin("table", "view", "materialized_view", "column"))
    known = kinds.select(F.explode(F.array(S.normalize_name(F.col("name")), S.normalize_name(F.col("full_name")))).alias("k")).distinct()
    return names.join(known, S.normalize_name(F.col("object_name")) == F.col("k"), "left_semi")


def suggestions(objects: DataFrame, names: DataFrame, most: int = 5, distance: int = 2) -> DataFrame:
    """(object_name, suggestion, place): up to `most` full names that are near an unknown name, in their order."""
    kinds = objects.where(F.col("kind").isin("table", "view", "materialized_view", "column")).select("full_name", S.normalize_name(F.col("name")).alias("k"))
    asked = names.select("object_name").distinct().withColumn("w", S.normalize_name(F.col("object_name")))
    near = F.contains("k", F.col("w")) | F.contains(F.col("w"), F.col("k")) | (S.edit_distance(F.col("k"), F.col("w"), distance) >= 0)
    met = asked.join(kinds, near).select("object_name", F.col("full_name").alias("suggestion")).distinct()
    return met.withColumn("place", F.row_number().over(W.partitionBy("object_name").orderBy("suggestion"))).where(F.col("place") <= most)


def validate(g: Graph, sql: str, dialect: str = "postgres") -> dict:
    """Whether a text parses, what it refers to, which references are unknown, and what they may have meant. Never executed."""
    got = parse(sql, dialect)
    spark = g.objects.sparkSession
    refs = [(r.kind, r.name, r.alias, r.resolved) for r in got.references]
    table = spark.createDataFrame(refs, "kind string, object_name string, alias string, resolved boolean")
    named = table.where("kind != 'depends_on'")
    derived = {r.name for r in got.references if r.kind == "depends_on"}
    known = {r["object_name"] for r in exists(g.objects, named).select("object_name").distinct().collect()} if refs else set()
    unknown = sorted({r.name for r in got.references if r.kind != "depends_on" and r.name not in known and r.name not in derived and r.name.split(".")[0] not in derived})
    hints: dict[str, list[str]] = {}
    if unknown:
        for r in suggestions(g.objects, spark.createDataFrame([(u,) for u in unknown], "object_name string")).orderBy("object_name", "place").collect():
            hints.setdefault(r["object_name"], []).append(r["suggestion"])
    ok = got.status == "parsed"
    return {
        "parse_ok": ok, "valid": ok and not unknown, "executed": False, "dialect": dialect, "normalizedSql": got.normalized, "fingerprint": got.fingerprint,
        "statements": [{"kind": k, "sql": t} for k, t in got.statements], "diagnostics": got.diagnostics,
        "references": [{"kind": r.kind, "objectName": r.name, "alias": r.alias, "resolved": r.resolved} for r in got.references],
        "unresolved": [{"name": u, "suggestions": hints.get(u, [])} for u in unknown],
    }
