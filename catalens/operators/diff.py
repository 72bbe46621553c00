"""What changed between two catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RENAME_REASON = "went and came in one schema as the same kind: may be one object under a new name"
_FACETS = (("column.data_type", "column type changed"), ("column.nullable", "column nullability changed"), ("column.default", "column default changed"), ("constraint", "constraint metadata changed"), ("index", "index metadata changed"), ("table", "table metadata changed"), ("metadata_json", "object metadata changed"))


def by_name(objects: DataFrame) -> DataFrame:
    """One object for each full name: of several the last in order."""
    last = W.partitionBy("full_name").orderBy(F.desc("obj_ord"))
    return objects.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")


def _get(side: str, path: str) -> Column:
    out = F.col(f"{side}.o")
    for part in path.split("."):
        out = out[part]
    return out


def paired(previous: DataFrame, latest: DataFrame) -> DataFrame:
    """Both sides' objects as structs p.o and l.o, matched by full name."""
    p = by_name(previous).select("full_name", F.struct("*").alias("o")).alias("p")
    n = by_name(latest).select("full_name", F.struct("*").alias("o")).alias("l")
    return p.join(n, F.col("p.full_name") == F.col("l.full_name"), "full_outer")


def changes(previous: DataFrame, latest: DataFrame) -> DataFrame:
    """(change, full_name, kind, details), added before removed before changed, then by name."""
    told = [F.when(~_get("p", "kind").eqNullSafe(_get("l", "kind")), F.concat(F.lit("kind changed from "), _get("p", "kind"), F.lit(" to "), _get("l", "kind")))]
    told += [F.when(~_get("p", path).eqNullSafe(_get("l", path)), F.lit(text)) for path, text in _FACETS]
    both = paired(previous, latest)
    kind = F.when(F.col("p.full_name").isNull(), "added").when(F.col("l.full_name").isNull(), "removed").otherwise("changed")
    details = F.when(kind == "changed", F.array_compact(F.array(*told))).otherwise(F.array().cast("array<string>"))
    out = both.select(kind.alias("change"), F.coalesce("l.full_name", "p.full_name").alias("full_name"), F.coalesce(_get("l", "kind"), _get("p", "kind")).alias("kind"), details.alias("details"))
    out = out.where((F.col("change") != "changed") | (F.size("details") > 0))
    rank = F.when(F.col("change") == "added", 0).when(F.col("change") == "removed", 1).otherwise(2)
    return out.orderBy(rank, "full_name")


def rename_candidates(previous: DataFrame, latest: DataFrame) -> DataFrame:
    """(from_full_name, to_full_name, reason): objects that went and came with the same kind, schema and a similar shape."""
    p, n = by_name(previous), by_name(latest)
    cols = ["full_name", "kind", "schema_name", "table_name", "column_name"]
    gone = p.join(n, "full_name", "left_anti").select(*[F.col(c).alias(f"p_{c}") for c in cols])
    new = n.join(p, "full_name", "left_anti").select(*[F.col(c).alias(f"l_{c}") for c in cols])
    alike = (F.col("p_kind") == "table") | F.col("p_table_name").eqNullSafe(F.col("l_table_name")) | F.col("p_column_name").eqNullSafe(F.col("l_column_name"))
    met = gone.join(new, (F.col("p_kind") == F.col("l_kind")) & F.col("p_schema_name").eqNullSafe(F.col("l_schema_name")) & alike)
    return met.select(F.col("p_full_name").alias("from_full_name"), F.col("l_full_name").alias("to_full_name"), F.lit(RENAME_REASON).alias("reason")).orderBy("from_full_name", "to_full_name")
