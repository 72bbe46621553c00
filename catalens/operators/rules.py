"""The analysis rules: each is one filter or join over the catalog relations and yields findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalens.functions import scalars as S
from catalens.model import Graph

SCOPES = ("risk", "quality", "performance")
SEVERITIES = ("critical", "high", "medium", "low")
RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}

# Rule id, scope, severity, confidence, tags. The texts are this engine's own.
RULES = (
    ("risk.sensitive_column", "risk", "high", 0.9, ("risk", "pii", "privacy"), "Sensitive column", "The column's name, type or comment suggests personal or secret data.", "Reads without control can expose people or credentials.", "Restrict access, mask the value downstream and leave it out of broad projections."),
    ("risk.query_reads_sensitive_column", "risk", "high", 0.85, ("risk", "pii", "sql"), "Statement touches a sensitive column", "A statement reads, joins or filters by a sensitive column.", "The value can travel further than intended.", "Select only what is needed and mask the value where possible."),
    ("risk.select_star", "risk", "medium", 0.8, ("risk", "sql", "projection"), "Statement selects every column", "A statement has SELECT *.", "Columns added later are exposed or cost more without notice.", "Name the columns that are needed."),
    ("risk.update_without_where", "risk", "high", 0.9, ("risk", "sql", "write"), "UPDATE of every row", "An UPDATE has no WHERE clause.", "All rows of the table change.", "Add a WHERE clause, or ask for confirmation before it runs."),
    ("risk.delete_without_where", "risk", "high", 0.9, ("risk", "sql", "write"), "DELETE of every row", "A DELETE has no WHERE clause.", "All rows of the table go.", "Add a WHERE clause, or ask for confirmation before it runs."),
    ("quality.missing_primary_key", "quality", "medium", 0.85, ("quality", "constraint", "primary_key"), "No primary key", "The table declares no primary key.", "Rows cannot be addressed reliably.", "Declare a primary key, or note why the table needs none."),
    ("quality.probable_missing_fk", "quality", "medium", 0.7, ("quality", "constraint", "foreign_key"), "Foreign key probably missing", "A column is named like a reference, but none is declared.", "Only applications keep the relation whole.", "Declare the foreign key, or note why there is none."),
    ("quality.deprecated_object_used", "quality", "medium", 0.8, ("quality", "semantics", "deprecated"), "Deprecated object in use", "Annotations deprecate the object, but statements use it.", "New work may build on what is to go.", "Move its users to the replacement, or take the mark back."),
    ("performance.filter_without_index", "performance", "medium", 0.75, ("performance", "index", "filter"), "Filter without an index", "A statement filters by a column that no index covers.", "Filters may scan the whole table as it grows.", "Look at the plan, then consider an index on the column."),
    ("performance.join_without_index", "performance", "medium", 0.75, ("performance", "index", "join"), "Join without an index", "A statement joins on a column that no index covers.", "Joins slow down as the tables grow.", "Look at the plan, then consider an index on the column."),
    ("data.enum_like_without_constraint", "quality", "low", 0.65, ("quality", "data_profile", "business_rule"), "Few values, no constraint", "The sampled values are few, but nothing constrains them.", "Unexpected values can enter unnoticed.", "Add a check constraint, an enumeration or a reference table."),
    ("data.high_null_rate", "quality", "medium", 0.6, ("quality", "data_profile", "nullability"), "Mostly null", "More than half of the sampled values of an important column are null.", "Reports and filters must handle missing values.", "Confirm that null is meant, or require a value."),
    ("data.negative_numeric_sample", "quality", "medium", 0.65, ("quality", "data_profile", "numeric"), "Negative amount", "A quantity or amount has negative sampled values.", "Billing and stock rules may break.", "Confirm that negative values are meant, or add a check constraint."),
    ("data.unstable_format_sample", "quality", "low", 0.55, ("quality", "data_profile", "format"), "Several formats", "An identifier-like column has sampled values of several formats.", "Joins and parsing become unreliable.", "Bring the values to one format, or note all that are allowed."),
)
RULE_SCHEMA = "rule_id string, scope string, severity string, confidence double, tags array<string>, title string, description string, impact string, suggested_fix string"

READS = ("reads_from", "filters_by", "joins_on")
USES = (*READS, "writes_to")


def rule_table(spark) -> DataFrame:
    return spark.createDataFrame([(a, b, c, d, list(e), f, g, h, i) for a, b, c, d, e, f, g, h, i in RULES], RULE_SCHEMA)


def _found(rows: DataFrame, rule: str | Column, obj: Column, message: str, evidence: Column, related: Column | None = None, order: Column | None = None) -> DataFrame:
    return rows.select(
        (F.lit(rule) if isinstance(rule, str) else rule).alias("rule_id"), obj.alias("object"), F.lit(message).alias("message"), evidence.alias("evidence"),
        (F.array().cast("array<string>") if related is None else related).alias("related_objects"), (F.lit(0) if order is None else order).cast("bigint").alias("ord"),
    )


def _key() -> Column:
    return S.table_column_key(F.col("schema_name"), F.col("table_name"), F.col("column_name"))


def _uses(g: Graph, kinds: tuple[str, ...]) -> DataFrame:
    """Edges of these kinds with the object they reach and the name of the one they leave."""
    names = g.objects.select(F.col("id").alias("from_id"), F.col("full_name").alias("from_name"))
    reached = g.objects.select(F.col("id").alias("to_id"), "full_name", F.col("kind").alias("object_kind"), "schema_name", "table_name", "column_name", "deprecated")
    return g.edges.where(F.col("kind").isin(*kinds)).join(reached, "to_id").join(names, "from_id", "left").withColumn("by", F.coalesce("from_name", "from_id"))


def _edge_evidence() -> Column:
    return F.concat("kind", F.lit(" edge from "), "from_id")


def sensitive_columns(g: Graph) -> DataFrame:
    return g.column_profiles.where(F.col("pii_score") >= S.SENSITIVE_FROM).select(F.col("object_id").alias("to_id"), "pii_score")


def risk_rules(g: Graph) -> list[DataFrame]:
    sensitive = sensitive_columns(g)
    named = sensitive.join(g.objects.select(F.col("id").alias("to_id"), "full_name", "obj_ord"), "to_id")
    touched = _uses(g, READS).join(sensitive, "to_id", "left_semi")
    queries = g.objects.where("kind = 'query'").withColumn("sql", F.coalesce("normalized_sql", F.lit("")))
    upper = F.upper("sql")
    out = [
        _found(named, "risk.sensitive_column", F.col("full_name"), "Column looks sensitive", F.format_string("piiScore=%s", F.round("pii_score", 2).cast("string")), order=F.col("obj_ord")),
        _found(touched, "risk.query_reads_sensitive_column", F.col("full_name"), "Statement uses a sensitive column", _edge_evidence(), F.array("by"), F.col("edge_ord")),
        _found(queries.where(F.contains(upper, F.lit("SELECT *"))), "risk.select_star", F.col("full_name"), "Statement selects all columns", S.preview(F.col("sql")), order=F.col("obj_ord")),
    ]
    for word, rule in (("UPDATE", "risk.update_without_where"), ("DELETE", "risk.delete_without_where")):
        bare = queries.where((upper.startswith(word + " ") | F.contains(upper, F.lit(f"; {word} "))) & ~S.statement_has_where(F.col("sql"), word))
        out.append(_found(bare, rule, F.col("full_name"), f"{word} without WHERE", S.preview(F.col("sql")), order=F.col("obj_ord")))
    return out


def _constraint_columns(g: Graph, kinds: tuple[str, ...]) -> DataFrame:
    return g.objects.where(F.col("kind").isin(*kinds)).select("schema_name", "table_name", F.explode("constraint.columns").alias("column_name")).select(_key().alias("key"))


def quality_rules(g: Graph) -> list[DataFrame]:
    tables = g.objects.where("kind = 'table'").withColumn("key", F.concat_ws(".", "schema_name", F.coalesce("table_name", "name")))
    keyed = g.objects.where("kind = 'primary_key'").select(F.concat_ws(".", "schema_name", "table_name").alias("key"))
    columns = g.objects.where("kind = 'column' AND column_name IS NOT NULL")
    pointing = columns.where(F.col("column_name").endswith("_id") & (F.col("column_name") != "id") & ~S.is_local_identifier(F.col("column_name"), F.col("table_name"))).withColumn("key", _key())
    ends = g.edges.where("kind = 'references'").select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    free = pointing.join(_constraint_columns(g, ("foreign_key",)), "key", "left_anti").join(ends, "id", "left_anti")
    gone = _uses(g, USES).where("deprecated")
    first = gone.withColumn("n", F.row_number().over(W.partitionBy("to_id").orderBy("edge_ord"))).where("n = 1")
    return [
        _found(tables.join(keyed, "key", "left_anti"), "quality.missing_primary_key", F.col("full_name"), "Table has no primary key", F.lit("no primary_key object found for table"), order=F.col("obj_ord")),
        _found(free, "quality.probable_missing_fk", F.col("full_name"), "Column looks like a foreign key without a constraint", F.format_string("column name `%s` ends with _id", "column_name"), order=F.col("obj_ord")),
        _found(first, "quality.deprecated_object_used", F.col("full_name"), "Statements use a deprecated object", _edge_evidence(), F.array("by"), F.col("edge_ord")),
    ]


def indexed_columns(g: Graph, leading_only: bool = False) -> DataFrame:
    """Keys of columns that an index, a primary key or a unique constraint has, in any place or in the first."""
    cols = F.slice("index.columns", 1, 1) if leading_only else F.col("index.columns")
    indexes = g.objects.where("kind = 'index'").select("schema_name", "table_name", F.explode(cols).alias("column_name")).select(_key().alias("key"))
    return indexes.union(_constraint_columns(g, ("primary_key", "unique_constraint"))).distinct()


def performance_rules(g: Graph, leading_only: bool = False) -> list[DataFrame]:
    used = _uses(g, ("filters_by", "joins_on")).where("object_kind = 'column'").withColumn("key", _key())
    bare = used.join(indexed_columns(g, leading_only), "key", "left_anti")
    first = bare.withColumn("n", F.row_number().over(W.partitionBy("kind", "key").orderBy("edge_ord"))).where("n = 1")
    rule = F.when(F.col("kind") == "filters_by", "performance.filter_without_index").otherwise("performance.join_without_index")
    return [_found(first, rule, F.col("full_name"), "Statements use the column without an index", _edge_evidence(), F.array("by"), F.col("edge_ord"))]


def _runs(name: Column) -> Column:
    """All names that a dotted name holds as whole words: orders_status_check holds orders, orders_status and so on."""

    def of_part(part: Column) -> Column:
        words = F.split(part, "_")
        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(F.sequence(F.lit(1), F.size(words) - i + 1), lambda n: F.array_join(F.slice(words, i, n), "_"))))

    return F.array_distinct(F.flatten(F.transform(F.split(name, r"\."), of_part)))


def data_rules(g: Graph) -> list[DataFrame]:
    rows = g.column_profiles.where("summary IS NOT NULL").join(g.objects, F.col("object_id") == F.col("id"))
    bound = g.objects.where(F.col("kind").isin("check_constraint", "enum"))
    bound = bound.select(F.explode(F.array_union(F.array("table_name"), _runs(F.col("full_name")))).alias("table_name"), F.col("constraint.columns").alias("columns"))
    # Constraints that name no columns cover all of their table.
    whole = bound.where("columns IS NULL").select("table_name").distinct()
    named = bound.select("table_name", F.explode("columns").alias("column_name")).distinct()
    s = "summary."
    few = rows.where((F.col(s + "inferred_shape") == "enum_like") & (F.col(s + "distinct_count") > 1))
    few = few.join(whole, "table_name", "left_anti").join(named, ["table_name", "column_name"], "left_anti")
    total = F.col(s + "observed_non_null") + F.col(s + "observed_null")
    empty = rows.where((total >= 5) & (F.col(s + "observed_null") * 2 > total) & S.is_important(F.col("column_name")))
    below = rows.where((F.col(s + "inferred_shape") == "numeric") & (F.col(s + "numeric_min") < 0) & S.is_never_negative(F.col("column_name")))
    mixed = rows.where((F.col(s + "observed_non_null") >= 5) & (F.size(s + "format_shapes") > 1) & S.is_format_sensitive(F.col("column_name")))
    name, order = F.col("full_name"), F.col("obj_ord")
    return [
        _found(few, "data.enum_like_without_constraint", name, "Few sampled values, but no constraint", F.format_string("distinctCount=%d; source=sample", s + "distinct_count"), order=order),
        _found(empty, "data.high_null_rate", name, "Many sampled nulls in an important column", F.format_string("observedNull=%d; observedNonNull=%d", s + "observed_null", s + "observed_non_null"), order=order),
        _found(below, "data.negative_numeric_sample", name, "Negative sampled values in an amount", F.concat(F.lit("numericMin="), F.round(s + "numeric_min", 6).cast("string")), order=order),
        _found(mixed, "data.unstable_format_sample", name, "Several sampled formats in an identifier", F.format_string("formatShapeCount=%d; source=sample", F.size(s + "format_shapes")), order=order),
    ]


def described(found: DataFrame) -> DataFrame:
    """Findings with their rule's scope, severity and texts, and a fingerprint that survives rewording."""
    rules = rule_table(found.sparkSession)
    out = found.join(F.broadcast(rules), "rule_id", "left")
    return out.withColumn("fingerprint", S.finding_fingerprint(F.col("rule_id"), F.col("object"), F.col("related_objects")))


def severity_rank(severity: Column) -> Column:
    out = F.lit(0)
    for name, n in RANK.items():
        out = F.when(severity == name, n).otherwise(out)
    return out


def in_order(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc(severity_rank(F.col("severity"))), "rule_id", "object", "ord", "evidence")


def analyze(g: Graph, scope: str = "all", leading_only: bool = False) -> DataFrame:
    """All findings of a scope, worst first."""
    from catalens.model import ConfigError

    if scope not in (*SCOPES, "all"):
        raise ConfigError(f"scope must be all or one of {', '.join(SCOPES)}")
    parts: list[DataFrame] = []
    if scope in ("all", "risk"):
        parts += risk_rules(g)
    if scope in ("all", "quality"):
        parts += quality_rules(g) + data_rules(g)
    if scope in ("all", "performance"):
        parts += performance_rules(g, leading_only)
    return in_order(described(reduce(DataFrame.unionByName, parts)))
