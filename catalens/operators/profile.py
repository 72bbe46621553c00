"""Column profiles of data tables in one pass, and how they and privacy scores enter a catalog's profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalens.functions import scalars as S
from catalens.model import SUMMARY, Graph

EXAMPLES, DISTINCT_SHAPES = 5, 50
#: Characters of a value or shape beyond which its digest stands for it.
LONG = 64
MODES = ("schema", "stats", "sample")


def profile(rows: DataFrame, columns: list[str] | None = None, temporal: tuple[str, ...] = ()) -> DataFrame:
    """(column_name, non_null, nulls, n_distinct, shape, numeric_min, numeric_max, n_shapes, shapes) for each column.

    Columns become rows before they are counted, so exact distinct counts for any number of columns cost one partial
    aggregation by (column, value) and one exchange; values repeat, so little of a table is shuffled. Long values and shapes
    go by their digests, so a column of whole texts costs a digest a row. shapes are the first DISTINCT_SHAPES in order, n_shapes
    counts them all; no task holds all values or shapes of a column.
    """
    columns = columns or rows.columns
    times = set(temporal) | {c for c, t in rows.dtypes if t.startswith(("timestamp", "date"))}
    texts = {c for c, t in rows.dtypes if t == "string"}
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    text = F.col("column_name").isin(*texts) if texts else F.lit(False)
    short = lambda c: F.when(F.length(c) > LONG, F.sha2(c, 256)).otherwise(c)
    values = rows.select(F.explode(pairs).alias("p")).select("p.*")
    values = values.select("column_name", short(F.col("value")).alias("value"), S.numeric_value(F.col("value")).alias("number"))
    # The number follows from the value; as a key it leaves the count to be hashed.
    values = values.groupBy("column_name", "value", "number").agg(F.count("*").alias("n"))
    number, known = F.col("number"), F.col("value").isNotNull()
    per = values.groupBy("column_name").agg(
        F.sum(F.when(known, F.col("n")).otherwise(0)).alias("non_null"),
        F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("nulls"),
        F.count("value").alias("n_distinct"),
        F.coalesce(F.bool_and(F.when(known, number.isNotNull())), F.lit(False)).alias("all_numeric"),
        F.min(number).alias("numeric_min"),
        F.max(number).alias("numeric_max"),
    )
    # Of text columns alone, and counted once for both uses.
    written = F.array(*[F.struct(F.lit(c).alias("column_name"), short(S.format_shape(F.col(c))).alias("form")) for c in columns if c in texts] or [F.struct(F.lit("").alias("column_name"), F.lit(None).cast("string").alias("form"))])
    forms = rows.select(F.explode(written).alias("p")).select("p.*").where("form IS NOT NULL").distinct()
    n_forms = forms.groupBy("column_name").agg(F.count("*").alias("n_shapes"))
    first = forms.withColumn("place", F.row_number().over(W.partitionBy("column_name").orderBy("form"))).where(F.col("place") <= DISTINCT_SHAPES)
    first = first.groupBy("column_name").agg(F.array_sort(F.collect_list("form")).alias("shapes"))
    per = per.join(n_forms, "column_name", "left").join(first, "column_name", "left")
    when = F.col("column_name").isin(*times) if times else F.lit(False)
    found = F.when(when & (F.col("non_null") > 0), "timestamp").otherwise(S.infer_shape(F.col("non_null"), F.col("n_distinct"), F.col("all_numeric"), text))
    return per.select("column_name", "non_null", "nulls", "n_distinct", found.alias("shape"), "numeric_min", "numeric_max", F.coalesce("n_shapes", F.lit(0)).cast("bigint").alias("n_shapes"), F.coalesce("shapes", F.array().cast("array<string>")).alias("shapes"))


def summarize(rows: DataFrame, value: str, order: str, sensitive: bool | Column = False, store_raw: bool = False, strategy: str = "redact", temporal: bool = False, text: bool = True) -> DataFrame:
    """One struct column `summary` over a sample: counts, shape, range, formats and the first distinct examples, masked
    where the column is sensitive or raw values may not be stored."""
    v = F.col(value).cast("string")
    first = rows.select(v.alias("v"), F.col(order).alias("o")).groupBy("v").agg(F.min("o").alias("o"), F.count("*").alias("n"))
    hidden = F.lit(sensitive) if isinstance(sensitive, bool) else sensitive
    shown = F.when(hidden | F.lit(not store_raw), S.mask_value(F.col("v"), strategy)).otherwise(F.col("v"))
    number = S.numeric_value(F.col("v"))
    known = F.col("v").isNotNull()
    got = first.agg(
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("observed_non_null"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("observed_null"),
        F.array_sort(F.collect_list(F.when(known, F.struct("o", shown.alias("x"))))).alias("ex"),
        F.count("v").alias("distinct_count"),
        F.coalesce(F.bool_and(F.when(known, number.isNotNull())), F.lit(False)).alias("all_numeric"),
        F.min(number).alias("numeric_min"),
        F.max(number).alias("numeric_max"),
        F.array_sort(F.collect_set(F.when(known, S.format_shape(F.col("v"))))).alias("format_shapes"),
    )
    shape = S.infer_shape(F.col("observed_non_null"), F.col("distinct_count"), F.col("all_numeric"), F.lit(text), temporal)
    return got.select(
        F.struct(
            "observed_non_null", "observed_null", hidden.alias("sensitive"), F.slice("ex.x", 1, EXAMPLES).alias("examples"), "distinct_count",
            shape.alias("inferred_shape"), "numeric_min", "numeric_max", "format_shapes", F.lit("sample").alias("source"),
        ).cast(" ".join(SUMMARY.split())).alias("summary")
    )


def privacy_scores(objects: DataFrame, terms: tuple[str, ...] = S.PII_TERMS) -> DataFrame:
    """(object_id, pii_score, pii_reasons) of every column object that scores at all."""
    described = F.lower(F.concat_ws(" ", "name", "full_name", "column.data_type", "column.comment", "comment"))
    columns = objects.where("kind = 'column'")
    scored = columns.select(F.col("id").alias("object_id"), S.pii_score(described, F.coalesce("column_name", F.lit("")), terms).alias("pii_score"), S.pii_reasons(described, terms).alias("pii_reasons"))
    return scored.where("pii_score > 0")


def with_privacy(g: Graph, terms: tuple[str, ...] = S.PII_TERMS) -> Graph:
    """Column profiles with scores: profiles are made where there are none."""
    scores = privacy_scores(g.objects, terms)
    families = g.objects.select(F.col("id").alias("object_id"), F.col("column.data_type_family").alias("family"))
    met = g.column_profiles.alias("p").join(scores.alias("s"), F.col("p.object_id") == F.col("s.object_id"), "full_outer").join(families.alias("f"), F.coalesce("p.object_id", "s.object_id") == F.col("f.object_id"), "left")
    out = met.select(
        F.coalesce("p.object_id", "s.object_id").alias("object_id"), F.coalesce("p.data_type_family", "f.family").alias("data_type_family"), "p.null_fraction", "p.distinct_estimate",
        F.coalesce("s.pii_score", "p.pii_score").alias("pii_score"), F.coalesce("s.pii_reasons", "p.pii_reasons").alias("pii_reasons"), "p.summary", F.coalesce("p.profile_json", F.lit("{}")).alias("profile_json"),
    )
    return g.with_(column_profiles=out)


def with_policy(g: Graph, mode: str, max_rows: int = 100, mask_pii: bool = True, store_raw: bool = False) -> Graph:
    """What a profiling mode leaves of the profiles, and its mark on each."""
    check_options(mode, max_rows, store_raw)
    source = {"schema": "schema", "stats": "catalog_statistics", "sample": "safe_sample"}[mode]
    tables, columns = g.table_profiles, g.column_profiles
    if mode == "schema":
        tables, columns = tables.limit(0), columns.limit(0)
    mark = F.to_json(F.map_concat(F.coalesce(F.from_json("profile_json", "map<string,string>"), F.create_map().cast("map<string,string>")), F.create_map(F.lit("source"), F.lit(source))))
    about = {"mode": mode, "maxRowsPerTable": max_rows, "maskPii": mask_pii, "storeRawSamples": store_raw, "source": source}
    unmarked = lambda rows: rows.withColumn("profile_json", F.to_json(F.map_filter(F.from_json("profile_json", "map<string,string>"), lambda k, v: k != "source")))
    return g.with_(table_profiles=unmarked(tables).withColumn("profile_json", mark), column_profiles=unmarked(columns).withColumn("profile_json", mark), metadata=g.metadata | {"profiling": about})


def check_options(mode: str, max_rows: int, store_raw: bool) -> None:
    from catalens.model import ConfigError

    if mode not in MODES:
        raise ConfigError(f"profiling mode must be one of {', '.join(MODES)}")
    if mode == "sample" and max_rows <= 0:
        raise ConfigError("sample profiling needs maxRowsPerTable above 0")
    if store_raw and mode != "sample":
        raise ConfigError("raw samples can only be stored in sample mode")


def with_summaries(g: Graph, summaries: DataFrame) -> Graph:
    """Column profiles with the summaries (object_id, summary) of samples."""
    families = g.objects.select(F.col("id").alias("object_id"), F.col("column.data_type_family").alias("family"))
    new = summaries.join(families, "object_id", "left").alias("s")
    met = g.column_profiles.alias("p").join(new, F.col("p.object_id") == F.col("s.object_id"), "full_outer")
    out = met.select(
        F.coalesce("p.object_id", "s.object_id").alias("object_id"), F.coalesce("p.data_type_family", "s.family").alias("data_type_family"), "p.null_fraction", "p.distinct_estimate",
        "p.pii_score", "p.pii_reasons", F.coalesce("s.summary", "p.summary").alias("summary"), F.coalesce("p.profile_json", F.lit("{}")).alias("profile_json"),
    )
    return g.with_(column_profiles=out)


def first_rows(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n rows by a declared order, or by row hash where none is declared: the same rows on every run."""
    keys = [F.col(c) for c in order] or [F.xxhash64(*rows.columns)]
    return rows.orderBy(*keys).limit(n)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    keys = [F.col(c) for c in order] or [F.xxhash64(*rows.columns)]
    return rows.withColumn("__o", F.row_number().over(W.orderBy(*keys)))
