"""Registered queries over the catalog operators, and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalens import testbed as T
from catalens.functions import scalars as S
from catalens.lineage import graph as lineage
from catalens.model import Graph
from catalens.operators import context, diff, hashing, inference, policy, profile, report, rules, search, traversal, workload
from catalens.plans.engine import benchmark_measures, benchmark_summary
from catalens.sources.synthetic import synthetic

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return register


def text(column: str, sep: str = ",") -> Column:
    return F.array_join(column, sep)


# Catalog ------------------------------------------------------------------------------------------------------------
_NAMES = ", ".join(f"'{t}'" for t in T.TABLES)
_INFO = f"(SELECT table_name AS t, column_name AS c, ordinal_position AS o, data_type AS k FROM information_schema.columns WHERE table_name IN ({_NAMES}))"
_FAMILY = "CASE WHEN k LIKE '%[]' THEN 'array' WHEN k IN ('BIGINT', 'INTEGER', 'DOUBLE', 'FLOAT') THEN 'numeric' WHEN k = 'VARCHAR' THEN 'string' WHEN k LIKE 'TIMESTAMP%' THEN 'datetime' ELSE 'other' END"


def _keyed(columns: str = "t, c") -> str:
    rows = ", ".join(f"('{t}', '{c}')" for t, cols in T.KEYS.items() for c in cols)
    return f"(SELECT * FROM (VALUES {rows}) AS k({columns}))"


@query(f"SELECT 'main.' || t || '.' || c AS full_name, {_FAMILY} AS family, (o - 1)::BIGINT AS ordinal, NOT EXISTS (SELECT 1 FROM {_keyed('kt, kc')} WHERE kt = t AND kc = c) AS nullable FROM {_INFO}")
def catalog_columns(spark, sf_dir):
    g = T.catalog(spark, sf_dir)
    ordinal = F.get_json_object("metadata_json", "$.ordinal").cast("bigint")
    return g.objects.where("kind = 'column'").select("full_name", F.col("column.data_type_family").alias("family"), ordinal.alias("ordinal"), F.col("column.nullable").alias("nullable"))


@query(" UNION ALL ".join(f"SELECT 'main.{t}' AS full_name, (SELECT count(*) FROM {t}) AS row_estimate, 'exact' AS row_count_kind, (SELECT count(*) FROM {_INFO} WHERE t = '{t}') AS n_columns" for t in T.TABLES))
def catalog_tables(spark, sf_dir):
    g = T.catalog(spark, sf_dir, counts=True)
    n = g.edges.where("kind = 'has_column'").groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("n_columns"))
    return g.objects.join(g.table_profiles, F.col("id") == F.col("object_id")).join(n, "id").select("full_name", "row_estimate", "row_count_kind", "n_columns")


@query(f"SELECT 'schema' AS kind, 1::BIGINT AS n UNION ALL SELECT 'table', {len(T.TABLES)} UNION ALL SELECT 'column', (SELECT count(*) FROM {_INFO}) UNION ALL SELECT 'primary_key', {len(T.KEYS)} UNION ALL SELECT 'foreign_key', {len(T.REFERENCES)}")
def catalog_kind_counts(spark, sf_dir):
    return T.catalog(spark, sf_dir).objects.groupBy("kind").agg(F.count("*").alias("n"))


@query(f"SELECT 'has_column' AS kind, (SELECT count(*) FROM {_INFO})::BIGINT AS n UNION ALL SELECT 'has_constraint', {len(T.KEYS) + len(T.REFERENCES)} UNION ALL SELECT 'references', {len(T.REFERENCES)}")
def catalog_edge_counts(spark, sf_dir):
    return T.catalog(spark, sf_dir).edges.groupBy("kind").agg(F.count("*").alias("n"))


_PII = " + ".join(f"(contains(h, '{t}'))::INT" for t in S.PII_TERMS)
_TEXTUAL = " OR ".join(f"contains(h, '{t}')" for t in S.TEXT_TYPES)
_SPARK_TYPE = "CASE k WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'FLOAT[]' THEN 'array<float>' ELSE 'timestamp_ntz' END"


@query(f"""WITH d AS (SELECT 'main.' || t || '.' || c AS full_name, c, lower(c || ' main.' || t || '.' || c || ' ' || {_SPARK_TYPE}) AS h FROM {_INFO}),
s AS (SELECT full_name, {_PII} AS n, least(1.0, 0.45 * ({_PII}) + CASE WHEN {_TEXTUAL} THEN 0.05 ELSE 0 END) AS x, c FROM d)
SELECT full_name, round(CASE WHEN lower(c) = 'id' THEN least(x, 0.2) ELSE x END, 4)::DOUBLE AS pii_score, n::BIGINT AS n_reasons FROM s WHERE x > 0""")
def pii_column_scores(spark, sf_dir):
    g = T.catalog(spark, sf_dir)
    found = profile.privacy_scores(g.objects).join(g.objects, F.col("object_id") == F.col("id"))
    return found.select("full_name", F.round("pii_score", 4).alias("pii_score"), F.size("pii_reasons").cast("bigint").alias("n_reasons"))


# Profiles -----------------------------------------------------------------------------------------------------------
PROFILED = {
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"),
    "events": ("event_id", "ts", "user_id", "event_type", "value", "props"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
    "documents": ("doc_id", "text", "lang", "source", "n_chars"),
}
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?)$"
_STRINGS = {"o_orderstatus", "o_orderpriority", "l_returnflag", "l_linestatus", "event_type", "props", "c_name", "c_mktsegment", "p_name", "p_brand", "p_type", "text", "lang", "source", "url"}
_TIMES = {"o_orderdate", "l_shipdate", "ts"}
_SHAPED = f"translate({{}}, '{S.LETTERS_DIGITS}', '{S.SHAPES}')"


def _profile_sql(table: str, columns: tuple[str, ...]) -> str:
    parts = []
    for c in columns:
        low = high = "NULL::DOUBLE"
        shapes = "0"
        if c in _STRINGS:
            numeric = f"coalesce(bool_and(regexp_matches({c}, '{_NUMBER}')), false)"
            kind = f"CASE WHEN count({c}) = 0 THEN NULL WHEN {numeric} THEN 'numeric' WHEN count(DISTINCT {c}) <= 10 THEN 'enum_like' ELSE 'text' END"
            shapes = f"count(DISTINCT {_SHAPED.format(c)})"
            low = high = f"CASE WHEN false THEN min(0.0::DOUBLE) END"
        elif c in _TIMES:
            kind = f"CASE WHEN count({c}) > 0 THEN 'timestamp' END"
        else:
            kind, low, high = f"CASE WHEN count({c}) > 0 THEN 'numeric' END", f"min({c})::DOUBLE", f"max({c})::DOUBLE"
        parts.append(f"SELECT '{c}' AS column_name, count({c}) AS non_null, (count(*) - count({c})) AS nulls, count(DISTINCT {c}) AS n_distinct, {kind} AS shape, round({low}, 4) AS numeric_min, round({high}, 4) AS numeric_max, {shapes}::BIGINT AS n_shapes FROM {table}")
    return " UNION ALL ".join(parts)


def _profile_query(table: str, columns: tuple[str, ...]):
    def run(spark, sf_dir):
        found = profile.profile(T.table(spark, sf_dir, table), list(columns))
        return found.select("column_name", "non_null", "nulls", "n_distinct", "shape", F.round("numeric_min", 4).alias("numeric_min"), F.round("numeric_max", 4).alias("numeric_max"), "n_shapes")

    return run


for _t, _c in PROFILED.items():
    query(_profile_sql(_t, _c), f"profile_{_t}")(_profile_query(_t, _c))


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, {_SHAPED.format(c)} AS shape, count(*) AS n FROM {t} GROUP BY ALL" for t, c in (("customer", "c_name"), ("part", "p_brand"), ("orders", "o_orderpriority"), ("supplier", "s_name"))))
def format_shapes(spark, sf_dir):
    rows = [T.table(spark, sf_dir, t).select(F.lit(c).alias("column_name"), S.format_shape(F.col(c)).alias("shape")) for t, c in (("customer", "c_name"), ("part", "p_brand"), ("orders", "o_orderpriority"), ("supplier", "s_name"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]).groupBy("column_name", "shape").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE WHEN c_name = '' THEN '' ELSE repeat('*', least(greatest(length(c_name), 4), 12)::INT) END AS masked, 'sha256:' || substr(sha256(c_name), 1, 16) AS hashed, CASE WHEN c_name IS NOT NULL THEN '[REDACTED]' END AS redacted FROM customer")
def mask_customer(spark, sf_dir):
    name = F.col("c_name")
    return T.table(spark, sf_dir, "customer").select("c_custkey", S.mask_value(name, "mask").alias("masked"), S.mask_value(name, "hash").alias("hashed"), S.mask_value(name).alias("redacted"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 1000 ORDER BY o_orderkey LIMIT 50")
def sample_policy_orders(spark, sf_dir):
    found = policy.rule_for([policy.Rule("main.lineitem"), policy.Rule("main.ord*", "sample", ("o_orderkey", "o_orderstatus"), "o_totalprice > 1000", 50, ("o_orderkey",)), policy.Rule("*")], "main.orders")
    return policy.sample(T.table(spark, sf_dir, "orders"), found, 100)


@query("SELECT 'o_orderpriority' AS column_name, (SELECT count(o_orderpriority) FROM orders) AS non_null, 0::BIGINT AS nulls, count(*) AS n_distinct, 'enum_like' AS shape, string_agg('[REDACTED]', ',') AS examples FROM (SELECT DISTINCT o_orderpriority FROM orders)")
def summary_orders(spark, sf_dir):
    found = profile.summarize(T.table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey", sensitive=True)
    s = "summary."
    return found.select(F.lit("o_orderpriority").alias("column_name"), F.col(s + "observed_non_null").alias("non_null"), F.col(s + "observed_null").alias("nulls"), F.col(s + "distinct_count").alias("n_distinct"), F.col(s + "inferred_shape").alias("shape"), text(s + "examples").alias("examples"))


def _summaries(spark, sf_dir) -> Graph:
    """The catalog with summaries of some columns, taken from their profiles."""
    g = T.catalog(spark, sf_dir)
    made = []
    for t, columns in {"orders": ("o_orderstatus", "o_totalprice"), "customer": ("c_acctbal", "c_mktsegment"), "events": ("event_type", "value"), "pages": ("url",), "lineitem": ("l_returnflag", "l_quantity")}.items():
        p = profile.profile(T.table(spark, sf_dir, t), list(columns))
        struct = F.struct(
            F.col("non_null").alias("observed_non_null"), F.col("nulls").alias("observed_null"), F.lit(False).alias("sensitive"), F.array().cast("array<string>").alias("examples"), F.col("n_distinct").alias("distinct_count"),
            F.col("shape").alias("inferred_shape"), "numeric_min", "numeric_max", F.col("shapes").alias("format_shapes"), F.lit("sample").alias("source"),
        )
        made.append(p.select(F.concat(F.lit(f"column:main.{t}."), "column_name").alias("object_id"), struct.alias("summary")))
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return profile.with_summaries(g, out)


_ENUMS = (("orders", "o_orderstatus"), ("customer", "c_mktsegment"), ("events", "event_type"), ("lineitem", "l_returnflag"))


@query(
    " UNION ALL ".join(f"SELECT 'data.enum_like_without_constraint' AS rule_id, 'main.{t}.{c}' AS object, 'distinctCount=' || count(DISTINCT {c}) || '; source=sample' AS evidence FROM {t} HAVING count(DISTINCT {c}) BETWEEN 2 AND 10" for t, c in _ENUMS)
    + f" UNION ALL SELECT 'data.unstable_format_sample', 'main.pages.url', 'formatShapeCount=' || least(count(DISTINCT {_SHAPED.format('url')}), 50) || '; source=sample' FROM pages HAVING count(url) >= 5 AND count(DISTINCT {_SHAPED.format('url')}) > 1"
)
def data_rule_findings(spark, sf_dir):
    found = rules.data_rules(_summaries(spark, sf_dir))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("rule_id", "object", "evidence")


# Row graph ----------------------------------------------------------------------------------------------------------
_OBJ = """o AS (SELECT 'region:' || r_regionkey AS id, r_name AS name FROM region UNION ALL SELECT 'nation:' || n_nationkey, n_name FROM nation
UNION ALL SELECT 'supplier:' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'customer:' || c_custkey, c_name FROM customer),
e AS (SELECT 'nation:' || n_nationkey AS f, 'region:' || n_regionkey AS t, 10000000000 + n_nationkey AS ord FROM nation
UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 20000000000 + s_suppkey FROM supplier
UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 30000000000 + c_custkey FROM customer)"""
_WAYS = {
    "outgoing": "SELECT f AS a, t AS n, ord FROM e",
    "incoming": "SELECT t AS a, f AS n, ord FROM e",
    "both": "SELECT f AS a, t AS n, ord FROM e UNION ALL SELECT t, f, ord FROM e WHERE f <> t",
}
_STARTS = {"outgoing": "supplier", "incoming": "region", "both": "region"}


def _paths_sql(direction: str, depth: int) -> str:
    start = _STARTS[direction]
    one = f"WITH {_OBJ}, w AS ({_WAYS[direction]}), l1 AS (SELECT a AS s, n AS last, a || '>' || n AS path, ord FROM w WHERE a LIKE '{start}:%')"
    first = "SELECT s AS start, path, 1 AS depth FROM l1"
    if depth == 1:
        return f"{one} {first}"
    return f"{one}, r AS (SELECT s, last, arg_min(path, ord) AS path FROM l1 WHERE last <> s GROUP BY s, last) {first} UNION ALL SELECT s, path || '>' || n, 2 FROM r JOIN w ON w.a = r.last"


def _paths_query(direction: str, depth: int):
    def run(spark, sf_dir):
        g = T.row_graph(spark, sf_dir)
        starts = g.objects.where(F.col("schema_name") == _STARTS[direction])
        return traversal.relation_paths(g, starts, depth, direction).select("start", text("path", ">").alias("path"), "depth")

    return run


for _way in _WAYS:
    for _n in (1, 2):
        query(_paths_sql(_way, _n), f"relations_depth{_n}_{_way}")(_paths_query(_way, _n))


def _impact_sql(kind: str) -> str:
    return f"""WITH {_OBJ}, w AS ({_WAYS['both']}), s AS (SELECT id FROM o WHERE id LIKE '{kind}:%'),
l1 AS (SELECT DISTINCT s.id AS start, n AS id FROM s JOIN w ON a = s.id WHERE n <> s.id),
l2 AS (SELECT DISTINCT l1.start, n AS id FROM l1 JOIN w ON a = l1.id),
x AS (SELECT start, id FROM l2 WHERE id <> start AND NOT EXISTS (SELECT 1 FROM l1 WHERE l1.start = l2.start AND l1.id = l2.id))
SELECT start, id, 1 AS depth, 'references' AS evidence FROM l1 UNION ALL SELECT start, id, 2, 'references -> references' FROM x"""


def _impact_query(kind: str):
    def run(spark, sf_dir):
        g = T.row_graph(spark, sf_dir)
        starts = g.objects.where(F.col("schema_name") == kind).select(F.col("id").alias("start"), "id", F.lit(0).alias("depth"), F.lit("").alias("evidence"), F.lit(0).cast("bigint").alias("ord"))
        return traversal.impact_levels(g, starts, 2).where("depth > 0").select("start", "id", "depth", "evidence")

    return run


for _k in ("region", "nation"):
    query(_impact_sql(_k), f"impact_{_k}")(_impact_query(_k))


@query(f"WITH {_OBJ}, t AS (SELECT unnest([f, t]) AS id FROM e WHERE f IN (SELECT 'nation:' || n_nationkey FROM nation WHERE n_regionkey = 1) OR t IN (SELECT 'nation:' || n_nationkey FROM nation WHERE n_regionkey = 1)) SELECT id, count(*) * 5.25::DOUBLE AS score FROM t GROUP BY id")
def neighbour_scores(spark, sf_dir):
    g = T.row_graph(spark, sf_dir)
    seeds = T.table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"))
    return traversal.neighbour_scores(g, seeds)


@query("SELECT 'nation:' || n_nationkey || ' -references-> region:' || n_regionkey AS path FROM nation WHERE n_regionkey < 2")
def edges_among_rows(spark, sf_dir):
    g = T.row_graph(spark, sf_dir)
    nations = T.table(spark, sf_dir, "nation").where("n_regionkey < 2")
    chosen = nations.select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("full_name")).union(nations.select(F.concat(F.lit("region:"), F.col("n_regionkey").cast("string"))))
    return traversal.edges_among(g, chosen).select("path")


# Workload, search, context ------------------------------------------------------------------------------------------
_KIND = {"view": "reads_from", "purchase": "writes_to", "click": "joins_on", "error": "filters_by"}
_KIND_SQL = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _KIND.items()) + " ELSE 'groups_by' END"


@query(f"""WITH u AS (SELECT DISTINCT user_id AS f, {_KIND_SQL} AS k, props AS target FROM events), c AS (SELECT target, count(*) FILTER (WHERE k = 'reads_from') AS reads, count(*) FILTER (WHERE k = 'writes_to') AS writes,
count(*) FILTER (WHERE k = 'joins_on') AS joins, count(*) FILTER (WHERE k = 'filters_by') AS filters FROM u GROUP BY target) SELECT *, reads + writes + joins + filters AS frequency FROM c""")
def workload_events(spark, sf_dir):
    uses = T.table(spark, sf_dir, "events").select(F.col("user_id").alias("fingerprint"), F.expr(_KIND_SQL).alias("kind"), F.col("props").alias("target"))
    return workload.counters(uses)


_PART_TERMS = ("blue", "bolt", "ring")


def _term_sql(term: str, name: str, full: str, hay: str) -> str:
    return f"(CASE WHEN lower({full}) = '{term}' OR lower({name}) = '{term}' THEN 50 WHEN starts_with(lower({name}), '{term}') THEN 25 WHEN contains(lower({name}), '{term}') THEN 15 ELSE 0 END + CASE WHEN contains({hay}, '{term}') THEN 10 ELSE 0 END)"


@query(f"""WITH p AS (SELECT p_partkey, p_name, p_brand || '.' || p_name AS full_name, lower(p_name || ' ' || p_brand || '.' || p_name || ' ' || p_type) AS h FROM part),
s AS (SELECT p_partkey, ({' + '.join(_term_sql(t, 'p_name', 'full_name', 'h') for t in _PART_TERMS)})::DOUBLE AS x FROM p)
SELECT p_partkey, x + 1.0 AS score FROM s WHERE x > 0""")
def search_parts(spark, sf_dir):
    rows = T.table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_name").alias("full_name"), "p_type")
    hay = F.lower(F.concat_ws(" ", "name", "full_name", "p_type"))
    asked = search.parse_query("the bolts, blue ring")
    terms = S.extract_search_terms(F.lit(asked.text))
    return rows.withColumn("score", search.score(terms, asked, text=hay, bonus=F.lit(1.0))).where("score > 0").select("p_partkey", "score")


@query("SELECT doc_id, (CASE WHEN contains(lower(text), 'license') THEN 10 ELSE 0 END + CASE WHEN contains(lower(text), 'apache') THEN 10 ELSE 0 END + 1)::DOUBLE AS score FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'apache') ORDER BY score DESC, doc_id LIMIT 20")
def search_documents(spark, sf_dir):
    rows = T.table(spark, sf_dir, "documents").select("doc_id", F.lit("").alias("name"), F.lit("").alias("full_name"), "text")
    asked = search.parse_query("Apache license")
    found = rows.withColumn("score", search.score(S.extract_search_terms(F.lit(asked.text)), asked, text=F.lower("text"), bonus=F.lit(1.0)))
    return found.where("score > 0").orderBy(F.desc("score"), "doc_id").limit(20).select("doc_id", "score")


@query(f"""WITH d AS (SELECT 'main.' || t || '.' || c AS full_name, c AS name, lower(c || ' main.' || t || '.' || c || ' {{"ordinal":' || (o - 1) || '}}') AS h FROM {_INFO}),
s AS (SELECT full_name, {_term_sql('key', 'name', 'full_name', 'h')} + {_term_sql('order', 'name', 'full_name', 'h')} AS x FROM d)
SELECT full_name, (x + 8 + 5)::DOUBLE AS score FROM s WHERE x > 0 ORDER BY score DESC, full_name LIMIT 10""")
def search_catalog(spark, sf_dir):
    return search.search(T.catalog(spark, sf_dir).objects, "kind:column order key", 10).select("full_name", "score")


@query(r"""WITH d AS (SELECT source, doc_id, n_chars, greatest(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), strlen(text) // 4) AS cost FROM documents),
r AS (SELECT source, doc_id, cost, sum(cost) OVER w AS spent, row_number() OVER w AS place FROM d WINDOW w AS (PARTITION BY source ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING))
SELECT source, doc_id, cost::BIGINT AS cost, spent::BIGINT AS spent, place FROM r WHERE spent <= 2000 AND place <= 12""")
def context_budget_documents(spark, sf_dir):
    rows = T.table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", S.estimate_tokens(F.col("text")).alias("cost"))
    kept = context.within_budget(rows, ["n_chars", "doc_id"], "cost", 2000, 12, ["source"])
    return kept.select("source", "doc_id", "cost", "spent", F.col("place").cast("bigint").alias("place"))


@query("SELECT w AS asked, p_type, levenshtein(w, p_type) AS distance FROM (SELECT DISTINCT p_type FROM part), (VALUES ('ECONOMIC'), ('SMAL'), ('PROMI'), ('LARGER'), ('STANDART')) AS v(w) WHERE levenshtein(w, p_type) <= 2")
def fuzzy_suggest(spark, sf_dir):
    known = T.table(spark, sf_dir, "part").select("p_type").distinct()
    asked = spark.createDataFrame([(w,) for w in ("ECONOMIC", "SMAL", "PROMI", "LARGER", "STANDART")], "asked string")
    met = known.join(F.broadcast(asked), S.edit_distance(F.col("asked"), F.col("p_type"), 2) >= 0)
    return met.select("asked", "p_type", S.edit_distance(F.col("asked"), F.col("p_type")).cast("bigint").alias("distance"))


# Differences --------------------------------------------------------------------------------------------------------
def _as_objects(spark, rows: DataFrame, key: str, kind_of_type: Column, nullable: Column) -> DataFrame:
    from catalens.model import OBJECTS

    full = F.concat(F.lit("main.orders.k"), F.col(key).cast("string"))
    facet = F.struct(kind_of_type.alias("data_type"), F.lit("string").alias("data_type_family"), nullable.alias("nullable"), F.lit(None).cast("string").alias("default"), F.lit(None).cast("string").alias("comment"))
    made = rows.select(full.alias("id"), F.lit("column").alias("kind"), full.alias("full_name"), F.lit("main").alias("schema_name"), F.lit("orders").alias("table_name"), F.concat(F.lit("k"), F.col(key).cast("string")).alias("column_name"), facet.alias("column"), F.lit("{}").alias("metadata_json"), F.col(key).alias("obj_ord"))
    return spark.createDataFrame([], OBJECTS).unionByName(made, allowMissingColumns=True)


@query("""SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'removed' WHEN o_orderkey % 10 = 1 THEN 'added' ELSE 'changed' END AS change, 'main.orders.k' || o_orderkey AS full_name,
CASE o_orderkey % 10 WHEN 2 THEN 'column type changed' WHEN 3 THEN 'column nullability changed' WHEN 4 THEN 'column type changed,column nullability changed' ELSE '' END AS details FROM orders WHERE o_orderkey % 10 < 5""")
def diff_orders(spark, sf_dir):
    rows, k = T.table(spark, sf_dir, "orders"), F.col("o_orderkey") % 10
    before = _as_objects(spark, rows.where(k != 1), "o_orderkey", F.col("o_orderstatus"), F.lit(True))
    now = _as_objects(spark, rows.where(k != 0), "o_orderkey", F.when(k.isin(2, 4), F.lit("other")).otherwise(F.col("o_orderstatus")), ~k.isin(3, 4))
    return diff.changes(before, now).select("change", "full_name", text("details").alias("details"))


@query("SELECT 'main.nation_' || a.n_nationkey AS from_full_name, 'main.country_' || b.n_nationkey AS to_full_name, 'went and came in one schema as the same kind: may be one object under a new name' AS reason FROM nation a, nation b WHERE a.n_nationkey % 5 = 0 AND b.n_nationkey % 7 = 1")
def diff_rename_candidates(spark, sf_dir):
    from catalens.model import OBJECTS

    rows = T.table(spark, sf_dir, "nation")

    def objects(kept: DataFrame, head: str) -> DataFrame:
        full = F.concat(F.lit(f"main.{head}_"), F.col("n_nationkey").cast("string"))
        return spark.createDataFrame([], OBJECTS).unionByName(kept.select(full.alias("id"), F.lit("table").alias("kind"), full.alias("full_name"), F.lit("main").alias("schema_name"), F.col("n_nationkey").cast("bigint").alias("obj_ord")), allowMissingColumns=True)

    stay = objects(rows.where("n_nationkey % 5 != 0"), "nation")
    return diff.rename_candidates(stay.unionByName(objects(rows.where("n_nationkey % 5 = 0"), "nation")), stay.unionByName(objects(rows.where("n_nationkey % 7 = 1"), "country")))


def _orphan_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{t}.{','.join(own)}' AS reference, (SELECT count(*) FROM {t} x WHERE NOT EXISTS (SELECT 1 FROM {to} y WHERE {' AND '.join(f'x.{a} = y.{b}' for a, b in zip(own, there, strict=True))})) AS orphans" for t, own, to, there in T.REFERENCES)


@query(_orphan_sql())
def orphan_references(spark, sf_dir):
    out = None
    for t, own, to, there in T.REFERENCES:
        child = T.table(spark, sf_dir, t).select(*own)
        parent = T.table(spark, sf_dir, to).select(*[F.col(b).alias(f"p_{a}") for a, b in zip(own, there, strict=True)])
        met = [F.col(a) == F.col(f"p_{a}") for a in own]
        counted = child.join(parent, met, "left_anti").agg(F.count("*").alias("orphans")).select(F.lit(f"{t}.{','.join(own)}").alias("reference"), "orphans")
        out = counted if out is None else out.unionByName(counted)
    return out


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys_lineitem(spark, sf_dir):
    return T.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


# Rules over the shop ------------------------------------------------------------------------------------------------
def _shop(spark) -> Graph:
    g, _ = lineage.enrich(T.shop(spark), T.shop_files(spark))
    return profile.with_privacy(g)


_EXPECTED = (
    ("risk.delete_without_where", "sql/sweep.sql", "high", 0.9), ("risk.query_reads_sensitive_column", "public.payments.provider_token", "high", 0.85), ("risk.sensitive_column", "public.customers.email", "high", 0.9),
    ("risk.sensitive_column", "public.payments.provider_token", "high", 0.9), ("performance.filter_without_index", "public.orders.status", "medium", 0.75), ("performance.filter_without_index", "public.payments.provider_token", "medium", 0.75),
    ("quality.missing_primary_key", "public.audit_events", "medium", 0.85), ("quality.probable_missing_fk", "public.orders.customer_id", "medium", 0.7), ("quality.probable_missing_fk", "public.payments.gateway_id", "medium", 0.7),
    ("risk.select_star", "sql/report.sql", "medium", 0.8),
)
_EXPECTED_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {d}::DOUBLE)" for a, b, c, d in _EXPECTED) + ") AS v(rule_id, object, severity, confidence)"
def _short() -> Column:
    return F.regexp_replace(F.col("object"), "^sql\\.([^:]*):.*$", "$1")


@query(f"SELECT * FROM {_EXPECTED_SQL}")
def rule_findings_shop(spark, sf_dir):
    return rules.analyze(_shop(spark)).select("rule_id", _short().alias("object"), "severity", "confidence")


@query(f"SELECT severity, count(*) AS n FROM {_EXPECTED_SQL} GROUP BY severity")
def findings_severity_counts(spark, sf_dir):
    return report.severity_counts(rules.analyze(_shop(spark)))


@query(f"SELECT sum(CASE severity WHEN 'critical' THEN 25 WHEN 'high' THEN 10 WHEN 'medium' THEN 5 ELSE 1 END)::BIGINT AS risk_score FROM {_EXPECTED_SQL}")
def findings_risk_score(spark, sf_dir):
    return report.risk_score(rules.analyze(_shop(spark)))


@query(f"""WITH f AS (SELECT *, split_part(rule_id, '.', 1) AS scope FROM {_EXPECTED_SQL}), s AS (SELECT * FROM (VALUES ('security_privacy'), ('data_integrity_schema_quality'), ('sql_workload_safety'), ('performance'), ('data_profiling_business_rules')) AS v(section)),
m AS (SELECT 'security_privacy' AS section, severity FROM f WHERE scope = 'risk' AND (contains(rule_id, 'sensitive') OR rule_id = 'risk.select_star') UNION ALL SELECT 'data_integrity_schema_quality', severity FROM f WHERE scope = 'quality'
UNION ALL SELECT 'sql_workload_safety', severity FROM f WHERE rule_id IN ('risk.update_without_where', 'risk.delete_without_where') UNION ALL SELECT 'performance', severity FROM f WHERE scope = 'performance' UNION ALL SELECT 'data_profiling_business_rules', severity FROM f WHERE scope = 'data')
SELECT s.section, count(m.section) AS n, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium FROM s LEFT JOIN m USING (section) GROUP BY s.section""")
def findings_sections(spark, sf_dir):
    return report.sections(rules.analyze(_shop(spark))).select("section", "n", "high", "medium")


@query(f"SELECT rule_id, object FROM {_EXPECTED_SQL} WHERE rule_id NOT LIKE 'quality.%'")
def baseline_new_findings(spark, sf_dir):
    found = rules.analyze(_shop(spark))
    return report.new_since(found, found.where("startswith(rule_id, 'quality.')")).select("rule_id", _short().alias("object"))


@query(f"SELECT rule_id, object, rule_id = 'quality.missing_primary_key' AS suppressed, rule_id = 'risk.sensitive_column' AND object = 'public.customers.email' AS expired FROM {_EXPECTED_SQL}")
def suppressed_findings(spark, sf_dir):
    told = [{"ruleId": "quality.missing_primary_key", "object": "public.audit_events", "expiresAt": "2999-01-01"}, {"ruleId": "risk.sensitive_column", "object": "public.customers.email", "expiresAt": "2001-01-01"}]
    return report.suppress(rules.analyze(_shop(spark)), told).select("rule_id", _short().alias("object"), "suppressed", "expired")


@query("SELECT * FROM (VALUES ('public.customers.id'), ('public.orders.id'), ('public.payments.id'), ('public.orders.customer_id')) AS v(key)")
def indexed_columns_shop(spark, sf_dir):
    return rules.indexed_columns(T.shop(spark))


_REFS = (
    ("sql/orders.sql", "reads_from", "orders", "o", True), ("sql/orders.sql", "joins_on", "customers", "c", True), ("sql/orders.sql", "joins_on", "customers.id", "c", True), ("sql/orders.sql", "joins_on", "orders.customer_id", "o", True),
    ("sql/orders.sql", "filters_by", "orders.status", "o", True), ("sql/orders.sql", "orders_by", "orders.id", "o", True), ("sql/orders.sql", "writes_to", "orders", None, True), ("sql/orders.sql", "filters_by", "id", None, False),
    ("sql/report.sql", "depends_on", "recent", None, True), ("sql/report.sql", "reads_from", "orders", None, True), ("sql/report.sql", "filters_by", "total_amount", None, False), ("sql/report.sql", "reads_from", "recent", "r", False),
    ("sql/report.sql", "groups_by", "recent.status", "r", True), ("sql/sweep.sql", "writes_to", "payments", None, True), ("sql/sweep.sql", "writes_to", "audit_events", None, True), ("sql/sweep.sql", "reads_from", "payments", "p", True),
    ("sql/sweep.sql", "filters_by", "payments.provider_token", "p", True),
)
_REFS_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {repr(d) if d else 'NULL'}, {str(e).lower()})" for a, b, c, d, e in _REFS) + ") AS v(source_path, kind, object_name, alias, resolved)"


@query(f"SELECT * FROM {_REFS_SQL}")
def lineage_references(spark, sf_dir):
    return lineage.references(lineage.parse_files(T.shop_files(spark))).select("source_path", "kind", "object_name", "alias", "resolved")


@query(f"SELECT DISTINCT object_name, CASE WHEN object_name IN ('id', 'total_amount', 'recent', 'recent.status') THEN NULL ELSE 'public.' || object_name END AS resolved_name FROM {_REFS_SQL}")
def lineage_resolved(spark, sf_dir):
    refs = lineage.references(lineage.parse_files(T.shop_files(spark))).select("object_name").distinct()
    return refs.join(lineage.resolve_names(T.shop(spark).objects, refs), "object_name", "left").select("object_name", "resolved_name")


@query("SELECT * FROM (VALUES ('filters_by', 'id', 0.45::DOUBLE), ('filters_by', 'total_amount', 0.45), ('reads_from', 'recent', 0.45)) AS v(kind, to_id, confidence)")
def lineage_unresolved(spark, sf_dir):
    g, _ = lineage.enrich(T.shop(spark), T.shop_files(spark))
    return g.edges.where("unresolved").select("kind", "to_id", "confidence")


@query("SELECT * FROM (VALUES ('sql/orders.sql', 'parsed', 'select,update'), ('sql/report.sql', 'parsed', 'select'), ('sql/sweep.sql', 'parsed', 'delete,insert'), ('sql/broken.sql', 'failed', '')) AS v(source_path, status, kinds)")
def parse_status(spark, sf_dir):
    return lineage.parse_files(T.shop_files(spark)).select("source_path", "status", text("kinds").alias("kinds"))


@query("SELECT * FROM (VALUES ('public.orders', 1::BIGINT, 1::BIGINT, 0::BIGINT, 0::BIGINT)) AS v(x, a, b, c, d) WHERE false UNION ALL SELECT * FROM (VALUES ('column:public.customers.id', 0, 0, 1, 0), ('column:public.orders.customer_id', 0, 0, 1, 0), ('column:public.orders.id', 0, 0, 0, 0), ('column:public.orders.status', 0, 0, 0, 1), ('column:public.payments.provider_token', 0, 0, 0, 1), ('id', 0, 0, 0, 1), ('recent', 1, 0, 0, 0), ('recent.status', 0, 0, 0, 0), ('table:public.audit_events', 0, 1, 0, 0), ('table:public.customers', 0, 0, 1, 0), ('table:public.orders', 2, 1, 0, 0), ('table:public.payments', 1, 1, 0, 0), ('total_amount', 0, 0, 0, 1)) AS w".replace("AS v(x, a, b, c, d) WHERE false UNION ALL SELECT *", "AS v(target, reads, writes, joins, filters) WHERE false UNION ALL SELECT *"))
def workload_shop(spark, sf_dir):
    g, _ = lineage.enrich(T.shop(spark), T.shop_files(spark))
    return workload.counters(workload.query_uses(g)).drop("frequency")


@query("SELECT 'column:public.orders.customer_id' AS from_id, 'column:public.customers.id' AS to_id, 0.82::DOUBLE AS confidence, 'public.orders.customer_id looks like it references public.customers.id' AS detail")
def inferred_references_shop(spark, sf_dir):
    return inference.infer(T.shop(spark)).select("from_id", "to_id", "confidence", F.col("evidence")[0]["detail"].alias("detail"))


# Functions ----------------------------------------------------------------------------------------------------------
@query(r"SELECT doc_id, sha256(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g'))) AS fingerprint FROM documents")
def content_fingerprints(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select("doc_id", S.fingerprint(S.compact_whitespace(F.col("text"))).alias("fingerprint"))


@query(r"SELECT doc_id, greatest(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), strlen(text) // 4)::BIGINT AS tokens, greatest(ceil(length(text) / 4.0), 1)::BIGINT AS tokens_by_chars FROM documents")
def token_estimates(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select("doc_id", S.estimate_tokens(F.col("text")).alias("tokens"), S.estimate_tokens_by_chars(F.col("text")).alias("tokens_by_chars"))


@query("SELECT DISTINCT w, CASE WHEN w LIKE '%s' THEN w WHEN w LIKE '%y' THEN regexp_replace(w, 'y+$', '') || 'ies' ELSE w || 's' END AS plural, CASE WHEN w LIKE '%ies' THEN regexp_replace(w, 'ies$', 'y') ELSE regexp_replace(w, 's+$', '') END AS singular FROM (SELECT lower(p_type) AS w FROM part UNION ALL SELECT unnest(string_split(p_name, ' ')) FROM part UNION ALL SELECT * FROM (VALUES ('address'), ('entries'), ('cities')))")
def inflections(spark, sf_dir):
    part = T.table(spark, sf_dir, "part")
    words = part.select(F.lower("p_type").alias("w")).union(part.select(F.explode(F.split("p_name", " ")))).union(spark.createDataFrame([("address",), ("entries",), ("cities",)], "w string")).distinct()
    return words.select("w", S.pluralize(F.col("w")).alias("plural"), S.singularize(F.col("w")).alias("singular"))


@query("""WITH v AS (SELECT * FROM (VALUES ('tenant_id', 'tenants', 0.9::DOUBLE), ('entity_id', 'entities', 0.72), ('created_by', 'users', 0.9), ('category_id', 'categories', 0.82), ('orders_id', 'orders', 0.82), ('name', NULL, 0.82)) AS v(column_name, hint, confidence)) SELECT * FROM v""")
def target_hints(spark, sf_dir):
    names = spark.createDataFrame([(n,) for n in ("tenant_id", "entity_id", "created_by", "category_id", "orders_id", "name")], "column_name string")
    return names.select("column_name", S.target_table_hint(F.col("column_name")).alias("hint"), S.inference_confidence(F.col("column_name")).alias("confidence"))


_STOP = ", ".join(f"'{w}'" for w in S.STOP_WORDS)


@query(f"""WITH w AS (SELECT p_partkey, unnest(list_filter(string_split_regex(lower(regexp_replace(p_name || '_' || p_type || ' for the ' || p_brand, '[^A-Za-z0-9]+', ' ', 'g')), ' +'), lambda x: length(x) >= 3 AND x NOT IN ({_STOP}))) AS t FROM part),
a AS (SELECT p_partkey, t FROM w UNION SELECT p_partkey, substr(t, 1, length(t) - 1) FROM w WHERE t LIKE '%s' AND length(t) >= 4) SELECT p_partkey, string_agg(t, ',' ORDER BY t) AS terms FROM a GROUP BY p_partkey""")
def search_terms(spark, sf_dir):
    asked = F.concat(F.concat_ws("_", "p_name", "p_type"), F.lit(" for the "), F.col("p_brand"))
    return T.table(spark, sf_dir, "part").select("p_partkey", text(S.extract_search_terms(asked)).alias("terms"))


@query("SELECT 400::BIGINT AS tables_, 2000::BIGINT AS objects, 1600::BIGINT AS edges, 1200::BIGINT AS nullable")
def synthetic_catalog_counts(spark, sf_dir):
    g = synthetic(spark, 400, 4)
    rows = g.objects.select("kind", F.col("column.nullable").alias("nullable")).unionByName(g.edges.select("kind"), allowMissingColumns=True)
    edges = F.count_if(F.col("kind") == "has_column")
    return rows.agg(F.count_if(F.col("kind") == "table").alias("tables_"), (F.count("*") - edges).alias("objects"), edges.alias("edges"), F.count_if("nullable").alias("nullable"))


@query("SELECT 'content' AS relation, true AS same_after_shuffle, false AS same_after_change")
def content_hash_invariance(spark, sf_dir):
    g = T.shop(spark)
    mixed = g.with_(objects=g.objects.orderBy(F.xxhash64("id")).withColumn("obj_ord", -F.col("obj_ord")), edges=g.edges.orderBy(F.xxhash64("id")))
    other = g.with_(objects=g.objects.withColumn("comment", F.when(F.col("name") == "email", "new").otherwise(F.col("comment"))))
    mark = hashing.content_hash(g)
    return spark.createDataFrame([("content", hashing.content_hash(mixed) == mark, hashing.content_hash(other) == mark)], "relation string, same_after_shuffle boolean, same_after_change boolean")


@query("SELECT 36::BIGINT AS raw_tokens, 14::BIGINT AS structured_tokens, 61.1::DOUBLE AS token_reduction_percent, 0.25::DOUBLE AS recall_delta")
def benchmark_summary_shop(spark, sf_dir):
    rows = [(0, "a", "raw", "x" * 80 + " public.orders", ["public.orders", "public.payments"], 2), (0, "a", "structured", "public.orders public.payments", ["public.orders", "public.payments"], 2), (1, "b", "raw", "y" * 48, ["public.users"], 2), (1, "b", "structured", "y" * 24, ["public.users"], 2)]
    table = spark.createDataFrame(rows, "n int, name string, mode string, text string, expected array<string>, steps int")
    return benchmark_summary(benchmark_measures(table)).select("raw_tokens", "structured_tokens", "token_reduction_percent", F.round("recall_delta", 4).alias("recall_delta"))


@query(r"SELECT doc_id, len(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')))::BIGINT AS n_tokens FROM documents")
def token_index_documents(spark, sf_dir):
    rows = T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("full_name"), F.col("text").alias("metadata_json"))
    counted = search.token_index(rows).groupBy("id").agg(F.count("*").alias("n"))
    return rows.join(counted, "id", "left").select(F.col("id").alias("doc_id"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_tokens"))


@query("SELECT DISTINCT first_value(o_orderkey) OVER w AS o_orderkey, o_custkey FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def first_wins_orders(spark, sf_dir):
    first = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return T.table(spark, sf_dir, "orders").withColumn("n", F.row_number().over(first)).where("n = 1").select("o_orderkey", "o_custkey")
