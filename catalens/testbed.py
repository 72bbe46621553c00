"""The driver's tables as a catalog and as a row graph, with the keys that Parquet files cannot declare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalens.model import EDGES, OBJECTS, Graph, graph
from catalens.sources.parquet import ParquetProvider

TABLES = ("benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")
KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",), "events": ("event_id",),
    "documents": ("doc_id",), "embeddings": ("vec_id",), "pages": ("page_id",), "benchmark": ("item_id",), "conversations": ("conv_id", "turn"), "labels": ("doc_id",),
}
REFERENCES = (
    ("nation", ("n_regionkey",), "region", ("r_regionkey",)), ("customer", ("c_nationkey",), "nation", ("n_nationkey",)), ("supplier", ("s_nationkey",), "nation", ("n_nationkey",)),
    ("orders", ("o_custkey",), "customer", ("c_custkey",)), ("lineitem", ("l_orderkey",), "orders", ("o_orderkey",)), ("lineitem", ("l_partkey",), "part", ("p_partkey",)),
    ("lineitem", ("l_suppkey",), "supplier", ("s_suppkey",)), ("labels", ("doc_id",), "documents", ("doc_id",)),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str, counts: bool = False) -> Graph:
    return ParquetProvider(sf_dir, TABLES, KEYS, REFERENCES, counts=counts).snapshot(spark)


def row_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Rows of region, nation, supplier and customer as objects, their foreign keys as edges: the operators on a data graph."""
    t = lambda n: table(spark, sf_dir, n)

    def objects(rows: DataFrame, kind: str, key: str, name: str, rank: int) -> DataFrame:
        full = F.concat_ws(":", F.lit(kind), F.col(key).cast("string"))
        return rows.select(full.alias("id"), F.lit("table").alias("kind"), F.col(name).alias("name"), full.alias("full_name"), F.lit(kind).alias("schema_name"), F.lit(False).alias("deprecated"), F.lit("{}").alias("metadata_json"), (F.lit(rank * 10_000_000_000) + F.col(key)).cast("bigint").alias("obj_ord"))

    def edges(rows: DataFrame, kind: str, key: str, to: str, ref: str, rank: int) -> DataFrame:
        a, b = F.concat_ws(":", F.lit(kind), F.col(key).cast("string")), F.concat_ws(":", F.lit(to), F.col(ref).cast("string"))
        return rows.select(F.concat_ws("->", a, b).alias("id"), F.lit("references").alias("kind"), a.alias("from_id"), b.alias("to_id"), F.lit(1.0).alias("confidence"), (F.lit(rank * 10_000_000_000) + F.col(key)).cast("bigint").alias("edge_ord"))

    made = [objects(t("region"), "region", "r_regionkey", "r_name", 0), objects(t("nation"), "nation", "n_nationkey", "n_name", 1), objects(t("supplier"), "supplier", "s_suppkey", "s_name", 2), objects(t("customer"), "customer", "c_custkey", "c_name", 3)]
    linked = [edges(t("nation"), "nation", "n_nationkey", "region", "n_regionkey", 1), edges(t("supplier"), "supplier", "s_suppkey", "nation", "s_nationkey", 2), edges(t("customer"), "customer", "c_custkey", "nation", "c_nationkey", 3)]
    all_objects, all_edges = spark.createDataFrame([], OBJECTS), spark.createDataFrame([], EDGES)
    for m in made:
        all_objects = all_objects.unionByName(m, allowMissingColumns=True)
    for m in linked:
        all_edges = all_edges.unionByName(m, allowMissingColumns=True)
    return graph(spark, []).with_(objects=all_objects, edges=all_edges)


#: A small shop with what the rules look for: a table without a key, personal columns, unindexed filters.
def shop(spark: SparkSession) -> Graph:
    def t(name: str) -> dict:
        return {"id": f"table:public.{name}", "kind": "table", "full_name": f"public.{name}", "schema_name": "public", "table_name": name, "table": ("BASE TABLE", None)}

    def c(table_: str, name: str, kind: str = "bigint", family: str = "numeric") -> dict:
        full = f"public.{table_}.{name}"
        return {"id": f"column:{full}", "kind": "column", "full_name": full, "schema_name": "public", "table_name": table_, "column_name": name, "column": (kind, family, True, None, None)}

    def key(table_: str, name: str, kind: str, columns: list[str], ref: str | None = None) -> dict:
        full = f"public.{table_}.{name}"
        return {"id": f"constraint:{full}", "kind": kind, "full_name": full, "schema_name": "public", "table_name": table_, "constraint": (columns, ref, ["id"] if ref else [])}

    objects = [
        t("customers"), t("orders"), t("payments"), t("audit_events"),
        c("customers", "id"), c("customers", "email", "varchar", "string"), c("customers", "name", "text", "string"),
        c("orders", "id"), c("orders", "customer_id"), c("orders", "status", "varchar", "string"), c("orders", "total_amount", "numeric"),
        c("payments", "id"), c("payments", "order_id"), c("payments", "provider_token", "text", "string"), c("payments", "gateway_id"),
        c("audit_events", "event_id"), c("audit_events", "payload", "json", "other"),
        key("customers", "customers_pkey", "primary_key", ["id"]), key("orders", "orders_pkey", "primary_key", ["id"]), key("payments", "payments_pkey", "primary_key", ["id"]),
        key("payments", "payments_order_id_fkey", "foreign_key", ["order_id"], "public.orders"),
        {"id": "index:public.orders.orders_customer_idx", "kind": "index", "full_name": "public.orders.orders_customer_idx", "schema_name": "public", "table_name": "orders", "index": (False, ["customer_id"], None)},
    ]
    edges = [{"kind": "has_column", "from_id": f"table:public.{o['table_name']}", "to_id": o["id"]} for o in objects if o["kind"] == "column"]
    edges.append({"kind": "references", "from_id": "constraint:public.payments.payments_order_id_fkey", "to_id": "table:public.orders"})
    profiles = [{"object_id": "table:public.orders", "row_estimate": 42, "row_count_kind": "estimate"}]
    return graph(spark, objects, edges, profiles, provider="postgres", database="shop")


SHOP_SQL = (
    ("sql/orders.sql", "SELECT o.id, c.email FROM orders o JOIN customers c ON c.id = o.customer_id WHERE o.status = 'paid' ORDER BY o.id; UPDATE orders SET status = 'late' WHERE id = 1"),
    ("sql/report.sql", "WITH recent AS (SELECT * FROM orders WHERE total_amount > 10) SELECT r.status, count(*) FROM recent r GROUP BY r.status HAVING count(*) > 1"),
    ("sql/sweep.sql", "DELETE FROM payments; INSERT INTO audit_events (event_id) SELECT p.id FROM payments p WHERE p.provider_token IS NOT NULL"),
    ("sql/broken.sql", "select from"),
)


def shop_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SHOP_SQL), "source_path string, content string")
