"""The session's own catalog: databases, tables, views and the statistics that ANALYZE TABLE has left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catalens.model import CAPABILITIES, Graph
from catalens.sources.base import Provider
from catalens.sources.canonical import canonicalize, staging
from catalens.sources.families import spark_family


class SparkCatalogProvider(Provider):
    id = "spark"
    capabilities = dict.fromkeys(CAPABILITIES, "supported") | {"constraints": "unsupported", "indexes": "unsupported", "triggers": "unsupported"}

    def __init__(self, databases: tuple[str, ...] | None = None):
        self.databases = databases

    def connect(self) -> dict:
        return {"database": "spark_catalog"}

    def table(self, spark: SparkSession, schema: str, name: str) -> DataFrame:
        return spark.table(f"`{schema}`.`{name}`")

    def snapshot(self, spark: SparkSession) -> Graph:
        names = self.databases or tuple(d.name for d in spark.catalog.listDatabases())
        tables, views, columns, stats = [], [], [], []
        for db in names:
            for t in spark.catalog.listTables(db):
                if t.isTemporary:
                    continue
                if t.tableType == "VIEW":
                    text = spark.sql(f"SHOW CREATE TABLE `{db}`.`{t.name}`").first()[0]
                    views.append((db, t.name, False, text))
                else:
                    tables.append((db, t.name, t.tableType, t.description))
                    about = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED `{db}`.`{t.name}`").collect()}
                    told = about.get("Statistics") or ""
                    size = next((int(w) for w, unit in zip(told.split(), told.split()[1:], strict=False) if unit.startswith("bytes")), None)
                    rows = next((int(w) for w, unit in zip(told.split(), told.split()[1:], strict=False) if unit.startswith("rows")), None)
                    stats.append((db, t.name, rows, None, size, "spark.statistics"))
                for i, c in enumerate(spark.catalog.listColumns(t.name, db)):
                    columns.append((db, t.name, c.name, i, c.dataType, spark_family(c.dataType), c.nullable, None, c.description))
        stage = staging(spark, schemas=[(d, None) for d in names], tables=tables, views=views, columns=columns, table_stats=stats)
        return canonicalize(stage, self.id, "spark_catalog", capabilities=self.capabilities)
