"""Snapshots as Parquet tables, partitioned by snapshot, and their exchange as JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalens.model import COLUMN_PROFILES, EDGES, OBJECTS, TABLE_PROFILES, ConfigError, Graph
from catalens.operators.hashing import content_hash
from catalens.operators.search import token_index

VERSION = 1
RELATIONS = {"objects": OBJECTS, "edges": EDGES, "table_profiles": TABLE_PROFILES, "column_profiles": COLUMN_PROFILES}
SNAPSHOTS = "snapshot_id string, provider string, database string, created_at_ms bigint, content_hash string, version int, about string"
ARTIFACTS = "id string, snapshot_id string, source_path string, raw_sql string, normalized_sql string, fingerprint string, status string, diagnostics string, references_json string"


class Store:
    """The tables under one root. A snapshot is there once its row in `snapshots` is: that row is written last."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _exists(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path(name))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def _read(self, name: str, schema: str) -> DataFrame:
        full = schema if "snapshot_id" in schema else f"{schema}, snapshot_id string"
        if not self._exists(name):
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).parquet(self._path(name))

    def _replace(self, name: str, rows: DataFrame) -> None:
        """Only the partitions that rows have are overwritten."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(self._path(name))

    def write(self, g: Graph, artifacts: DataFrame | None = None) -> str:
        """Store a snapshot whole or, where ids repeat, not at all; returns its content hash."""
        for name in ("objects", "edges"):
            twice = getattr(g, name).groupBy("id").count().where("count > 1").orderBy("id").limit(1).collect()
            if twice:
                raise ConfigError(f"{name} hold the id `{twice[0]['id']}` more than once")
        mark = content_hash(g)
        for name in RELATIONS:
            self._replace(name, getattr(g, name).withColumn("snapshot_id", F.lit(g.snapshot_id)))
        self._replace("object_tokens", token_index(g.objects).withColumn("snapshot_id", F.lit(g.snapshot_id)))
        if artifacts is not None:
            last = W.partitionBy("snapshot_id", "fingerprint").orderBy(F.desc("source_path"))
            self._replace("sql_artifacts", artifacts.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n"))
        about = json.dumps({"capabilities": g.capabilities, "metadata": g.metadata}, sort_keys=True, default=str)
        row = self.spark.createDataFrame([(g.snapshot_id, g.provider, g.database, g.created_at_ms, mark, VERSION, about)], SNAPSHOTS)
        self._replace("snapshots", row)
        return mark

    def snapshots(self) -> DataFrame:
        return self._read("snapshots", SNAPSHOTS).orderBy("created_at_ms", "snapshot_id")

    def _ids(self) -> list[str]:
        return [r["snapshot_id"] for r in self.snapshots().select("snapshot_id", "created_at_ms").collect()]

    def latest(self) -> Graph:
        ids = self._ids()
        if not ids:
            raise ConfigError("there is no snapshot yet")
        return self.read(ids[-1])

    def previous(self) -> Graph:
        ids = self._ids()
        if len(ids) < 2:
            raise ConfigError("there is no previous snapshot")
        return self.read(ids[-2])

    def read(self, snapshot_id: str) -> Graph:
        row = self.snapshots().where(F.col("snapshot_id") == snapshot_id).first()
        if row is None:
            raise ConfigError(f"there is no snapshot `{snapshot_id}`")
        about = json.loads(row["about"])
        own = {k: self._read(k, s).where(F.col("snapshot_id") == snapshot_id).drop("snapshot_id") for k, s in RELATIONS.items()}
        return Graph(**own, provider=row["provider"], database=row["database"], created_at_ms=row["created_at_ms"], capabilities=about["capabilities"], metadata=about["metadata"])

    def tokens(self, snapshot_id: str) -> DataFrame:
        return self._read("object_tokens", "token string, id string").where(F.col("snapshot_id") == snapshot_id).drop("snapshot_id")

    def artifacts(self, snapshot_id: str | None = None) -> DataFrame:
        rows = self._read("sql_artifacts", ARTIFACTS)
        return (rows.where(F.col("snapshot_id") == snapshot_id) if snapshot_id else rows).orderBy("source_path", "fingerprint", "id")

    def counts(self, snapshot_id: str) -> dict[str, int]:
        g = self.read(snapshot_id)
        kinds = {r["kind"]: r["n"] for r in g.objects.groupBy("kind").agg(F.count("*").alias("n")).collect()}
        return {
            "objects": sum(kinds.values()), "tables": kinds.get("table", 0), "columns": kinds.get("column", 0), "queries": kinds.get("query", 0), "edges": g.edges.count(),
            "tableProfiles": g.table_profiles.count(), "columnProfiles": g.column_profiles.count(), "sqlArtifacts": self.artifacts(snapshot_id).count(),
        }

    def content_hash(self, snapshot_id: str) -> str | None:
        row = self.snapshots().where(F.col("snapshot_id") == snapshot_id).first()
        return row["content_hash"] if row else None


def to_json(g: Graph, path: str) -> None:
    """One directory of JSON lines for each relation: what another tool can read."""
    for name in RELATIONS:
        getattr(g, name).write.mode("overwrite").json(f"{path}/{name}")


def from_json(spark: SparkSession, path: str, **about) -> Graph:
    return Graph(**{k: spark.read.schema(s).option("mode", "FAILFAST").json(f"{path}/{k}") for k, s in RELATIONS.items()}, **about)
