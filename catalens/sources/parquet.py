"""A directory of Parquet tables as a catalog. Files declare no keys, so keys and indexes come from a declaration."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalens.model import CAPABILITIES, ConfigError, Graph
from catalens.sources.base import Provider
from catalens.sources.canonical import canonicalize, staging
from catalens.sources.families import spark_family

SCHEMA = "main"


class ParquetProvider(Provider):
    id = "parquet"
    capabilities = dict.fromkeys(CAPABILITIES, "supported") | {"routines": "unsupported", "triggers": "unsupported", "views": "unsupported"}

    def __init__(self, url: str, tables: tuple[str, ...] | None = None, keys: dict[str, tuple[str, ...]] | None = None, references: tuple[tuple, ...] = (), indexes: tuple[tuple, ...] = (), counts: bool = True):
        if not url:
            raise ConfigError("a Parquet source needs the path of its directory")
        self.url, self.names, self.keys, self.references, self.indexes, self.counts = url.rstrip("/"), tables, keys or {}, references, indexes, counts

    def tables(self, spark: SparkSession) -> list[str]:
        """The tables named, or all of the directory, listed by the file system that holds it."""
        if self.names:
            return sorted(self.names)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.url)
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
        return sorted(f.getPath().getName().removesuffix(".parquet") for f in found if f.getPath().getName().endswith(".parquet"))

    def connect(self) -> dict:
        return {"database": self.url.rsplit("/", 1)[-1]}

    def table(self, spark: SparkSession, schema: str, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.url}/{name}.parquet")

    def snapshot(self, spark: SparkSession) -> Graph:
        names = self.tables(spark)
        columns, stats = [], []
        # Each table's schema takes a job of its own: they run side by side.
        with ThreadPoolExecutor(max(1, min(16, len(names)))) as pool:
            tables = dict(zip(names, pool.map(lambda t: self.table(spark, SCHEMA, t), names), strict=True))
        for t in names:
            for i, f in enumerate(tables[t].schema.fields):
                kind = f.dataType.simpleString()
                keyed = f.name in self.keys.get(t, ())
                columns.append((SCHEMA, t, f.name, i, kind, spark_family(kind), not keyed, None, None))
        if self.counts and names:
            # Parquet footers hold row counts: nothing else is read, and one job reads them all.
            counted = [tables[t].agg(F.count("*").alias("n")).select(F.lit(t).alias("t"), "n") for t in names]
            stats = [(SCHEMA, r["t"], r["n"], "exact", None, "parquet.footer") for r in reduce(DataFrame.unionByName, counted).collect()]
        nothing = (None,) * 3
        constraints = [(SCHEMA, t, f"{t}_pkey", "p", list(cols), None, None, None, *nothing) for t, cols in self.keys.items() if t in names]
        constraints += [(SCHEMA, t, f"{t}_{'_'.join(own)}_fkey", "f", list(own), SCHEMA, to, list(there), *nothing) for t, own, to, there in self.references if t in names]
        indexes = [(SCHEMA, t, f"{t}_{'_'.join(cols)}_idx", False, list(cols), None, None) for t, cols in self.indexes if t in names]
        stage = staging(spark, schemas=[(SCHEMA, None)], tables=[(SCHEMA, t, "PARQUET", None) for t in names], columns=columns, constraints=constraints, indexes=indexes, table_stats=stats)
        return canonicalize(stage, self.id, self.connect()["database"], capabilities=self.capabilities)
