"""Streaming extensions: SQL files as they arrive, and live workload counters over a stream of uses."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalens.lineage.graph import artifacts, parse_files
from catalens.operators.workload import COUNTED
from catalens.plans.store import Store


def sql_file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(source_path, content) of SQL files as they appear in a folder, each whole and once."""
    rows = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.sql").load(folder)
    return rows.select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("content"))


def sync_artifacts(files: DataFrame, store: Store, snapshot_id: str, checkpoint: str, dialect: str = "postgres"):
    """Parse arriving files and keep their artifacts. A batch that runs again writes the same rows: the last of equal
    fingerprints counts, so nothing is there twice."""

    def batch(rows: DataFrame, _: int) -> None:
        new = artifacts(parse_files(rows, dialect), snapshot_id)
        old = store.artifacts(snapshot_id).join(new.select("fingerprint"), "fingerprint", "left_anti")
        both = new.unionByName(old.select(*new.columns))
        # Written beside, at a place of this batch's own, and read back: a partition is never overwritten from itself.
        spark, beside = rows.sparkSession, f"{store.root}/sql_artifacts_next/{uuid.uuid4().hex}"
        both.write.parquet(beside)
        store._replace("sql_artifacts", spark.read.parquet(beside))
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(beside)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_workload(uses: DataFrame, at: str = "ts", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counters for each window and target over a stream (ts, fingerprint, kind, target), each use counted once a window;
    uses later than `late` are left out."""
    once = uses.withWatermark(at, late).withColumn("w", F.window(at, window)).dropDuplicatesWithinWatermark(["w", "fingerprint", "kind", "target"])
    sums = [F.count_if(F.col("kind") == kind).alias(name) for name, kind in COUNTED]
    return once.groupBy(F.window(at, window), "target").agg(*sums)
