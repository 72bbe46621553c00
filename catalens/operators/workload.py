"""Workload counters from the edges that leave query objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.model import Graph

COUNTED = (("reads", "reads_from"), ("writes", "writes_to"), ("joins", "joins_on"), ("filters", "filters_by"))


def query_uses(g: Graph) -> DataFrame:
    """(fingerprint, kind, target), once for each statement however many artifacts hold it."""
    queries = g.objects.where("kind = 'query'").select(F.col("id").alias("from_id"), F.coalesce("fingerprint", "id").alias("fingerprint"))
    return g.edges.join(queries, "from_id").select("fingerprint", "kind", F.col("to_id").alias("target")).distinct()


def counters(uses: DataFrame) -> DataFrame:
    """(target, reads, writes, joins, filters, frequency) over rows (fingerprint, kind, target), taken as distinct."""
    sums = [F.count_if(F.col("kind") == kind).alias(name) for name, kind in COUNTED]
    counted = uses.distinct().groupBy("target").agg(*sums)
    return counted.withColumn("frequency", sum((F.col(name) for name, _ in COUNTED), F.lit(0).cast("bigint")))


def unique_fingerprints(g: Graph) -> DataFrame:
    return g.objects.where("kind = 'query'").agg(F.count_distinct(F.coalesce("fingerprint", "id")).alias("unique_fingerprints"))
