"""Content hashes of a catalog: independent of row order, in two levels so that no string holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.model import Graph

_GROUPS = 256


def row_hashes(rows: DataFrame, ignored: tuple[str, ...] = ()) -> DataFrame:
    kept = sorted(c for c in rows.columns if c not in ignored)
    return rows.select(F.sha2(F.to_json(F.struct(*kept), {"ignoreNullFields": "true"}), 256).alias("h"))


def relation_hash(rows: DataFrame, ignored: tuple[str, ...] = ()) -> str:
    """SHA-256 over the sorted hashes of groups of rows, each over its sorted row hashes."""
    hashed = row_hashes(rows, ignored).withColumn("g", F.substring("h", 1, 2))
    groups = hashed.groupBy("g").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"))
    # At most _GROUPS rows: two hexadecimal digits.
    return groups.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("g", "h"))), ""), 256)).first()[0]


def content_hash(g: Graph) -> str:
    """Over provider, database, objects, edges and profiles; neither the time of capture nor the order of rows matters."""
    parts = [relation_hash(g.objects, ("obj_ord",)), relation_hash(g.edges, ("edge_ord",)), relation_hash(g.table_profiles), relation_hash(g.column_profiles)]
    return _of(g, parts)


def schema_hash(g: Graph) -> str:
    """As content_hash, without profiles: drift of row counts does not change it."""
    return _of(g, [relation_hash(g.objects, ("obj_ord",)), relation_hash(g.edges, ("edge_ord",))])


def _of(g: Graph, parts: list[str]) -> str:
    import hashlib

    return hashlib.sha256("|".join([g.provider, g.database, *parts]).encode()).hexdigest()
