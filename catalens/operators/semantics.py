"""Business annotations: descriptions, owners, deprecations for named objects."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalens.model import ConfigError, Graph, canonical_json


def load(path: str | Path) -> list[dict] | None:
    """The annotations of a file, None where there is no file."""
    path = Path(path)
    if not path.exists():
        return None
    try:
        found = json.loads(path.read_text())
    except ValueError as e:
        raise ConfigError(f"{path}: {e}") from e
    if found.get("version", 0) < 1:
        raise ConfigError(f"{path}: version must be above 0")
    rules = found.get("objects", [])
    if any(not str(r.get("object", "")).strip() for r in rules):
        raise ConfigError(f"{path}: every annotation must name its object")
    return rules


def annotate(g: Graph, rules: list[dict]) -> Graph:
    """Each rule goes to the first object with that full name, id or name; of several for one object the last counts."""
    if not rules:
        return g
    spark = g.objects.sparkSession
    given = [(i, r["object"], r.get("description"), bool(r.get("deprecated", False)), canonical_json({k: v for k, v in r.items() if k != "object"})) for i, r in enumerate(rules)]
    wanted = spark.createDataFrame(given, "rule_ord bigint, wanted string, description string, gone boolean, semantic_json string")
    names = g.objects.select("id", "obj_ord", F.explode(F.array_distinct(F.array("id", "full_name", "name"))).alias("wanted"))
    met = names.join(F.broadcast(wanted), "wanted")
    first = met.withColumn("n", F.row_number().over(W.partitionBy("rule_ord").orderBy("obj_ord"))).where("n = 1")
    last = first.withColumn("n", F.row_number().over(W.partitionBy("id").orderBy(F.desc("rule_ord")))).where("n = 1")
    told = last.select("id", "description", "gone", "semantic_json")
    out = g.objects.join(told, "id", "left")
    merged = F.when(
        F.col("semantic_json").isNotNull(),
        F.when(F.col("metadata_json") == "{}", F.concat(F.lit('{"semantic":'), "semantic_json", F.lit("}"))).otherwise(F.concat(F.expr("substring(metadata_json, 1, length(metadata_json) - 1)"), F.lit(',"semantic":'), "semantic_json", F.lit("}"))),
    ).otherwise(F.col("metadata_json"))
    out = out.withColumns({"semantic_description": F.coalesce("description", "semantic_description"), "deprecated": F.coalesce("gone", "deprecated"), "metadata_json": merged})
    return g.with_(objects=out.select(*g.objects.columns), metadata=g.metadata | {"semantics": {"objects": len(rules)}})
