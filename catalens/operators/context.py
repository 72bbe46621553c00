"""Ranked context for a question, under a budget of objects and tokens."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalens.functions import scalars as S
from catalens.model import Graph
from catalens.operators import search, traversal, workload


@dataclass(frozen=True)
class Weights:
    text: float = 1.0
    neighbour: float = 0.35
    statistics: float = 0.1
    workload: float = 0.2


def summary() -> Column:
    return F.coalesce("semantic_description", "comment", F.concat_ws(" ", "kind", "full_name"))


def within_budget(rows: DataFrame, order: list, cost: str, budget: int, most: int, group: list[str] | None = None) -> DataFrame:
    """The longest prefix of the ordered rows that keeps to both limits: costs are never negative, so running sums decide."""
    by = W.partitionBy(*(group or [])).orderBy(*order)
    spent = F.sum(cost).over(by.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumns({"spent": spent, "place": F.row_number().over(by)}).where((F.col("spent") <= budget) & (F.col("place") <= most))


def scores(g: Graph, question: str, max_objects: int = 12, weights: Weights = Weights()) -> DataFrame:
    """(id, score): search hits, their neighbours, what statistics and workload add to either."""
    hits = search.search(g.objects, question, 2 * max_objects)
    seeds = hits.select("id", (F.col("score") * weights.text).alias("score"))
    near = traversal.neighbour_scores(g, seeds, 15.0 * weights.neighbour)
    found = seeds.unionByName(near).groupBy("id").agg(F.sum("score").alias("score"))
    counted = g.table_profiles.where("row_estimate > 0").select(F.col("object_id").alias("id")).distinct().withColumn("statistics", F.lit(weights.statistics))
    used = workload.counters(workload.query_uses(g)).select(F.col("target").alias("id"), (F.col("frequency") * weights.workload).alias("use"))
    joined = found.join(counted, "id", "left").join(used, "id", "left")
    return joined.select("id", (F.col("score") + F.coalesce("statistics", F.lit(0.0)) + F.coalesce("use", F.lit(0.0))).alias("score"))


def context(g: Graph, question: str, token_budget: int = 800, max_objects: int = 12, weights: Weights = Weights()) -> DataFrame:
    """(place, kind, full_name, summary, score, tokens, spent) of the objects that fit, best first."""
    rows = scores(g, question, max_objects, weights).join(g.objects, "id").withColumn("summary", summary())
    rows = rows.withColumn("tokens", S.estimate_tokens(F.col("full_name")) + S.estimate_tokens(F.col("summary")) + 4)
    kept = within_budget(rows, [F.desc("score"), "full_name", "id"], "tokens", token_budget, max_objects)
    return kept.select("place", "kind", "full_name", "summary", "score", "tokens", "spent").orderBy("place")


# What a package says besides its objects.
RISKS = ("Nothing here was run: validate a statement against the catalog before you change data with it.",)
NEXT_TOOLS = ("table <table>", "relations <object>", "validate-sql --sql <SQL>")


def package(g: Graph, question: str, token_budget: int = 800, max_objects: int = 12) -> dict:
    chosen = context(g, question, token_budget, max_objects).cache()
    rows = [r.asDict() for r in chosen.collect()]
    terms = g.objects.sparkSession.range(1).select(S.extract_search_terms(F.lit(search.parse_query(question).text))).first()[0]
    paths = [r["path"] for r in traversal.edges_among(g, chosen).collect()]
    chosen.unpersist()
    return {
        "query": question,
        "objects": [{k: r[k] for k in ("kind", "full_name", "summary", "score")} for r in rows],
        "relationPaths": paths,
        "risks": list(RISKS),
        "suggestedNextTools": list(NEXT_TOOLS),
        "rankingNotes": [f"terms: {', '.join(terms)}"],
        "estimatedTokens": rows[-1]["spent"] if rows else 0,
    }
