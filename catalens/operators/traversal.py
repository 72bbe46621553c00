"""Graph operators over any pair of relations (objects, edges): resolution, relation paths, impact, neighbours.

Frontiers join with the edges, one join a level. Where several edges reach an object the first edge in order counts, by a
minimum over edge order, so no result depends on how rows are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalens.model import ConfigError, Graph

DIRECTIONS = ("incoming", "outgoing", "both")
NEIGHBOUR_SCORE = 15.0 * 0.35


def matches_name(name: str) -> Column:
    """Whether an object goes by this name: its id, full name or name, or the end of its full name, whatever the case."""
    wanted = F.lit(name.lower())
    full = F.lower("full_name")
    return (F.lower("id") == wanted) | (full == wanted) | (F.lower("name") == wanted) | full.endswith(F.concat(F.lit("."), wanted))


def resolve(objects: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    """The first object that goes by the name: no row or one."""
    found = objects.where(matches_name(name))
    return (found.where(F.col("kind") == kind) if kind else found).orderBy("obj_ord").limit(1)


def resolved(objects: DataFrame, name: str, kind: str | None = None):
    found = resolve(objects, name, kind).collect()
    if not found:
        raise ConfigError(f"{kind or 'object'} `{name}` was not found in the latest snapshot")
    return found[0]


def steps(edges: DataFrame, direction: str = "both") -> DataFrame:
    """(at, next, kind, edge_ord, edge_id, confidence) of every way to walk an edge."""
    if direction not in DIRECTIONS:
        raise ConfigError(f"direction must be one of {', '.join(DIRECTIONS)}")
    rest = ["kind", "edge_ord", F.col("id").alias("edge_id"), "confidence"]
    out = edges.select(F.col("from_id").alias("at"), F.col("to_id").alias("next"), *rest)
    back = edges.select(F.col("to_id").alias("at"), F.col("from_id").alias("next"), *rest)
    if direction != "both":
        return out if direction == "outgoing" else back
    return out.union(back.where("at != next"))


def relation_paths(g: Graph, starts: DataFrame, depth: int = 1, direction: str = "both") -> DataFrame:
    """(start, path, kinds, edge_ids, depth): a path for every edge at a start, and for every edge at an object reached from it.

    An object is left only by the first path that reached it, and the start only once; paths may lead back, and end at known
    objects alone.
    """
    if depth not in (1, 2):
        raise ConfigError("depth must be 1 or 2")
    known = g.objects.select(F.col("id").alias("next"), F.col("full_name").alias("next_name"))
    walk = steps(g.edges, direction).join(known, "next")
    first = starts.select(F.col("id").alias("start"), F.col("full_name").alias("start_name")).join(walk, F.col("start") == F.col("at"))
    level = first.select(
        "start", F.col("next").alias("last"), F.array("start_name", "next_name").alias("path"), F.array("kind").alias("kinds"),
        F.array("edge_id").alias("edge_ids"), "edge_ord", F.lit(1).alias("depth"),
    )
    out = level
    if depth == 2:
        reached = level.where(F.col("last") != F.col("start")).groupBy("start", "last").agg(F.min_by(F.struct("path", "kinds", "edge_ids"), "edge_ord").alias("p"), F.min("edge_ord").alias("first_ord"))
        second = reached.join(walk, F.col("last") == F.col("at")).select(
            "start", F.col("next").alias("last"), F.concat("p.path", F.array("next_name")).alias("path"), F.concat("p.kinds", F.array("kind")).alias("kinds"),
            F.concat("p.edge_ids", F.array("edge_id")).alias("edge_ids"), "edge_ord", F.lit(2).alias("depth"),
        )
        out = level.unionByName(second)
    return out.select("start", "path", "kinds", "edge_ids", "depth")


def relations(g: Graph, name: str, depth: int = 1, direction: str = "both") -> DataFrame:
    """The relation paths of one object in their order: by the objects on them, then by length."""
    start = resolved(g.objects, name)
    found = relation_paths(g, g.objects.where(F.col("id") == start["id"]), depth, direction)
    return found.withColumn("objects", F.array_join("path", ">")).orderBy("objects", F.size("kinds"), F.array_join("edge_ids", ","))


def impact_levels(g: Graph, starts: DataFrame, depth: int = 2) -> DataFrame:
    """(start, id, depth, evidence): every object within depth edges of a start, once, by the first edge that reached it.

    starts has columns start, id, depth, evidence and ord: usually the object itself at depth 0.
    """
    walk = steps(g.edges).join(g.objects.select(F.col("id").alias("next")), "next")
    seen = starts.select("start", "id", "depth", "evidence", "ord")
    for level in range(depth):
        ahead = seen.where(F.col("depth") == level).alias("s").join(walk, F.col("s.id") == F.col("at"))
        text = F.when(F.col("s.evidence") == "", F.col("kind")).otherwise(F.concat_ws(" -> ", "s.evidence", "kind"))
        found = ahead.select("s.start", F.col("next").alias("id"), F.lit(level + 1).alias("depth"), text.alias("evidence"), F.struct(F.col("s.ord").alias("a"), F.col("edge_ord").alias("b")).alias("way"))
        found = found.join(seen.select("start", "id"), ["start", "id"], "left_anti")
        found = found.groupBy("start", "id", "depth").agg(F.min_by("evidence", "way").alias("evidence"), F.min("way").alias("way"))
        # The order in which the objects of a level were reached decides which of them is left first.
        order = W.partitionBy("start").orderBy("way")
        seen = seen.unionByName(found.withColumn("ord", F.row_number().over(order).cast("bigint")).drop("way"))
    return seen


PARTS = ("column", "primary_key", "foreign_key", "unique_constraint", "check_constraint", "index", "trigger")


def impact(g: Graph, name: str, depth: int = 2) -> DataFrame:
    """(scope, kind, full_name, evidence) of what a change to an object touches, direct before indirect, then by name."""
    if depth not in (1, 2):
        raise ConfigError("depth must be 1 or 2")
    target = resolved(g.objects, name)
    spark = g.objects.sparkSession
    starts = [(target["id"], target["id"], 0, "", 0)]
    if target["kind"] in PARTS and target["table_name"]:
        same_schema = F.lit(target["schema_name"] is None) | F.col("schema_name").eqNullSafe(F.lit(target["schema_name"]))
        table = g.objects.where((F.col("kind") == "table") & (F.coalesce("table_name", "name") == target["table_name"]) & same_schema).orderBy("obj_ord").limit(1).collect()
        starts += [(target["id"], t["id"], 1, "column belongs to table", 0) for t in table]
    begun = spark.createDataFrame(starts, "start string, id string, depth int, evidence string, ord bigint")
    found = impact_levels(g, begun, depth).where(F.col("id") != F.col("start"))
    direct = F.col("depth") == 1
    named = found.join(g.objects.select("id", "kind", "full_name"), "id")
    return named.select(F.when(direct, "direct").otherwise("indirect").alias("scope"), "kind", "full_name", "evidence").orderBy("scope", "full_name")


LARGE_TABLE = 1_000_000


def impact_risks(g: Graph, name: str) -> DataFrame:
    """(message, evidence): what to watch when the object changes."""
    target = resolved(g.objects, name)
    one = g.objects.where(F.col("id") == target["id"])
    full, short = F.lower("full_name"), F.lower("name")
    notes = [
        one.where(full.endswith(".tenant_id") | (short == "tenant_id")).select(F.lit("Rows of one tenant may become visible to others: check every filter on this column").alias("message"), F.col("full_name").alias("evidence")),
        one.where(full.endswith(".status") | (short == "status")).select(F.lit("Statements that branch on this state may take other paths: check the values they compare").alias("message"), F.col("full_name").alias("evidence")),
        one.where(F.col("kind").isin("unique_constraint", "foreign_key", "primary_key")).select(F.concat("kind", F.lit(" guards which rows may exist: check for rows that break the new rule")).alias("message"), F.col("full_name").alias("evidence")),
        one.join(g.table_profiles, one["id"] == g.table_profiles["object_id"])
        .where(F.col("row_estimate") > LARGE_TABLE)
        .select(F.lit("Many rows to rewrite: plan for locks and running time").alias("message"), F.concat("full_name", F.lit(" row estimate "), F.col("row_estimate").cast("string")).alias("evidence")),
    ]
    out = notes[0]
    for n in notes[1:]:
        out = out.unionByName(n)
    return out


def neighbour_scores(g: Graph, seeds: DataFrame, each: float = NEIGHBOUR_SCORE) -> DataFrame:
    """(id, score): for every edge that touches a seed, `each` to both of its ends that are known objects."""
    picked = seeds.select(F.col("id").alias("seed")).distinct()
    ends = g.edges.select("edge_ord", F.col("id").alias("edge_id"), "from_id", "to_id", F.explode(F.array("from_id", "to_id")).alias("end"))
    touching = ends.join(picked, F.col("end") == F.col("seed"), "left_semi").select("edge_ord", "edge_id", "from_id", "to_id").distinct()
    both = touching.select(F.explode(F.array("from_id", "to_id")).alias("id"))
    return both.join(g.objects.select("id"), "id", "left_semi").groupBy("id").agg((F.count("*") * each).alias("score"))


def edges_among(g: Graph, selected: DataFrame) -> DataFrame:
    """(path, edge_ord): `from -kind-> to` for each edge between selected objects (full_name)."""
    named = g.objects.join(selected.select("full_name").distinct(), "full_name", "left_semi").select("id", "full_name")
    a = named.select(F.col("id").alias("from_id"), F.col("full_name").alias("from_name"))
    b = named.select(F.col("id").alias("to_id"), F.col("full_name").alias("to_name"))
    text = F.concat("from_name", F.lit(" -"), "kind", F.lit("-> "), "to_name")
    return g.edges.join(a, "from_id").join(b, "to_id").select(text.alias("path"), "edge_ord").orderBy("edge_ord")
