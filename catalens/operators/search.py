"""Search over objects: a small query language, a scorer, a ranking; and an inverted index for whole tokens."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.functions import scalars as S

# How much a term's match is worth, and an object's kind.
SAME, BEGINS, HAS, MENTIONED, KIND_ASKED = 50.0, 25.0, 15.0, 10.0, 5.0
KIND_BONUS = {"table": 12.0, "view": 12.0, "materialized_view": 12.0, "column": 8.0, "query": 6.0, "sql_artifact": 6.0, "foreign_key": 5.0, "primary_key": 5.0, "unique_constraint": 5.0, "check_constraint": 5.0}
OTHER_BONUS = 1.0


@dataclass(frozen=True)
class Query:
    text: str
    kinds: tuple[str, ...] = ()
    schemas: tuple[str, ...] = ()
    names: tuple[str, ...] = ()


def parse_query(raw: str) -> Query:
    """kind:, schema: and name: filters, the rest as text; quotes keep white space together."""
    tokens, now, quoted = [], "", False
    for c in raw + " ":
        if c == '"':
            quoted = not quoted
        if c.isspace() and not quoted:
            if now:
                tokens.append(now)
            now = ""
        else:
            now += c
    if now.strip():
        tokens.append(now.rstrip())
    text, filters = [], {"kind": [], "schema": [], "name": []}
    for token in tokens:
        key, colon, value = token.partition(":")
        value = value[1:-1] if len(value) >= 2 and value[0] == value[-1] == '"' else value
        if colon and key in filters and value:
            filters[key].append(value if key == "name" else value.lower())
        else:
            text.append(token[1:-1] if len(token) >= 2 and token[0] == token[-1] == '"' else token)
    return Query(" ".join(text), tuple(filters["kind"]), tuple(filters["schema"]), tuple(filters["name"]))


def matches(query: Query) -> Column:
    """Any of the kinds, and any of the schemas, and any of the names."""
    found = F.lit(True)
    if query.kinds:
        found = found & F.col("kind").isin(*query.kinds)
    if query.schemas:
        found = found & F.coalesce(F.lower("schema_name").isin(*query.schemas), F.lit(False))
    if query.names:
        named = F.lit(False)
        for name in query.names:
            named = named | F.contains(F.lower("name"), F.lit(name.lower())) | F.contains(F.lower("full_name"), F.lit(name.lower()))
        found = found & named
    return found


def haystack() -> Column:
    return F.lower(F.concat_ws(" ", "name", "full_name", "metadata_json"))


def term_score(term: Column, name: Column, full_name: Column, text: Column) -> Column:
    exact = (F.lower(full_name) == term) | (F.lower(name) == term)
    placed = F.when(exact, SAME).when(F.lower(name).startswith(term), BEGINS).when(F.contains(F.lower(name), term), HAS).otherwise(0.0)
    return placed + F.when(F.contains(text, term), MENTIONED).otherwise(0.0)


def kind_bonus(kind: Column) -> Column:
    bonus = F.create_map(*[F.lit(x) for pair in KIND_BONUS.items() for x in pair])
    return F.coalesce(F.try_element_at(bonus, kind), F.lit(OTHER_BONUS))


def score(terms: Column, query: Query, name: str = "name", full_name: str = "full_name", text: Column | None = None, bonus: Column | None = None) -> Column:
    """0 where no term matches; without terms everything matches."""
    text = haystack() if text is None else text
    own = F.aggregate(terms, F.lit(0.0), lambda a, t: a + term_score(t, F.col(name), F.col(full_name), text))
    extra = (kind_bonus(F.col("kind")) if bonus is None else bonus) + (KIND_ASKED if query.kinds else 0.0)
    return F.when((F.size(terms) > 0) & (own == 0), 0.0).otherwise(own + extra)


def summary() -> Column:
    return F.coalesce("comment", F.col("table.comment"), F.col("column.comment"), S.preview(F.col("normalized_sql")), F.concat_ws(" ", "kind", "full_name"))


def search(objects: DataFrame, raw: str, limit: int = 20) -> DataFrame:
    """(id, kind, full_name, score, summary), best first, then by kind and name."""
    query = parse_query(raw)
    terms = S.extract_search_terms(F.lit(query.text))
    found = objects.where(matches(query)).withColumn("score", score(terms, query)).where("score > 0")
    return found.select("id", "kind", "full_name", "score", summary().alias("summary")).orderBy(F.desc("score"), "kind", "full_name", "id").limit(limit)


def token_index(objects: DataFrame) -> DataFrame:
    """(token, id): an inverted index over names and metadata, for whole tokens."""
    tokens = F.array_distinct(F.filter(F.split(haystack(), "[^a-z0-9]+"), lambda t: t != ""))
    return objects.select(F.explode(tokens).alias("token"), "id")


def lookup(index: DataFrame, objects: DataFrame, query: str) -> DataFrame:
    """Objects that have every token of the query."""
    wanted = sorted({t for t in "".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split()})
    if not wanted:
        return objects.limit(0)
    hits = index.where(F.col("token").isin(*wanted)).groupBy("id").agg(F.count_distinct("token").alias("n")).where(F.col("n") == len(wanted))
    return objects.join(hits, "id", "left_semi").orderBy("kind", "full_name", "id")
