"""Which rows and columns may be sampled: the only code that opens a data table for samples."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.model import ConfigError
from catalens.operators.profile import first_rows

# Words that a sampling filter may not have.
WRITE_WORDS = ("INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "TRUNCATE", "MERGE", "CALL", "GRANT", "REVOKE")
_WRITES = re.compile(rf"\b(?:{'|'.join(WRITE_WORDS)})\b", re.I)
_QUERIES = re.compile(r"\(\s*(?:select|with)\b", re.I)


@dataclass(frozen=True)
class Rule:
    table: str
    mode: str = "schema"
    columns: tuple[str, ...] = ()
    where: str | None = None
    limit: int | None = None
    order: tuple[str, ...] = ()
    store_raw: bool = False


def pattern_matches(pattern: str, table: str) -> bool:
    """`*`, the name itself, or one star between a beginning and an end."""
    if pattern in ("*", table):
        return True
    head, star, tail = pattern.partition("*")
    return bool(star) and table.startswith(head) and table.endswith(tail)


def rule_for(rules: list[Rule], table: str) -> Rule | None:
    return next((r for r in rules if pattern_matches(r.table, table)), None)


def check_where(where: str) -> None:
    if ";" in where or _WRITES.search(where) or _QUERIES.search(where):
        raise ConfigError("a sample rule's filter must be a read-only predicate without semicolons, write keywords or subqueries")


def check_rule(rule: Rule, mode: str, most: int) -> None:
    if rule.mode not in ("schema", "stats", "sample"):
        raise ConfigError(f"rule for `{rule.table}`: unknown mode `{rule.mode}`")
    if rule.mode != "sample":
        return
    if mode != "sample":
        raise ConfigError(f"rule for `{rule.table}` samples rows, but profiling mode is `{mode}`")
    if not rule.columns or any(not c.strip() for c in rule.columns):
        raise ConfigError(f"rule for `{rule.table}` must name the columns to sample")
    if rule.limit is not None and not 0 < rule.limit <= most:
        raise ConfigError(f"rule for `{rule.table}`: limit must be from 1 to {most}")
    if rule.where:
        check_where(rule.where)


def sample(rows: DataFrame, rule: Rule, most: int) -> DataFrame:
    """The allowed columns of the first allowed rows, filtered before anything is read."""
    check_rule(rule, "sample", most)
    kept = rows.where(F.expr(rule.where)) if rule.where else rows
    chosen = first_rows(kept, min(rule.limit or most, most), list(rule.order))
    return chosen.select(*rule.columns)


def jdbc_query(schema: str | None, table: str, rule: Rule, most: int, as_text: bool = True) -> str:
    """The same sample as one read-only statement for a database."""
    check_rule(rule, "sample", most)

    def quoted(name: str) -> str:
        return '"' + name.replace('"', '""') + '"'

    cols = ", ".join(f"({quoted(c)})::text AS {quoted(c)}" if as_text else quoted(c) for c in rule.columns)
    place = f"{quoted(schema)}.{quoted(table)}" if schema else quoted(table)
    where = f" WHERE {rule.where}" if rule.where else ""
    order = f" ORDER BY {', '.join(quoted(c) for c in rule.order)}" if rule.order else ""
    return f"SELECT {cols} FROM {place}{where}{order} LIMIT {min(rule.limit or most, most)}"
