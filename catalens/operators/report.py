"""Reports over findings: counts, score, sections, suppressions, baselines, gates, and their renderings."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalens.functions import scalars as S
from catalens.model import ConfigError
from catalens.operators.rules import RANK, SEVERITIES, in_order, severity_rank

# Points of a finding, and the sections of a report.
POINTS = {"critical": 25, "high": 10, "medium": 5, "low": 1}
SECTIONS = (
    ("security_privacy", "Security & Privacy", "scope = 'risk' AND (contains(rule_id, 'sensitive') OR rule_id = 'risk.select_star')"),
    ("data_integrity_schema_quality", "Data Integrity & Schema Quality", "scope = 'quality' AND NOT startswith(rule_id, 'data.')"),
    ("sql_workload_safety", "SQL Workload & Safety", "rule_id IN ('risk.update_without_where', 'risk.delete_without_where')"),
    ("performance", "Performance", "scope = 'performance'"),
    ("data_profiling_business_rules", "Data Profiling & Business Rules", "startswith(rule_id, 'data.')"),
)


def severity_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(F.count("*").alias("n"))


def risk_score(found: DataFrame) -> DataFrame:
    points = F.create_map(*[F.lit(x) for pair in POINTS.items() for x in pair])
    return found.agg(F.coalesce(F.sum(F.element_at(points, F.col("severity"))), F.lit(0)).cast("bigint").alias("risk_score"))


def sections(found: DataFrame) -> DataFrame:
    """(ord, section, n, and a count for each severity) of every section, those without findings too: one pass."""
    marks = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(k).alias("section"), F.expr(rule).alias("has")) for i, (k, _, rule) in enumerate(SECTIONS)])
    member = found.select("severity", F.explode(marks).alias("m")).where("m.has").select("severity", "m.section")
    counted = member.groupBy("section").agg(F.count("*").alias("n"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    all_ = found.sparkSession.createDataFrame([(i, k, t) for i, (k, t, _) in enumerate(SECTIONS)], "ord int, section string, title string")
    zero = {"n": 0} | dict.fromkeys(SEVERITIES, 0)
    return all_.join(counted, "section", "left").fillna(zero).select("ord", "section", "title", "n", *SEVERITIES).orderBy("ord")


def overview(n: int, score: int, active: bool = False) -> str:
    what = "open after suppression" if active else "in all"
    return f"Findings {what}: {n}; risk score: {score}." if n else f"Findings {what}: none."


def load_suppressions(path: str | Path) -> list[dict]:
    try:
        found = json.loads(Path(path).read_text())
    except (OSError, ValueError) as e:
        raise ConfigError(f"{path}: {e}") from e
    if found.get("version") != 1:
        raise ConfigError(f"{path}: version must be 1")
    for s in found.get("suppressions", []):
        if any(not str(s.get(k, "")).strip() for k in ("ruleId", "object", "reason", "owner")):
            raise ConfigError(f"{path}: ruleId, object, reason and owner must not be empty")
    return found.get("suppressions", [])


def suppress(found: DataFrame, rules: list[dict]) -> DataFrame:
    """Adds `suppressed` and `expired`: the first rule for (rule id, object) counts, and an expired one leaves it active."""
    given = [(i, r["ruleId"], r["object"], r.get("expiresAt")) for i, r in enumerate(rules)]
    table = found.sparkSession.createDataFrame(given, "n bigint, rule_id string, object string, expires string")
    first = table.withColumn("k", F.row_number().over(W.partitionBy("rule_id", "object").orderBy("n"))).where("k = 1").select("rule_id", "object", "n", "expires")
    met = found.join(first, ["rule_id", "object"], "left")
    expired = F.col("n").isNotNull() & S.is_expired(F.col("expires"))
    return met.withColumns({"expired": expired, "suppressed": F.col("n").isNotNull() & ~expired}).drop("n", "expires")


def new_since(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose fingerprint no earlier report has, suppressed or not."""
    return found.join(baseline.select("fingerprint").distinct(), "fingerprint", "left_anti")


def load_baseline(spark, path: str | Path) -> DataFrame:
    report = json.loads(Path(path).read_text())
    prints = [(f["fingerprint"],) for key in ("findings", "suppressedFindings") for f in report.get(key, [])]
    return spark.createDataFrame(prints, "fingerprint string")


def at_least(found: DataFrame, severity: str) -> DataFrame:
    if severity not in RANK:
        raise ConfigError(f"severity must be one of {', '.join(SEVERITIES)}")
    return found.where(severity_rank(F.col("severity")) >= RANK[severity])


def report(found: DataFrame, scope: str = "all", suppressions: list[dict] | None = None, include_suppressed: bool = False, fail_on: str | None = None, baseline: DataFrame | None = None, fail_on_new: str | None = None, top: int = 5) -> dict:
    """The whole report, sections and score over active findings alone, and what the gate says."""
    tagged = suppress(found, suppressions or []).cache()
    active = tagged.where("NOT suppressed")
    rows = [r.asDict(recursive=True) for r in in_order(tagged).collect()]
    shown = [r for r in rows if include_suppressed or not r["suppressed"]]
    score = risk_score(active).first()[0]
    alive = [r for r in rows if not r["suppressed"]]
    failing = at_least(active, fail_on).count() if fail_on else 0
    fresh = at_least(new_since(active, baseline), fail_on_new).count() if fail_on_new and baseline is not None else 0
    out = {
        "scope": scope,
        "summary": overview(len(alive), score, bool(suppressions)),
        "riskScore": score,
        "severityCounts": {r["severity"]: r["n"] for r in severity_counts(active).collect()},
        "sections": [r.asDict() for r in sections(active).collect()],
        "topFindings": alive[:top],
        "findings": shown,
        "suppressedFindings": [r for r in rows if r["suppressed"]],
        "expiredSuppressions": sum(r["expired"] for r in rows),
        "gate": {"failed": bool(failing or fresh), "failing": failing, "newFailing": fresh, "failOn": fail_on, "failOnNew": fail_on_new},
    }
    tagged.unpersist()
    return out


def render(rep: dict, form: str = "text") -> str:
    if form == "json":
        return json.dumps(rep, indent=2, sort_keys=True, default=str) + "\n"
    if form not in ("text", "markdown"):
        raise ConfigError("format must be text, json or markdown")
    head = "# Catalog analysis\n\n" if form == "markdown" else "Catalog analysis\n"
    lines = [head + rep["summary"], ""]
    for s in rep["sections"]:
        lines.append(f"{'## ' if form == 'markdown' else ''}{s['title']}: {s['n']}")
    lines.append("")
    for f in rep["findings"]:
        mark = " (suppressed)" if f["suppressed"] else ""
        lines.append(f"- [{f['severity']}] {f['rule_id']} {f['object']}{mark}: {f['message']} — {f['evidence']}. {f['suggested_fix']}")
    gate = rep["gate"]
    if gate["failOn"] or gate["failOnNew"]:
        lines += ["", f"Gate: {'failed' if gate['failed'] else 'passed'}"]
    return "\n".join(lines) + "\n"
