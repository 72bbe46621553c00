"""What a user calls: capture, sync, and the read-only questions over stored snapshots."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalens.functions import scalars as S
from catalens.lineage import graph as lineage
from catalens.lineage.parse import dialect_for
from catalens.model import ConfigError, Graph
from catalens.operators import context as ctx
from catalens.operators import diff, hashing, inference, policy, profile, report, rules, search, semantics, traversal, workload
from catalens.plans.project import Config, Project
from catalens.plans.store import Store
from catalens.sources.base import provider
from catalens.sources.files import materials, sql_files
from catalens.sources.synthetic import synthetic


class Engine:
    def __init__(self, spark: SparkSession, project: Project):
        self.spark, self.project = spark, project
        self.store = Store(spark, project.warehouse)

    # Capture --------------------------------------------------------------------------------------------------------
    def capture(self, config: Config | None = None, infer: bool = False) -> tuple[Graph, DataFrame | None]:
        """The catalog as it is now: scanned, profiled by policy, scored, annotated and enriched with SQL; nothing is stored."""
        config = (config or self.project.config()).check()
        source = provider(config.provider, config.url())
        g = source.snapshot(self.spark).with_(created_at_ms=int(time.time() * 1000))
        g = profile.with_policy(g, config.profiling_mode, config.max_rows_per_table, config.mask_pii, config.store_raw_samples)
        if config.profiling_mode == "sample":
            g = self.sampled(g, source, config)
        if config.mask_pii:
            g = profile.with_privacy(g, config.terms())
        found = semantics.load(self.project.semantics)
        if found:
            g = semantics.annotate(g, found)
        artifacts = None
        files = sql_files(self.spark, str(self.project.root), tuple(config.sql_include), tuple(config.sql_exclude))
        if files.limit(1).count():
            g, artifacts = lineage.enrich(g, files, dialect_for(config.provider))
        return (inference.with_inferred(g) if infer else g), artifacts

    def sampled(self, g: Graph, source, config: Config) -> Graph:
        """Summaries of the columns that the policy allows, by the first rule that fits a table."""
        chosen, log = [], []
        tables = [(r["schema_name"], r["table_name"], r["full_name"]) for r in g.objects.where("kind = 'table'").orderBy("obj_ord").select("schema_name", "table_name", "full_name").collect()]
        scores = {r["full_name"]: r["pii_score"] for r in profile.privacy_scores(g.objects, config.terms()).join(g.objects.select(F.col("id").alias("object_id"), "full_name"), "object_id").collect()}
        for schema, table, full in tables:
            rule = policy.rule_for(config.rules(), full) or policy.rule_for(config.rules(), table)
            if rule is None:
                continue
            log.append({"table": full, "mode": rule.mode, "columns": list(rule.columns)})
            if rule.mode != "sample":
                continue
            rows = profile.numbered(source.sample(self.spark, schema, table, rule, config.max_rows_per_table), list(rule.order))
            kinds = dict(rows.dtypes)
            for c in rule.columns:
                sensitive = scores.get(f"{full}.{c}", 0.0) >= S.SENSITIVE_FROM
                got = profile.summarize(rows, c, "__o", sensitive, config.store_raw_samples or rule.store_raw, temporal=kinds[c].startswith(("timestamp", "date")))
                chosen.append(got.select(F.lit(f"column:{full}.{c}").alias("object_id"), "summary"))
        g = g.with_(metadata=g.metadata | {"dataAccess": log})
        return profile.with_summaries(g, reduce(DataFrame.unionByName, chosen)) if chosen else g

    def snapshot(self, config: Config | None = None, infer: bool = False) -> dict:
        g, artifacts = self.capture(config, infer)
        g = g.with_(objects=g.objects.cache(), edges=g.edges.cache())
        mark = self.store.write(g, artifacts)
        return {"snapshotId": g.snapshot_id, "contentHash": mark, **self.store.counts(g.snapshot_id)}

    def sync(self, config: Config | None = None) -> dict:
        """Store a snapshot only where its content differs from the latest."""
        g, artifacts = self.capture(config)
        ids = [r["snapshot_id"] for r in self.store.snapshots().collect()]
        mark = hashing.content_hash(g)
        if ids and self.store.content_hash(ids[-1]) == mark:
            return {"changed": False, "snapshotId": ids[-1], "contentHash": mark}
        self.store.write(g, artifacts)
        return {"changed": True, "snapshotId": g.snapshot_id, "contentHash": mark}

    # Questions ------------------------------------------------------------------------------------------------------
    def search(self, query: str, kind: str | None = None, limit: int = 20) -> list[dict]:
        asked = f"kind:{kind} {query}" if kind else query
        return [r.asDict() for r in search.search(self.store.latest().objects, asked, limit).collect()]

    def table(self, name: str, most: int = 50) -> dict:
        return table_card(self.store.latest(), name, most)

    def relations(self, name: str, depth: int = 1, direction: str = "both", most: int | None = None) -> dict:
        rows = traversal.relations(self.store.latest(), name, depth, direction).collect()
        kept = rows if most is None else rows[:most]
        return {"object": name, "paths": [{"objects": r["path"], "edges": r["kinds"]} for r in kept], "omitted": len(rows) - len(kept)}

    def context(self, question: str, tokens: int = 800, max_objects: int = 12) -> dict:
        return ctx.package(self.store.latest(), question, tokens, max_objects)

    def impact(self, name: str, depth: int = 2) -> dict:
        g = self.store.latest()
        return {"target": name, "items": [r.asDict() for r in traversal.impact(g, name, depth).collect()], "risks": [r.asDict() for r in traversal.impact_risks(g, name).collect()]}

    def diff(self) -> dict:
        before, now = self.store.previous(), self.store.latest()
        return {"changes": [r.asDict() for r in diff.changes(before.objects, now.objects).collect()], "renameCandidates": [r.asDict() for r in diff.rename_candidates(before.objects, now.objects).collect()]}

    def analyze(self, scope: str = "all", include_suppressed: bool = False, fail_on: str | None = None, baseline: str | None = None, fail_on_new: str | None = None) -> dict:
        rules_ = report.load_suppressions(self.project.suppressions) if self.project.suppressions.exists() else []
        old = report.load_baseline(self.spark, baseline) if baseline else None
        return report.report(rules.analyze(self.store.latest(), scope), scope, rules_, include_suppressed, fail_on, old, fail_on_new)

    def workload(self) -> list[dict]:
        g = self.store.latest()
        named = workload.counters(workload.query_uses(g)).join(g.objects.select(F.col("id").alias("target"), "full_name"), "target", "left")
        return [r.asDict() for r in named.orderBy(F.desc("frequency"), "target").collect()]

    def validate_sql(self, sql: str, dialect: str | None = None) -> dict:
        g = self.store.latest()
        return lineage.validate(g, sql, dialect or dialect_for(g.provider))

    def status(self) -> dict:
        config, found = self.project.config(), self.store.snapshots().collect()
        return {"root": str(self.project.root), "provider": config.provider, "snapshots": len(found), "latest": found[-1]["snapshot_id"] if found else None}

    def doctor(self, check_db: bool = False) -> dict:
        """Checks of a project, worst status first in the roll-up, with what to do about each."""
        checks: list[tuple[str, str, str]] = []

        def check(name: str, f, hint: str) -> None:
            try:
                checks.append((name, "ok", str(f())))
            except ConfigError as e:
                checks.append((name, "error", f"{e} ({hint})"))

        check("project", lambda: self.project.state, "run init")
        check("config", lambda: self.project.config().check().provider, "correct the configuration")
        check("connection", lambda: bool(self.project.config().url()), "set the connection")
        if check_db:
            check("database", lambda: provider(self.project.config().provider, self.project.config().url()).connect(), "see that the database can be reached")
        check("snapshots", lambda: self.store.latest().snapshot_id, "run snapshot")
        rank = {"ok": 0, "warning": 1, "error": 2}
        worst = max((s for _, s, _ in checks), key=rank.get)
        return {"status": worst, "checks": [{"name": n, "status": s, "detail": d} for n, s, d in checks], "suggestions": sorted({d.rsplit("(", 1)[-1].rstrip(")") for _, s, d in checks if s != "ok"})}

    def benchmark(self, tables: int, columns: int) -> dict:
        g = synthetic(self.spark, tables, columns)
        return {"tables": tables, "columnsPerTable": columns, "objects": g.objects.count(), "edges": g.edges.count(), "contentHash": hashing.content_hash(g)}

    def benchmark_context(self, cases: list[dict], tokens: int = 1200, max_objects: int = 12) -> dict:
        """For each case {name, question, expected}: tokens, recall and precision of raw material and of ranked context."""
        import json

        g = self.store.latest()
        raw = "\n".join(r["content"] for r in materials(self.spark, str(self.project.root)).collect())
        found = rules.analyze(g).cache()
        rows = []
        for i, case in enumerate(cases):
            touching = [r.asDict(recursive=True) for r in found.collect() if case.get("all") or any(e in r["object"] or r["object"] in e for e in case["expected"])]
            structured = json.dumps({"context": ctx.package(g, case["question"], tokens, max_objects), "findings": [{k: t[k] for k in ("rule_id", "object", "message")} for t in touching]})
            rows += [(i, case["name"], "raw", raw, case["expected"], case.get("raw_steps", 2)), (i, case["name"], "structured", structured, case["expected"], 2)]
        table = self.spark.createDataFrame(rows, "n int, name string, mode string, text string, expected array<string>, steps int")
        measured = benchmark_measures(table)
        out = {"cases": [r.asDict() for r in measured.orderBy("n", "mode").collect()], "summary": benchmark_summary(measured).first().asDict()}
        found.unpersist()
        return out


def benchmark_measures(rows: DataFrame) -> DataFrame:
    """(n, name, mode, steps, tokens, recall, precision) of rows (n, name, mode, text, expected, steps)."""
    return rows.select("n", "name", "mode", "steps", S.estimate_tokens_by_chars(F.col("text")).alias("tokens"), S.recall(F.col("text"), F.col("expected")).alias("recall"), S.precision(F.col("text"), F.col("expected")).alias("precision"))


def benchmark_summary(measured: DataFrame) -> DataFrame:
    def of(mode: str, f, c: str):
        return f(F.when(F.col("mode") == mode, F.col(c)))

    sums = measured.agg(*[of(m, F.sum, c).alias(f"{m}_{c}") for m in ("raw", "structured") for c in ("tokens", "steps")], *[of(m, F.avg, c).alias(f"{m}_{c}") for m in ("raw", "structured") for c in ("recall", "precision")])
    saved = F.greatest(F.col("raw_tokens") - F.col("structured_tokens"), F.lit(0)) / F.greatest("raw_tokens", F.lit(1)) * 100
    return sums.withColumns({"token_reduction_percent": F.round(saved, 1), "recall_delta": F.col("structured_recall") - F.col("raw_recall"), "precision_delta": F.col("structured_precision") - F.col("raw_precision")})


def table_card(g: Graph, name: str, most: int = 50) -> dict:
    """A table with its parts, profile and edges; lists are cut at `most`, and say how many rows that left out."""
    table = traversal.resolved(g.objects, name, "table")
    own = F.col("schema_name").eqNullSafe(F.lit(table["schema_name"])) & (F.col("table_name") == F.lit(table["table_name"] or table["name"]))
    parts = g.objects.where(own & (F.col("id") != table["id"]))
    names = g.objects.select(F.col("id").alias("other"), "full_name")
    out_edges = g.edges.where(F.col("from_id") == table["id"]).join(names, F.col("to_id") == F.col("other"), "left").select("edge_ord", F.lit("outgoing").alias("direction"), "kind", F.coalesce("full_name", "to_id").alias("object"), "confidence", "evidence")
    in_edges = g.edges.where(F.col("to_id") == table["id"]).join(names, F.col("from_id") == F.col("other"), "left").select("edge_ord", F.lit("incoming").alias("direction"), "kind", F.coalesce("full_name", "from_id").alias("object"), "confidence", "evidence")
    lists = {
        "columns": parts.where("kind = 'column'").orderBy("obj_ord").select("id", "name", "column.data_type", "column.nullable", search.summary().alias("summary")),
        "constraints": parts.where("kind IN ('primary_key', 'foreign_key', 'unique_constraint', 'check_constraint')").orderBy("obj_ord").select("kind", "name", "constraint.columns", "constraint.referenced_table"),
        "indexes": parts.where("kind = 'index'").orderBy("obj_ord").select("name", "index.unique", "index.columns", "index.expression"),
        "edges": out_edges.unionByName(in_edges).orderBy("edge_ord").drop("edge_ord"),
    }
    rows = {k: [r.asDict(recursive=True) for r in v.collect()] for k, v in lists.items()}
    card = {"table": table["full_name"], "summary": table["comment"] or f"table {table['full_name']}"}
    stats = g.table_profiles.where(F.col("object_id") == table["id"]).first()
    card["profile"] = stats.asDict() if stats else None
    omitted = {}
    for k, v in rows.items():
        card[k] = v[:most]
        omitted[k] = max(0, len(v) - most)
    card["omitted"], card["truncated"] = omitted, any(omitted.values())
    return card


