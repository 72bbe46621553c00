from collections import deque

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from catalens import testbed as T
from catalens.functions import scalars as S
from catalens.lineage import graph as lineage
from catalens.model import ConfigError, graph
from catalens.operators import context, diff, hashing, inference, policy, profile, report, rules, search, semantics, traversal, workload
from catalens.sources.synthetic import synthetic


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scalars(spark):
    L = F.lit
    assert value(spark, S.compact_whitespace(L(" a \n\t b "))) == "a b"
    assert value(spark, S.format_shape(L("Ab-9é"))) == "Aa-9é"
    assert [value(spark, S.numeric_value(L(x))) for x in ("1.5", "-2e3", ".5", " 1", "1d", "x", "")] == [1.5, -2000.0, 0.5, None, None, None, None]
    assert [value(spark, S.mask_value(L(x), "mask")) for x in ("", "ab", "a" * 40)] == ["", "****", "*" * 12]
    assert value(spark, S.mask_value(L("a"), "hash")).startswith("sha256:ca978112")
    assert [value(spark, S.pluralize(L(x))) for x in ("city", "bus", "user")] == ["cities", "bus", "users"]
    assert [value(spark, S.singularize(L(x))) for x in ("cities", "address", "users")] == ["city", "addre", "user"]
    assert value(spark, S.extract_search_terms(L("Show the payment_events for users"))) == ["event", "events", "payment", "user", "users"]
    assert value(spark, S.estimate_tokens(L("a b c"))) == 3 and value(spark, S.estimate_tokens(L("a" * 40))) == 10
    assert value(spark, S.estimate_tokens_by_chars(L(""))) == 1
    assert value(spark, S.identifier_tokens(L("a.b = 12 and c"))) == ["a.b", "c"]
    assert value(spark, S.trim_identifier(L(' "x" '))) == "x"
    assert value(spark, S.statement_has_where(L("UPDATE a SET b WHERE c; UPDATE d SET e"), "UPDATE")) is False
    assert value(spark, S.is_local_identifier(L("event_id"), L("audit_events"))) is True
    assert [value(spark, S.is_expired(L(d), F.to_date(L("2024-06-01")))) for d in ("2024-05-31", "2024-06-01", "soon")] == [True, False, False]
    assert value(spark, S.precision(L("public.a public.b"), F.array(L("public.a")))) == 0.5


def test_masking_refuses_unknown_strategies():
    with pytest.raises(ValueError):
        S.mask_value(None, "rot13")


def walk(edges, objects, start, direction):
    """All paths of up to two edges, by a queue."""
    order = sorted(edges, key=lambda e: e["edge_ord"])

    def near(at):
        for e in order:
            if direction != "incoming" and e["from_id"] == at and e["to_id"] in objects:
                yield e["to_id"], e["kind"]
            if direction != "outgoing" and e["to_id"] == at and e["from_id"] in objects and (direction == "incoming" or e["from_id"] != e["to_id"]):
                yield e["from_id"], e["kind"]

    paths, seen, queue = [], {start}, deque([(start, [objects[start]], [])])
    while queue:
        at, path, kinds = queue.popleft()
        if len(kinds) == 2:
            continue
        for other, kind in near(at):
            step = ([*path, objects[other]], [*kinds, kind])
            paths.append((tuple(step[0]), tuple(step[1])))
            if other not in seen:
                seen.add(other)
                queue.append((other, *step))
    return sorted(paths)


@pytest.mark.parametrize("direction", traversal.DIRECTIONS)
def test_relation_paths_equal_a_queue(spark, direction):
    g, _ = lineage.enrich(T.shop(spark), T.shop_files(spark))
    edges, objects = [r.asDict() for r in g.edges.collect()], {r["id"]: r["full_name"] for r in g.objects.collect()}
    for start in ("table:public.orders", "column:public.orders.status"):
        got = traversal.relation_paths(g, g.objects.where(F.col("id") == start), 2, direction).collect()
        assert sorted((tuple(r["path"]), tuple(r["kinds"])) for r in got) == walk(edges, objects, start, direction)


def test_impact(spark):
    g, _ = lineage.enrich(T.shop(spark), T.shop_files(spark))
    items = {(r["scope"], r["full_name"].split(":")[0]) for r in traversal.impact(g, "orders.status").collect()}
    assert ("direct", "public.orders") in items and ("direct", "sql.sql/orders.sql") in items and ("indirect", "public.customers") in items
    assert not any(name == "public.orders.status" for _, name in items)
    assert "public.orders" not in {r["full_name"] for r in traversal.impact(g, "orders").collect()}
    assert [r["message"] for r in traversal.impact_risks(g, "public.orders.status").collect()] == ["Statements that branch on this state may take other paths: check the values they compare"]
    with pytest.raises(ConfigError):
        traversal.impact(g, "nothing")


def test_search_and_context(spark):
    g = T.shop(spark)
    assert search.parse_query('kind:table name:"payment events" schema:Public refund') == search.Query("refund", ("table",), ("public",), ("payment events",))
    assert [r["full_name"] for r in search.search(g.objects, "kind:table payment").collect()] == ["public.payments"]
    best = search.search(g.objects, "orders").first()
    assert best["full_name"] == "public.orders" and best["score"] == 50 + 10 + 25 + 10 + 12
    package = context.package(g, "orders status", 80)
    assert package["estimatedTokens"] <= 80 and package["objects"][0]["full_name"].startswith("public.orders")
    assert context.package(g, "zzz", 80)["objects"] == []
    index = search.token_index(g.objects)
    assert {r["full_name"] for r in search.lookup(index, g.objects, "orders status").collect()} == {"public.orders.status"}


@given(st.lists(st.integers(0, 30), max_size=12), st.integers(0, 60), st.integers(0, 8))
@settings(max_examples=15, deadline=None)
def test_budget_is_the_greedy_prefix(spark, costs, budget, most):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(costs)], "i int, cost int")
    kept, spent = [], 0
    for i, c in enumerate(costs):
        if len(kept) >= most or spent + c > budget:
            break
        kept.append(i)
        spent += c
    assert sorted(r["i"] for r in context.within_budget(rows, ["i"], "cost", budget, most).collect()) == kept


def test_workload_counts_a_statement_once(spark):
    objects = [{"id": q, "kind": "query", "full_name": q, "metadata": {"fingerprint": "same"}} for q in ("q1", "q2")] + [{"id": "t", "kind": "table", "full_name": "t"}]
    g = graph(spark, objects, [{"kind": "reads_from", "from_id": q, "to_id": "t"} for q in ("q1", "q2")])
    assert workload.counters(workload.query_uses(g)).first()["frequency"] == 1
    assert workload.unique_fingerprints(g).first()[0] == 1


def test_inference(spark):
    g = T.shop(spark)
    assert [(r["from_id"], r["to_id"]) for r in inference.infer(g).collect()] == [("column:public.orders.customer_id", "column:public.customers.id")]
    assert inference.infer(g, ("public.orders.customer_id",)).count() == 0
    assert inference.with_inferred(g).edges.count() == g.edges.count() + 1


def test_diff(spark):
    def t(name, kind="table", column=None, **more):
        return {"id": f"{kind}:{name}", "kind": kind, "full_name": name, "schema_name": "public", **({"column": column, "column_name": name.rsplit(".", 1)[-1], "table_name": "orders"} if column else {}), **more}

    before = graph(spark, [t("public.users"), t("public.orders"), t("public.people"), t("public.orders.status", "column", ("text", "string", True, None, None))])
    now = graph(spark, [t("public.users"), t("public.payments"), t("public.customers"), t("public.orders.status", "column", ("varchar", "string", False, "'new'", None))])
    got = [(r["change"], r["full_name"], r["details"]) for r in diff.changes(before.objects, now.objects).collect()]
    assert got == [
        ("added", "public.customers", []), ("added", "public.payments", []), ("removed", "public.orders", []), ("removed", "public.people", []),
        ("changed", "public.orders.status", ["column type changed", "column nullability changed", "column default changed"]),
    ]
    pairs = {(r["from_full_name"], r["to_full_name"]) for r in diff.rename_candidates(before.objects, now.objects).collect()}
    assert ("public.people", "public.customers") in pairs and len(pairs) == 4
    assert diff.changes(now.objects, now.objects).count() == 0


def test_hashes_ignore_order_and_time_but_not_content(spark):
    g = T.shop(spark)
    mixed = g.with_(objects=g.objects.orderBy(F.desc("id")), created_at_ms=5)
    assert hashing.content_hash(mixed) == hashing.content_hash(g)
    grown = g.with_(table_profiles=g.table_profiles.withColumn("row_estimate", F.col("row_estimate") + 1))
    assert hashing.content_hash(grown) != hashing.content_hash(g) and hashing.schema_hash(grown) == hashing.schema_hash(g)


def test_profile_and_summary(spark):
    rows = spark.createDataFrame([(1, "open"), (2, "paid"), (3, "paid"), (4, None)], "o int, s string")
    p = profile.profile(rows, ["s"]).first()
    assert (p["non_null"], p["nulls"], p["n_distinct"], p["shape"], p["shapes"]) == (3, 1, 2, "enum_like", ["aaaa"])
    s = profile.summarize(rows, "s", "o", store_raw=True).first()["summary"]
    assert s["examples"] == ["open", "paid"] and not s["sensitive"]
    assert profile.summarize(rows, "s", "o", sensitive=True, store_raw=True).first()["summary"]["examples"] == ["[REDACTED]"] * 2
    assert profile.summarize(rows.limit(0), "s", "o").first()["summary"]["inferred_shape"] is None


def test_policy():
    assert policy.pattern_matches("public.*", "public.a") and policy.pattern_matches("*", "x") and not policy.pattern_matches("a*b*", "a-b-c")
    for bad in ("a; b", "x\nDELETE\tfrom y", "id in (select 1)"):
        with pytest.raises(ConfigError):
            policy.check_where(bad)
    policy.check_where("created_at > '2024-01-01' and updated = 1")
    with pytest.raises(ConfigError):
        policy.check_rule(policy.Rule("t", "sample"), "sample", 10)
    assert policy.jdbc_query("s", "t", policy.Rule("t", "sample", ("a",), "b > 1", 3), 10) == 'SELECT ("a")::text AS "a" FROM "s"."t" WHERE b > 1 LIMIT 3'


def test_semantics_and_deprecation(spark):
    g = semantics.annotate(T.shop(spark), [{"object": "status", "description": "x"}, {"object": "public.orders.status", "deprecated": True, "description": "old"}])
    row = g.objects.where("full_name = 'public.orders.status'").first()
    assert row["deprecated"] and row["semantic_description"] == "old"
    g, _ = lineage.enrich(g, T.shop_files(spark))
    assert [r["object"] for r in rules.analyze(g, "quality").where("rule_id = 'quality.deprecated_object_used'").collect()] == ["public.orders.status"]


def test_report_gate_and_rendering(spark):
    g, _ = lineage.enrich(T.shop(spark), T.shop_files(spark))
    found = rules.analyze(profile.with_privacy(g))
    told = [{"ruleId": "risk.select_star", "object": found.where("rule_id = 'risk.select_star'").first()["object"], "reason": "r", "owner": "o"}]
    rep = report.report(found, suppressions=told, fail_on="high", baseline=found.where("severity = 'high'"), fail_on_new="high")
    assert rep["gate"] == {"failed": True, "failing": 4, "newFailing": 0, "failOn": "high", "failOnNew": "high"}
    assert rep["riskScore"] == 65 and rep["summary"] == "Findings open after suppression: 9; risk score: 65."
    assert sum(s["n"] for s in rep["sections"]) == 9 and len(rep["suppressedFindings"]) == 1
    assert "Gate: failed" in report.render(rep) and report.render(rep, "markdown").startswith("# Catalog analysis")
    assert report.report(found.limit(0))["summary"] == "Findings in all: none."


def test_data_rules(spark):
    def column(name, summary):
        full = f"public.orders.{name}"
        return {"id": f"column:{full}", "kind": "column", "full_name": full, "schema_name": "public", "table_name": "orders", "column_name": name}, {"object_id": f"column:{full}", "summary": summary}

    made = [
        column("status", (4, 6, False, [], 3, "enum_like", None, None, ["aaaa"], "sample")), column("total_amount", (5, 0, False, [], 5, "numeric", -1.0, 9.0, ["9"], "sample")),
        column("sku", (5, 0, False, [], 5, "text", None, None, ["A9", "99"], "sample")), column("kind", (5, 0, False, [], 2, "enum_like", None, None, ["a"], "sample")),
    ]
    check = {"id": "c", "kind": "check_constraint", "full_name": "public.orders.kind_check", "schema_name": "public", "table_name": "orders", "constraint": (["kind"], None, [])}
    g = graph(spark, [m[0] for m in made] + [check], column_profiles=[m[1] for m in made])
    got = {(r["rule_id"], r["object"]) for r in rules.analyze(g, "quality").collect() if r["rule_id"].startswith("data.")}
    assert got == {("data.enum_like_without_constraint", "public.orders.status"), ("data.high_null_rate", "public.orders.status"), ("data.negative_numeric_sample", "public.orders.total_amount"), ("data.unstable_format_sample", "public.orders.sku")}


@pytest.mark.parametrize("tables,columns", [(3, 2), (5, 0), (0, 3)])
def test_synthetic(spark, tables, columns):
    g = synthetic(spark, tables, columns)
    assert g.objects.count() == tables * (columns + 1) and g.edges.count() == tables * columns


def test_a_sample_statement_keeps_its_order():
    rule = policy.Rule(table="orders", columns=("id", "status"), where="id > 3", limit=5, order=("status", "id"))
    assert policy.jdbc_query("public", "orders", rule, 10, as_text=False) == 'SELECT "id", "status" FROM "public"."orders" WHERE id > 3 ORDER BY "status", "id" LIMIT 5'


def test_constraints_cover_tables_by_whole_words(spark):
    rows = spark.createDataFrame([("public.orders_status_check",), ("public.reorders",), (None,)], "n string")
    got = [r[0] for r in rows.select(rules._runs(F.col("n"))).collect()]
    assert {"orders", "orders_status", "status", "public"} <= set(got[0]) and "orders" not in got[1] and not got[2]


def test_profiles_of_many_shapes_stay_bounded(spark):
    rows = spark.range(400).select(F.concat(F.lit("x" * 3), F.repeat(F.lit("-"), F.col("id").cast("int"))).alias("t"), F.col("id"))
    got = {r["column_name"]: r for r in profile.profile(rows).collect()}
    assert (got["t"]["n_distinct"], got["t"]["n_shapes"], len(got["t"]["shapes"])) == (400, 400, profile.DISTINCT_SHAPES)
    assert (got["id"]["numeric_max"], got["id"]["n_shapes"], got["id"]["shapes"]) == (399.0, 0, [])
