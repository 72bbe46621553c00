import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from catalens import testbed as T
from catalens.lineage import graph as lineage
from catalens.lineage.parse import parse


def refs(sql, dialect="postgres"):
    return [(r.kind, r.name, r.alias, r.resolved) for r in parse(sql, dialect).references]


def test_aliases_become_tables_and_projections_are_not_followed():
    assert refs("SELECT u.email, lower(u.name) FROM users u WHERE u.id = 1") == [("reads_from", "users", "u", True), ("filters_by", "users.id", "u", True)]


def test_joins_using_and_on():
    found = refs("SELECT 1 FROM a JOIN b USING (k, l) LEFT JOIN c ON c.x = a.y CROSS JOIN d")
    assert [f[:2] for f in found] == [("reads_from", "a"), ("joins_on", "b"), ("joins_on", "k"), ("joins_on", "l"), ("joins_on", "c"), ("joins_on", "c.x"), ("joins_on", "a.y"), ("joins_on", "d")]


def test_expression_forms_that_are_left_out():
    sql = "SELECT 1 FROM t WHERE a LIKE 'x%' AND lower(b) = 'y' AND c IN (SELECT d FROM u) AND e IN (1, f) AND g BETWEEN h AND 3 AND i IS NULL AND NOT j AND (CASE WHEN k THEN 1 END) = l AND m::int > 2 AND EXISTS (SELECT n FROM v)"
    assert [f[1] for f in refs(sql) if f[0] == "filters_by"] == ["e", "f", "g", "h", "i", "j", "l"]


def test_writes():
    assert [f[:2] for f in refs("INSERT INTO s.t (a, b) VALUES (1, 2) ON CONFLICT (a) DO NOTHING RETURNING a")] == [("writes_to", "s.t")]
    assert [f[:2] for f in refs("UPDATE t SET a = b WHERE c = 1")] == [("writes_to", "t"), ("filters_by", "c")]
    assert [f[:2] for f in refs("DELETE FROM t USING u WHERE t.id = u.id")][:2] == [("writes_to", "t"), ("reads_from", "u")]


def test_common_tables_and_set_operations():
    found = refs("WITH x AS (SELECT * FROM a), y AS (SELECT * FROM x) SELECT * FROM y UNION ALL SELECT * FROM b ORDER BY 1")
    assert found == [("depends_on", "x", None, True), ("reads_from", "a", None, True), ("depends_on", "y", None, True), ("reads_from", "x", None, False), ("reads_from", "y", None, False), ("reads_from", "b", None, True)]


@pytest.mark.parametrize("sql", ["select from", "", "SELECT a FROM", "SELECT a FROM t WHERE", "SELECT 'open", "FROM t", "SELECT (1 FROM t", "UPDATE t WHERE x = 1"])
def test_failures_keep_the_text(sql):
    got = parse(sql)
    assert got.status == "failed" and len(got.diagnostics) == 1 and got.normalized == " ".join(sql.split()) and not got.references


@pytest.mark.parametrize("sql", ["CREATE TABLE t (a bigserial)", "TRUNCATE t", "MERGE INTO a USING b ON a.x = b.x WHEN MATCHED THEN DELETE", "COMMENT ON COLUMN t.a IS 'x'"])
def test_other_statements_refer_to_nothing(sql):
    got = parse(sql)
    assert got.status == "parsed" and [k for k, _ in got.statements] == ["other"] and not got.references


def test_one_fingerprint_for_one_statement():
    a = parse("select  a from T -- note\n where b=1;")
    assert a.fingerprint == parse("SELECT a FROM T WHERE b = 1").fingerprint != parse("SELECT a FROM t WHERE b = 1").fingerprint


def test_dialects_differ_in_quotes():
    assert parse("SELECT 1 FROM `t`", "postgres").status == "failed" and parse("SELECT 1 FROM `t`", "mysql").references[0].name == "t"


@given(st.text(alphabet="SELECTFROMWHEREselctfromwa ,.()='\"`1;*$-/", max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text_is_parsed_or_refused(sql):
    assert parse(sql).status in ("parsed", "failed")


def test_enrichment_resolves_and_orders(spark):
    g, artifacts = lineage.enrich(T.shop(spark), T.shop_files(spark))
    edges = {(r["kind"], r["to_id"]): r for r in g.edges.collect()}
    assert edges["filters_by", "column:public.orders.status"]["confidence"] == 0.9
    assert edges["filters_by", "id"]["unresolved"] and edges["filters_by", "id"]["confidence"] == 0.45
    assert {r["status"] for r in artifacts.collect()} == {"parsed", "failed"}
    assert g.objects.where("kind = 'query'").count() == 4


def test_equal_texts_are_one_object(spark):
    files = spark.createDataFrame([("a.sql", "SELECT 1 FROM orders"), ("b.sql", "select 1 from orders;")], "source_path string, content string")
    g, artifacts = lineage.enrich(T.shop(spark), files)
    assert g.objects.where("kind = 'query'").count() == 1 and artifacts.first()["source_path"] == "b.sql"


def test_validation_suggests(spark):
    got = lineage.validate(T.shop(spark), "SELECT 1 FROM order o WHERE o.statu = 1")
    assert got["parse_ok"] and not got["valid"] and not got["executed"]
    assert {u["name"]: u["suggestions"] for u in got["unresolved"]}["order.statu"] == ["public.orders.status"]
    assert lineage.validate(T.shop(spark), "SELECT 1 FROM orders WHERE status = 'x'")["valid"]
