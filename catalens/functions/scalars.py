"""Scalar functions of the engine as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What makes a column's name, type or comment look personal, each worth the same.
PII_TERMS = (
    "address", "card_number", "credit_card", "email", "iban", "id_card", "mobile", "passport", "passwd", "password", "phone", "secret",
    "social_security", "ssn", "token",
)
PII_TERM_SCORE, PII_TEXT_SCORE, PII_ID_MOST, SENSITIVE_FROM = 0.45, 0.05, 0.2, 0.4
TEXT_TYPES = ("varchar", "text", "char", "string")

# Words that do not tell searches apart, and SQL words that are no identifiers.
STOP_WORDS = ("the", "and", "for", "with", "from", "this", "that", "show", "give", "about")
SQL_WORDS = (
    "select", "from", "where", "join", "inner", "left", "right", "outer", "full", "on", "and", "or", "as", "group", "by", "order", "desc",
    "asc", "update", "insert", "delete", "set", "into", "values", "with",
)

NUMERIC = r"^[+-]?(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"
LETTERS_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
SHAPES = "A" * 26 + "a" * 26 + "9" * 10


def compact_whitespace(value: Column) -> Column:
    return F.btrim(F.regexp_replace(value, r"(?U)\s+", " "))


def fingerprint(value: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the UTF-8 text."""
    return F.sha2(value, 256)


def trim_identifier(value: Column) -> Column:
    for marks in (" \t\r\n", '"', "`", "'"):
        value = F.btrim(value, F.lit(marks))
    return value


def identifier_tokens(value: Column) -> Column:
    """Identifiers in a piece of SQL: no numbers, no SQL words."""
    parts = F.split(value, "[^A-Za-z0-9_.]+")
    return F.filter(parts, lambda t: (t != "") & ~F.lower(t).rlike(NUMERIC) & ~F.lower(t).isin(*SQL_WORDS))


def format_shape(value: Column) -> Column:
    """Digits as 9, ASCII letters as A and a, all else as it is."""
    return F.translate(value, LETTERS_DIGITS, SHAPES)


def numeric_value(value: Column) -> Column:
    """The number that a text stands for, else null. Engines differ in what they cast, so the form is checked first."""
    return F.when(value.cast("string").rlike(NUMERIC), value.cast("string").try_cast("double"))


def infer_shape(non_null: Column, distinct: Column, all_numeric: Column, all_text: Column, temporal: bool = False) -> Column:
    if temporal:
        return F.when(non_null > 0, F.lit("timestamp"))
    return F.when(non_null == 0, F.lit(None).cast("string")).when(all_numeric, "numeric").when(all_text & (distinct <= 10), "enum_like").when(all_text, "text").otherwise("mixed")


def mask_value(value: Column, strategy: str = "redact") -> Column:
    if strategy == "mask":
        return F.when(value == "", "").otherwise(F.repeat(F.lit("*"), F.least(F.greatest(F.length(value), F.lit(4)), F.lit(12))))
    if strategy == "hash":
        return F.concat(F.lit("sha256:"), F.substring(fingerprint(value), 1, 16))
    if strategy == "redact":
        return F.when(value.isNotNull(), F.lit("[REDACTED]"))
    raise ValueError(f"unknown masking strategy: {strategy}")


def pii_reasons(haystack: Column, terms: tuple[str, ...] = PII_TERMS) -> Column:
    known = F.array(*[F.lit(t) for t in sorted({t.lower() for t in terms})])
    return F.transform(F.filter(known, lambda t: F.contains(haystack, t)), lambda t: F.concat(F.lit("term:"), t))


def pii_score(haystack: Column, column_name: Column, terms: tuple[str, ...] = PII_TERMS) -> Column:
    """0 to 1: how much a column's lower-cased description looks personal."""
    texts = F.lit(False)
    for t in TEXT_TYPES:
        texts = texts | F.contains(haystack, F.lit(t))
    score = PII_TERM_SCORE * F.size(pii_reasons(haystack, terms)) + F.when(texts, PII_TEXT_SCORE).otherwise(0.0)
    score = F.when(F.lower(column_name) == "id", F.least(score, F.lit(PII_ID_MOST))).otherwise(score)
    return F.least(score, F.lit(1.0))


def extract_search_terms(query: Column) -> Column:
    """Distinct lower-cased terms of three letters or more, each plural also without its s."""
    words = F.filter(F.split(F.lower(F.regexp_replace(query, "[^A-Za-z0-9]+", " ")), " +"), lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS))
    singular = F.transform(F.filter(words, lambda w: w.endswith("s") & (F.length(w) >= 4)), lambda w: F.substring(w, F.lit(1), F.length(w) - 1))
    return F.array_sort(F.array_distinct(F.concat(words, singular)))


def estimate_tokens(text: Column) -> Column:
    """Words, or a fourth of the bytes if that is more."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    return F.greatest(F.size(words), F.floor(F.octet_length(text) / 4).cast("int")).cast("bigint")


def estimate_tokens_by_chars(text: Column) -> Column:
    return F.greatest(F.ceil(F.length(text) / 4), F.lit(1)).cast("bigint")


def edit_distance(left: Column, right: Column, most: int | None = None) -> Column:
    """Levenshtein distance; with most, -1 beyond it."""
    return F.levenshtein(left, right) if most is None else F.levenshtein(left, right, most)


def normalize_name(value: Column) -> Column:
    return F.lower(F.btrim(F.substring_index(value, ".", -1), F.lit("\"`' ")))


def pluralize(value: Column) -> Column:
    return F.when(value.endswith("s"), value).when(value.endswith("y"), F.concat(F.regexp_replace(value, "y+$", ""), F.lit("ies"))).otherwise(F.concat(value, F.lit("s")))


def singularize(value: Column) -> Column:
    return F.when(value.endswith("ies"), F.regexp_replace(value, "ies$", "y")).otherwise(F.regexp_replace(value, "s+$", ""))


def target_table_hint(column_name: Column) -> Column:
    """The table that a column's name points to, else null."""
    name = F.lower(column_name)
    stem = F.regexp_replace(name, "_id$", "")
    return (
        F.when(name == "tenant_id", "tenants")
        .when(name == "entity_id", "entities")
        .when(name.isin("created_by", "updated_by"), "users")
        .when(name.endswith("_id") & (stem != ""), pluralize(stem))
    )


def inference_confidence(column_name: Column) -> Column:
    name = F.lower(column_name)
    return F.when(name.isin("tenant_id", "created_by", "updated_by"), 0.9).when(name == "entity_id", 0.72).otherwise(0.82)


def is_local_identifier(column_name: Column, table_name: Column) -> Column:
    """Whether <p>_id names its own table's rows: the table's last word and p have one singular."""
    name = F.lower(column_name)
    return name.endswith("_id") & (singularize(F.substring_index(F.lower(F.coalesce(table_name, F.lit(""))), "_", -1)) == singularize(F.regexp_replace(name, "_id$", "")))


def statement_has_where(sql: Column, keyword: str) -> Column:
    """Whether every statement that begins with keyword has a WHERE."""
    statements = F.transform(F.split(F.upper(sql), ";"), lambda s: F.btrim(s))
    return F.forall(F.filter(statements, lambda s: s.startswith(keyword + " ")), lambda s: F.contains(s, F.lit(" WHERE ")))


def preview(sql: Column) -> Column:
    return F.substring(sql, 1, 160)


def table_column_key(schema: Column, table: Column, column: Column) -> Column:
    """schema.table.column; what is missing is left out but for the column's table."""
    return F.concat_ws(".", schema, F.coalesce(table, F.lit("")), column)


def finding_fingerprint(rule_id: Column, obj: Column, related: Column) -> Column:
    return F.concat_ws("|", rule_id, obj, F.array_join(F.array_sort(F.array_distinct(related)), ","))


IMPORTANT = ("status", "state", "type", "kind", "email")


def is_important(column_name: Column) -> Column:
    return F.lower(column_name).isin(*IMPORTANT)


def is_never_negative(column_name: Column) -> Column:
    return F.lower(column_name).rlike("amount|price|quantity|total|balance|count")


def is_format_sensitive(column_name: Column) -> Column:
    return F.lower(column_name).rlike("_id$|code|sku|email|url|uuid|slug")


def is_expired(date: Column, today: Column | None = None) -> Column:
    """Whether a YYYY-MM-DD text lies before today; other texts never expire."""
    return F.coalesce(F.try_to_date(date, "yyyy-MM-dd") < (F.current_date() if today is None else today), F.lit(False))


def recall(context: Column, expected: Column) -> Column:
    matched = F.size(F.filter(expected, lambda e: F.contains(context, e)))
    return F.when(F.size(expected) == 0, 0.0).otherwise(matched / F.greatest(F.size(expected), F.lit(1)))


def precision(context: Column, expected: Column, marker: str = "public.") -> Column:
    """Expected names found, for all names that the context mentions."""
    matched = F.size(F.filter(expected, lambda e: F.contains(context, e)))
    mentions = F.size(F.split(context, marker.replace(".", "\\."))) - 1
    return F.when((matched == 0) & (mentions == 0), 0.0).otherwise(matched / F.greatest(mentions, matched, F.lit(1)))


def quote_identifier(value: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))


def quote_literal(value: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))


def is_system_schema(schema: Column) -> Column:
    return (schema == "information_schema") | schema.startswith("pg_")
