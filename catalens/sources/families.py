"""Families of data types, by the rules of each kind of source."""

from __future__ import annotations

# Type names by family, and the first that a SQLite type's name contains decides.
POSTGRES = {
    "numeric": ("smallint", "integer", "bigint", "decimal", "numeric", "real", "double precision", "smallserial", "serial", "bigserial", "money", "int2", "int4", "int8", "float4", "float8"),
    "string": ("character varying", "varchar", "character", "char", "text", "name", "citext", "bpchar"),
    "boolean": ("boolean", "bool"),
    "datetime": ("date", "time", "timestamp", "timestamptz", "interval", "timestamp without time zone", "timestamp with time zone", "time without time zone", "time with time zone"),
}
SQLITE = (("integer", ("INT",)), ("text", ("CHAR", "CLOB", "TEXT")), ("binary", ("BLOB",)), ("float", ("REAL", "FLOA", "DOUB")), ("numeric", ("NUM", "DEC", "BOOL")))
SPARK = {
    "numeric": ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"),
    "string": ("string", "char", "varchar"),
    "boolean": ("boolean",),
    "datetime": ("date", "timestamp", "timestamp_ntz", "interval"),
    "array": ("array",),
}


def sqlite_family(data_type: str | None) -> str:
    name = (data_type or "").upper()
    return next((family for family, parts in SQLITE if any(p in name for p in parts)), "other")


def spark_family(data_type: str) -> str:
    name = data_type.lower().split("(")[0].split("<")[0].split(" ")[0]
    return next((family for family, names in SPARK.items() if name in names), "other")


def postgres_family(data_type: str) -> str:
    name = data_type.lower()
    if name.endswith("[]"):
        return "array"
    name = name.split("(")[0].strip()
    return next((family for family, names in POSTGRES.items() if name in names), "other")
