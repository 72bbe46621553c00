"""Providers: what reads a catalog, and the registry that names them."""

from __future__ import annotations

import re
from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession

from catalens.model import CAPABILITIES, ConfigError, Graph
from catalens.operators.policy import Rule


class Provider(ABC):
    id = ""
    capabilities: dict[str, str] = dict.fromkeys(CAPABILITIES, "unknown")

    @abstractmethod
    def connect(self) -> dict:
        """What the source says of itself; raises ConfigError where it cannot be reached."""

    @abstractmethod
    def snapshot(self, spark: SparkSession) -> Graph:
        """The catalog as a graph, without samples."""

    def table(self, spark: SparkSession, schema: str, name: str) -> DataFrame:
        raise ConfigError(f"provider `{self.id}` has no row access")

    def sample(self, spark: SparkSession, schema: str, name: str, rule: Rule, most: int) -> DataFrame:
        from catalens.operators.policy import sample

        return sample(self.table(spark, schema, name), rule, most)


def redacted(url: str) -> str:
    """A connection URL without its password."""
    url = re.sub(r"(://[^:/@\s]+):[^@\s]*@", r"\1:***@", url)
    return re.sub(r"(?i)(password|pwd|token|secret)=[^&;\s]*", r"\1=***", url)


class Unsupported(Provider):
    """A provider that is named but not there: every call says so."""

    def __init__(self, id_: str):
        self.id = id_
        self.capabilities = dict.fromkeys(CAPABILITIES, "unsupported")

    def _refuse(self):
        raise ConfigError(f"provider `{self.id}` is not supported yet")

    def connect(self) -> dict:
        return self._refuse()

    def snapshot(self, spark: SparkSession) -> Graph:
        return self._refuse()


PROVIDERS = ("postgres", "mysql", "sql-server", "sqlite", "parquet", "spark")


def provider(id_: str, url: str | None = None, **options) -> Provider:
    """The provider of this name; none is made up."""
    if id_ == "sqlite":
        from catalens.sources.sqlite import SqliteProvider

        return SqliteProvider(url or "")
    if id_ == "postgres":
        from catalens.sources.postgres import PostgresProvider

        return PostgresProvider(url or "", **options)
    if id_ == "parquet":
        from catalens.sources.parquet import ParquetProvider

        return ParquetProvider(url or "", **options)
    if id_ == "spark":
        from catalens.sources.spark_catalog import SparkCatalogProvider

        return SparkCatalogProvider(**options)
    if id_ in ("mysql", "sql-server"):
        return Unsupported(id_)
    raise ConfigError(f"unknown provider `{id_}`; known: {', '.join(PROVIDERS)}")
