"""A project: its directory, configuration, annotations and store."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field
from pathlib import Path

from catalens.functions.scalars import PII_TERMS
from catalens.model import ConfigError
from catalens.operators.policy import Rule, check_rule
from catalens.operators.profile import check_options
from catalens.sources.base import PROVIDERS

STATE_DIR, CONFIG, SEMANTICS, SUPPRESSIONS = ".catalens", "config.json", "semantics.json", "suppressions.json"


@dataclass
class Config:
    version: int = 1
    provider: str = "sqlite"
    connection_env: str | None = None
    connection: str | None = None
    sql_include: list[str] = field(default_factory=lambda: ["migrations/**", "sql/**", "db/**"])
    sql_exclude: list[str] = field(default_factory=list)
    profiling_mode: str = "stats"
    max_rows_per_table: int = 100
    store_raw_samples: bool = False
    mask_pii: bool = True
    custom_sensitive_terms: list[str] = field(default_factory=list)
    data_access: list[dict] = field(default_factory=list)
    max_response_chars: int = 20_000

    def rules(self) -> list[Rule]:
        return [Rule(r["table"], r.get("mode", "schema"), tuple(r.get("columns", ())), r.get("where"), r.get("limit"), tuple(r.get("order", ())), bool(r.get("storeRaw", False))) for r in self.data_access]

    def terms(self) -> tuple[str, ...]:
        return tuple(sorted({*PII_TERMS, *(t.lower() for t in self.custom_sensitive_terms)}))

    def check(self) -> Config:
        if self.version < 1:
            raise ConfigError("version must be above 0")
        if self.provider not in PROVIDERS:
            raise ConfigError(f"unknown provider `{self.provider}`; known: {', '.join(PROVIDERS)}")
        if not (self.connection_env or self.connection or self.provider == "spark"):
            raise ConfigError("a connection is needed: connection_env names a variable, connection holds it")
        check_options(self.profiling_mode, self.max_rows_per_table, self.store_raw_samples)
        if self.max_response_chars <= 0:
            raise ConfigError("max_response_chars must be above 0")
        for r in self.rules():
            check_rule(r, self.profiling_mode, self.max_rows_per_table)
        return self

    def url(self) -> str:
        found = os.environ.get(self.connection_env or "") or self.connection
        if not found and self.provider != "spark":
            raise ConfigError(f"set the variable {self.connection_env} to the connection")
        return found or ""


class Project:
    def __init__(self, root: str | Path):
        self.root = Path(root).resolve()

    @property
    def state(self) -> Path:
        return self.root / STATE_DIR

    @property
    def warehouse(self) -> str:
        return str(self.state / "warehouse")

    @classmethod
    def find(cls, start: str | Path = ".") -> Project:
        """The project of the nearest directory above that has a state directory."""
        at = Path(start).resolve()
        for place in (at, *at.parents):
            if (place / STATE_DIR).is_dir():
                return cls(place)
        raise ConfigError(f"no {STATE_DIR} directory in {at} or above; run init first")

    @classmethod
    def init(cls, root: str | Path, config: Config | None = None, force: bool = False) -> Project:
        project = cls(root)
        path = project.state / CONFIG
        if path.exists() and not force:
            raise ConfigError(f"{path} exists; use force to replace it")
        project.state.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(asdict(config or Config(connection_env="CATALENS_DATABASE_URL")), indent=2) + "\n")
        return project

    def config(self) -> Config:
        path = self.state / CONFIG
        try:
            found = json.loads(path.read_text())
        except FileNotFoundError:
            raise ConfigError(f"{path} is missing; run init first") from None
        except ValueError as e:
            raise ConfigError(f"{path}: {e}") from e
        unknown = set(found) - set(Config.__dataclass_fields__)
        if unknown:
            raise ConfigError(f"{path}: unknown settings {', '.join(sorted(unknown))}")
        return Config(**found)

    @property
    def semantics(self) -> Path:
        return self.state / SEMANTICS

    @property
    def suppressions(self) -> Path:
        return self.state / SUPPRESSIONS
