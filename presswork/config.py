"""Settings of a run: a file with sections, secrets from the environment, locales."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

SECTIONS = ("paths", "inputs", "search", "feeds", "classification", "fulltext", "topics")


@dataclass(frozen=True)
class Settings:
    """Sections of settings; a section that a file lacks is empty."""

    sections: dict[str, dict] = field(default_factory=dict)
    path: str = ""

    def get(self, section: str, name: str, default=None):
        return self.sections.get(section, {}).get(name, default)

    def secret(self, section: str, default_variable: str) -> str:
        """A secret from the environment variable that the section names, else from the section itself; never logged."""
        own = self.sections.get(section, {})
        variable = str(own.get("api_key_env", default_variable))
        value = os.environ.get(variable, "").strip() or str(own.get("api_key", "")).strip()
        if not value:
            raise ValueError(f"the environment has no {variable}, and section {section} no api_key")
        return value


def load_settings(path: str) -> Settings:
    """Settings from a JSON or YAML file."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        data = json.loads(text or "{}")
    else:
        import yaml

        data = yaml.safe_load(text) or {}
    return Settings({name: dict(data.get(name) or {}) for name in (*SECTIONS, *[k for k in data if k not in SECTIONS])}, path)


def locale_table(spark: SparkSession, locales: list[dict[str, str]]) -> DataFrame:
    """(id, lang, country, accept_language) of the locales of a run; an id twice or a missing field is an error."""
    fields = ("id", "lang", "country", "accept_language")
    rows = [tuple(str(x.get(f, "")).strip() for f in fields) for x in locales]
    if any("" in r for r in rows) or len({r[0] for r in rows}) < len(rows):
        raise ValueError("locales need an id of their own, lang, country and accept_language")
    return spark.createDataFrame(rows, ", ".join(f"{f} string" for f in fields))


def proxies(address: str, user: str = "", password: str = "") -> dict[str, str]:
    """Proxy addresses by scheme for an injected fetcher; none without an address."""
    if not address:
        return {}
    scheme, _, host = address.rpartition("://")
    login = f"{user}:{password}@" if user else ""
    return {k: f"{scheme or 'http'}://{login}{host}" for k in ("http", "https")}
