"""Locations of tables from a catalog with an HTTP statement interface, and their renewal while a pipeline runs."""

from __future__ import annotations

import base64
import dataclasses
import json
import logging
import os
import re
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from ..errors import ConfigError, LogError

log = logging.getLogger(__name__)

PAGES = 10_000


@dataclass(frozen=True)
class Connection:
    url: str
    user: str
    password: str | None = None
    catalog: str | None = None
    schema: str | None = None
    timeout: float = 30.0


def query(connection: Connection, sql: str) -> list[list]:
    """All rows: the statement is posted, and the answer's nextUri followed to its end."""
    headers = {"X-Trino-User": connection.user, "Content-Type": "text/plain"}
    if connection.catalog:
        headers["X-Trino-Catalog"] = connection.catalog
    if connection.schema:
        headers["X-Trino-Schema"] = connection.schema
    if connection.password:
        headers["Authorization"] = "Basic " + base64.b64encode(f"{connection.user}:{connection.password}".encode()).decode()
    request = urllib.request.Request(f"{connection.url.rstrip('/')}/v1/statement", sql.encode(), headers, method="POST")
    rows: list[list] = []
    for _ in range(PAGES):
        try:
            with urllib.request.urlopen(request, timeout=connection.timeout) as answer:
                page = json.load(answer)
        except (OSError, ValueError) as e:
            raise LogError(f"the catalog at {connection.url} doesn't answer: {e}") from None
        if page.get("error"):
            raise LogError(f"the catalog refuses: {page['error'].get('message')}")
        rows += page.get("data") or []
        if not page.get("nextUri"):
            return rows
        request = urllib.request.Request(page["nextUri"], headers=headers)
    raise LogError(f"the catalog's answer has more than {PAGES} pages")


def quote(relation: str) -> str:
    return ".".join('"' + p.strip('"').replace('"', '""') + '"' for p in re.findall(r'"[^"]*"|[^.]+', relation))


def location(connection: Connection, relation: str) -> str:
    """Where a table is, from its SHOW CREATE TABLE."""
    rows = query(connection, f"SHOW CREATE TABLE {quote(relation)}")
    text = "\n".join(str(r[0]) for r in rows)
    m = re.search(r"\blocation\s*=\s*'((?:[^']|'')*)'", text, re.IGNORECASE)
    if not m:
        raise LogError(f"the catalog names no location for {relation}")
    return m.group(1).replace("''", "'")


def delta_catalogs(connection: Connection) -> list[str]:
    """Catalogs of the connector for such tables."""
    return sorted(r[0] for r in query(connection, "SELECT catalog_name FROM system.metadata.catalogs WHERE connector_name = 'delta_lake'"))


def locator(connection: Connection) -> Callable[[str], str]:
    return lambda relation: location(connection, relation)


class Located:
    """Settings whose relations are looked up again before each poll; if the catalog is silent, the last known place holds."""

    def __init__(self, find: Callable[[str], str]):
        self.find = find
        self.last: dict[str, str] = {}

    def place(self, relation: str | None, otherwise: str) -> str:
        if not relation:
            return otherwise
        try:
            self.last[relation] = self.find(relation)
        except LogError as e:
            log.warning("%s: %s; going on with the last known place", relation, e)
        return self.last.get(relation, otherwise)

    def __call__(self, settings):
        """The settings with present locations; another object if one has moved."""
        source, target = self.place(settings.source_relation, settings.source_uri), self.place(settings.target_relation, settings.target_uri)
        lookups = [dataclasses.replace(x, uri=self.place(x.relation, x.uri)) for x in settings.lookups]
        if (source, target) == (settings.source_uri, settings.target_uri) and lookups == settings.lookups:
            return settings
        return dataclasses.replace(settings, source_uri=source, target_uri=target, lookups=lookups)


# ---- profiles.yml ----


def profile_places(folder: str | None = None) -> list[str]:
    if folder:
        return [os.path.join(folder, "profiles.yml")]
    places = [os.path.join(os.environ["DBT_PROFILES_DIR"], "profiles.yml")] if os.environ.get("DBT_PROFILES_DIR") else []
    return [*places, "profiles.yml", os.path.expanduser("~/.dbt/profiles.yml")]


def output(profiles: dict, profile: str | None = None, target: str | None = None) -> dict:
    """The output that dbt would take."""
    named = [k for k in profiles if k != "config"]
    if profile is None:
        if len(named) != 1:
            raise ConfigError(f"there are {len(named)} profiles, so one must be named: {', '.join(sorted(named))}")
        profile = named[0]
    if profile not in profiles:
        raise ConfigError(f"there is no profile {profile}; known: {', '.join(sorted(named))}")
    chosen = profiles[profile]
    target = target or chosen.get("target")
    if not target:
        raise ConfigError("no target is given, and the profile has no default")
    if target not in (chosen.get("outputs") or {}):
        raise ConfigError(f"the profile has no output {target}; known: {', '.join(sorted(chosen.get('outputs') or {}))}")
    return chosen["outputs"][target]


def connection(folder: str | None = None, profile: str | None = None, target: str | None = None) -> Connection:
    import yaml

    places = profile_places(folder)
    found = next((p for p in places if os.path.exists(p)), None)
    if not found:
        raise ConfigError(f"no profiles.yml in {', '.join(places)}")
    with open(found, encoding="utf-8") as f:
        try:
            read = yaml.safe_load(_with_environment(f.read())) or {}
        except yaml.YAMLError as e:
            raise ConfigError(f"{found} is no YAML: {e}") from None
    out = output(read, profile, target)
    if out.get("type") != "trino":
        raise ConfigError(f"the output is of type {out.get('type')}; only trino gives locations")
    scheme = out.get("http_scheme", "https" if out.get("password") else "http")
    return Connection(f"{scheme}://{out['host']}:{out.get('port', 8080)}", out.get("user", "millrace"), out.get("password"), out.get("database") or out.get("catalog"), out.get("schema"))


def _with_environment(text: str) -> str:
    def value(m: re.Match) -> str:
        if m.group(1) in os.environ:
            return os.environ[m.group(1)]
        if m.group(2) is not None:
            return m.group(2)
        raise ConfigError(f"profiles.yml needs the environment variable {m.group(1)}")

    return re.sub(r"""\{\{\s*env_var\(\s*['"](\w+)['"]\s*(?:,\s*['"]([^'"]*)['"]\s*)?\)\s*\}\}""", value, text)
