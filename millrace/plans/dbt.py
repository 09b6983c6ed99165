"""Which models of a dbt manifest can be streamed, and the pipelines that stream them.

Settings of a model are read from its meta (or config.meta), under names with a prefix:
<prefix>_lookup, <prefix>_write_mode, <prefix>_publish and so on.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..errors import ConfigError, MillraceError
from ..operators.lookup import valid_name
from ..operators.publish import valid_group
from ..streaming.config import PUBLISHERS, LookupConfig, PipelineConfig, PublishModel, StorageConfig
from . import gate, rewrite

STREAMED = ("table", "incremental", "external")
PUBLISHED = ("view", "ephemeral")


@dataclass
class Node:
    id: str
    name: str
    kind: str = "model"
    database: str | None = None
    schema: str | None = None
    alias: str | None = None
    code: str | None = None
    depends: list[str] = field(default_factory=list)
    config: dict = field(default_factory=dict)
    meta: dict = field(default_factory=dict)
    prefix: str = "millrace"

    @property
    def relation(self) -> str:
        return self.alias or self.name

    @property
    def qualified(self) -> str:
        return ".".join(p for p in (self.database, self.schema, self.relation) if p)

    @property
    def materialized(self) -> str:
        return self.config.get("materialized") or "view"

    def setting(self, name: str):
        key = f"{self.prefix}_{name}"
        return self.meta.get(key, (self.config.get("meta") or {}).get(key))

    def spellings(self) -> set[tuple[str, ...]]:
        """Ways in which compiled SQL may name it."""
        parts = [p.lower() for p in (self.database, self.schema, self.relation) if p]
        return {tuple(parts[k:]) for k in range(len(parts))}


@dataclass
class Manifest:
    nodes: dict[str, Node]

    def models(self) -> list[Node]:
        return [n for n in self.nodes.values() if n.kind == "model"]


def parse(text: str, prefix: str = "millrace") -> Manifest:
    try:
        read = json.loads(text)
    except ValueError as e:
        raise ConfigError(f"the manifest is no JSON: {e}") from None
    nodes = {}
    for i, n in {**(read.get("nodes") or {}), **(read.get("sources") or {})}.items():
        depends = ((n.get("depends_on") or {}).get("nodes")) or []
        nodes[i] = Node(i, n.get("name") or i, n.get("resource_type") or "model", n.get("database"), n.get("schema"), n.get("alias") or n.get("identifier"), n.get("compiled_code"), depends, n.get("config") or {}, n.get("meta") or {}, prefix)
    return Manifest(nodes)


def load(path: str, prefix: str = "millrace") -> Manifest:
    try:
        with open(path, encoding="utf-8") as f:
            return parse(f.read(), prefix)
    except OSError as e:
        raise ConfigError(f"{path}: {e.strerror}") from None


@dataclass
class Verdict:
    """kind: streamable, publishes, rejected or unknown."""

    kind: str
    name: str
    reason: str | None = None
    node: Node | None = None
    source: Node | None = None
    lookups: list[tuple[Node, LookupConfig]] = field(default_factory=list)
    sql: str | None = None
    group: str | None = None
    publisher: str | None = None


class _Reject(Exception):
    pass


def rewrite_relations(spark: SparkSession, sql: str, names: dict[tuple[str, ...], str]) -> tuple[str, list[str]]:
    """(SQL with relations replaced, relations that have no replacement).

    A relation is a dotted name after FROM or JOIN, or after a comma of the FROM list, that no CTE has.
    """
    tokens = rewrite.lex(rewrite.quoted_names(sql))
    ctes: set[str] = set()
    for k, t in enumerate(tokens):  # name AS ( ... after WITH or a comma
        if t.kind in ("word", "quoted"):
            a = rewrite._solid(tokens, k + 1)
            if a < len(tokens) and tokens[a].lower() == "as":
                b = rewrite._solid(tokens, a + 1)
                back = rewrite._solid(tokens, k - 1, -1)
                if b < len(tokens) and tokens[b] == "(" and back >= 0 and tokens[back].lower() in ("with", ",", "recursive"):
                    ctes.add(rewrite._name(t).lower().strip("`"))
    out, unknown, k = [], [], 0
    while k < len(tokens):
        t = tokens[k]
        out.append(str(t))
        after_from = t.kind == "word" and t.lower() in ("from", "join") or t == "," and t.kind == "op" and rewrite._in_from(tokens, k)
        k += 1
        if not after_from:
            continue
        a = rewrite._solid(tokens, k)
        out += map(str, tokens[k:a])
        k = a
        parts, end = [], a
        while end < len(tokens) and tokens[end].kind in ("word", "quoted"):
            parts.append(rewrite._name(tokens[end]).strip("`").lower())
            nxt = rewrite._solid(tokens, end + 1)
            if nxt < len(tokens) and tokens[nxt] == ".":
                end = rewrite._solid(tokens, nxt + 1)
            else:
                end += 1
                break
        following = rewrite._solid(tokens, end)
        if not parts or parts[0] in ("lateral", "unnest", "select") or following < len(tokens) and tokens[following] == "(" and len(parts) == 1:
            continue
        key = tuple(parts)
        if len(key) == 1 and key[0] in ctes:
            continue
        k = end
        if key not in names:
            unknown.append(".".join(key))
            out.append(".".join(f"`{p}`" for p in parts))
            continue
        out.append(names[key])
        nxt = tokens[following].lower() if following < len(tokens) and tokens[following].kind in ("word", "quoted") else ""
        if nxt in {"", "where", "group", "having", "order", "limit", "union", "intersect", "except", "cross", "left", "right", "inner", "full", "join", "on", "natural", "window", "offset"} and parts[-1] != names[key]:
            out.append(f" AS `{parts[-1]}`")  # columns may be named by the relation's own name
    return "".join(out), unknown


def _meta_scalar(node: Node, name: str) -> str | None:
    value = node.setting(name)
    if value is not None and not isinstance(value, str):
        raise _Reject(f"{node.prefix}_{name} must be a plain string, not {value!r}")
    return value


def _code(node: Node) -> str:
    if node.code is None:
        raise _Reject("it has no compiled code in the manifest; run dbt compile first")
    return node.code


def _lookup(node: Node, name: str) -> LookupConfig:
    if not valid_name(name):
        raise _Reject(f"{name!r} is no name for a lookup")
    early = node.setting("lookup_pre_history_version")
    if early is not None:
        if not str(early).isdigit():
            raise _Reject(f"pre_history_version {early!r} is no version")
        early = int(early)
    policy = node.setting("lookup_table_id_change_policy")
    if policy not in (None, "strict", "use_current"):
        raise _Reject(f"table_id_change_policy {policy!r} is neither strict nor use_current")
    return LookupConfig(name, "", node.qualified, early, policy or "strict")


def analyze(manifest: Manifest, node_id: str, spark: SparkSession) -> Verdict:
    node = manifest.nodes.get(node_id)
    if node is None:
        return Verdict("rejected", node_id, "the manifest has no such node")
    try:
        if node.kind != "model":
            raise _Reject(f"it is a {node.kind}, no model")
        if node.setting("publish") is not None:
            if node.materialized in STREAMED:
                raise _Reject(f"it is materialized as {node.materialized} and says what to publish; the publication belongs to a view of its own on this model")
            return _publication(manifest, node, spark)
        if node.materialized not in STREAMED:
            raise _Reject(f"it is materialized as {node.materialized}, not as one of {', '.join(STREAMED)}")
        code = _code(node)
        sources, lookups = [], []
        for i in node.depends:
            upstream = manifest.nodes.get(i)
            if upstream is None:
                raise _Reject(f"it depends on {i}, which the manifest doesn't have")
            name = _meta_scalar(upstream, "lookup")
            if name is None:
                sources.append(upstream)
            else:
                lookups.append((upstream, _lookup(upstream, name)))
        if len(sources) != 1:
            raise _Reject(f"it depends on {len(sources)} streamed relations, and one can be streamed; mark small ones as lookups, or split the model")
        names = [c.name for _, c in lookups]
        if len(set(names)) < len(names):
            raise _Reject("two lookups have one name")
        replaced = {s: gate.SOURCE for s in sources[0].spellings()} | {s: c.name for n, c in lookups for s in n.spellings()}
        sql = _checked(spark, code, replaced, gate.Grain.ROW, names)
        return Verdict("streamable", node.name, None, node, sources[0], lookups, sql)
    except _Reject as e:
        return Verdict("rejected", node.name, str(e), node)
    except RecursionError as e:
        return Verdict("unknown", node.name, repr(e), node)


def _checked(spark, code, replaced, grain, names=()) -> str:
    sql, unknown = rewrite_relations(spark, code, replaced)
    if unknown:
        raise _Reject(f"it reads {', '.join(sorted(set(unknown)))}, which it doesn't declare")
    try:
        gate.check(spark, sql, grain, names)
    except MillraceError as e:
        raise _Reject(str(e)) from None
    return sql


def _publication(manifest: Manifest, node: Node, spark: SparkSession) -> Verdict:
    kind = _meta_scalar(node, "publish")
    if kind not in PUBLISHERS:
        raise _Reject(f"{kind!r} isn't one of {', '.join(PUBLISHERS)}")
    if node.materialized not in PUBLISHED:
        raise _Reject(f"it is materialized as {node.materialized}; what is published has no storage, so take one of {', '.join(PUBLISHED)}")
    code = _code(node)
    if len(node.depends) != 1:
        raise _Reject(f"it depends on {len(node.depends)} relations; a publication reads the one whose batches it tells of")
    host = manifest.nodes.get(node.depends[0])
    if host is None:
        raise _Reject(f"it publishes for {node.depends[0]}, which the manifest doesn't have")
    if host.setting("publish") is not None:
        raise _Reject(f"{host.name} is a publication itself")
    verdict = analyze(manifest, host.id, spark)
    if verdict.kind != "streamable":
        raise _Reject(f"{host.name} can't be streamed: {verdict.reason}")
    if host.setting("write_mode") in ("upsert", "staged_upsert"):
        raise _Reject(f"{host.name} is upserted into, so a batch doesn't tell how totals change")
    group = _meta_scalar(node, "publish_group") or node.name
    if not valid_group(group):
        raise _Reject(f"{group!r} is no name for a group")
    sql = _checked(spark, code, {s: gate.SOURCE for s in host.spellings()}, gate.Grain.BATCH)
    return Verdict("publishes", node.name, None, node, host, [], sql, group, kind)


def analyze_all(manifest: Manifest, spark: SparkSession) -> list[Verdict]:
    """Of every model. Publications that share a host or a group are all rejected."""
    found = [analyze(manifest, n.id, spark) for n in sorted(manifest.models(), key=lambda n: n.id)]
    published = [v for v in found if v.kind == "publishes"]
    for what, key in (("host", lambda v: v.source.id), ("group", lambda v: v.group)):
        counts = Counter(map(key, published))
        for v in published:
            if counts[key(v)] > 1 and v.kind == "publishes":
                v.kind, v.reason = "rejected", f"{counts[key(v)]} publications have one {what}; none of them is taken"
    return found


# ---- pipelines ----


def location(node: Node, template: str | None) -> str | None:
    known = node.setting("location") or node.meta.get("delta_table_path") or (node.config.get("meta") or {}).get("delta_table_path") or node.config.get("delta_path")
    if known:
        return known
    if node.config.get("location_root"):
        return f"{node.config['location_root'].rstrip('/')}/{node.relation}"
    if template:
        return template.replace("{database}", node.database or "").replace("{schema}", node.schema or "").replace("{name}", node.relation)
    return None


_SETTINGS = {
    "timestamp": "dedup_timestamp", "key": "dedup_key", "write_mode": "write_mode", "upsert_key": "upsert_key", "upsert_lookback": "upsert_lookback", "upsert_grain_check": "upsert_grain_check", "change_policy": "change_policy",
    "dq_location": "dq_uri", "stage_location": "stage_uri", "apply_max_bytes": "apply_max_bytes", "max_bytes_per_batch": "max_bytes_per_batch",
}
_NUMBERS = {"starting_version": "starting_version", "allowed_latency_secs": "allowed_latency_secs", "apply_max_latency_secs": "apply_max_latency_secs", "max_files_per_batch": "max_files_per_batch"}


def convert(manifest: Manifest, storage: StorageConfig, spark: SparkSession, locate: Callable[[str], str] | None = None) -> list[PipelineConfig]:
    """A pipeline for each streamable model, with its publication. The app_id follows from the model's name alone."""
    verdicts = analyze_all(manifest, spark)
    published = {v.source.id: v for v in verdicts if v.kind == "publishes"}

    def place(node: Node) -> str:
        found = location(node, None) or (locate(node.qualified) if locate else None) or location(node, storage.uri_template)
        if not found:
            raise ConfigError(f"{node.name}: it isn't known where {node.qualified} is; set {node.prefix}_location or a uri_template")
        return found

    out = []
    for v in verdicts:
        if v.kind != "streamable":
            continue
        n = v.node
        made = PipelineConfig(n.name, f"{n.prefix}.{n.name}", place(v.source), place(n), transform_sql=v.sql, source_relation=v.source.qualified, target_relation=n.qualified, watermark_uri=storage.watermark_uri)
        for key, name in _SETTINGS.items():
            if (value := n.setting(key)) is not None:
                setattr(made, name, str(value))
        for key, name in _NUMBERS.items():
            if (value := n.setting(key)) is not None:
                if not str(value).isdigit():
                    raise ConfigError(f"{n.name}: {n.prefix}_{key} is {value!r}, no number")
                setattr(made, name, int(value))
        ties = n.setting("upsert_tiebreak")
        made.upsert_tiebreak = [t.strip() for t in ties.split(",")] if isinstance(ties, str) else list(ties or [])
        for node, c in v.lookups:
            c.uri = place(node)
            made.lookups.append(c)
        if p := published.get(n.id):
            made.publish = PublishModel(p.name, p.group, p.sql, p.publisher)
        out.append(made)
    return out


def to_toml(pipelines: list[PipelineConfig]) -> str:
    """Settings that read back as the same pipelines."""
    import dataclasses

    def value(x) -> str:
        if isinstance(x, list):
            return "[" + ", ".join(map(value, x)) + "]"
        return str(x) if isinstance(x, int) else json.dumps(x, ensure_ascii=False)

    def lines(x, skip=()) -> list[str]:
        return [f"{f.name} = {value(getattr(x, f.name))}" for f in dataclasses.fields(x) if f.name not in skip and getattr(x, f.name) not in (None, [], f.default)]

    out: list[str] = []
    for p in pipelines:
        out += ["[[pipeline]]", *lines(p, ("lookups", "publish", "stage_for", "from_stage"))]
        for x in p.lookups:
            out += ["[[pipeline.lookups]]", *lines(x)]
        if p.publish:
            out += ["[pipeline.publish]", *lines(p.publish)]
        out.append("")
    return "\n".join(out)
