"""Settings: TOML with many pipelines, of which each that can't work is set aside by name and the others run."""

from __future__ import annotations

import dataclasses
import tomllib
from collections import defaultdict
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

from ..errors import ConfigError, MillraceError
from ..operators import dead_letter
from ..operators.lookup import Identity, valid_name
from ..operators.publish import valid_group
from ..operators.upsert import Lookback, parse_lookback
from ..plans import gate
from ..sources.log import store_for
from ..sources.stream import Policy, parse_bytes
from .limits import check_spill

MODES = ("append", "upsert", "staged_upsert")
STAGE_END = "__mr_stage"
PUBLISHERS = ("webpubsub",)


@dataclass
class Defaults:
    allowed_latency_secs: int = 30
    max_bytes_per_batch: str = "256MB"
    target_file_size: str = "128MB"
    max_files_per_batch: int = 1000
    max_output_rows_per_batch: int = 5_000_000
    max_memory: str | None = None
    max_concurrent_upsert_merges: int | None = None
    max_concurrent_upsert_preflights: int | None = None
    temp_directory: str | None = None
    max_temp_directory_size: str | None = None
    max_grain_check_memory: str | None = None


@dataclass
class LookupConfig:
    name: str
    uri: str
    relation: str | None = None
    pre_history_version: int | None = None
    table_id_change_policy: str = "strict"


@dataclass
class PublishModel:
    model: str
    group: str
    sql: str | None = None
    kind: str = "webpubsub"


@dataclass
class PipelineConfig:
    name: str
    app_id: str
    source_uri: str
    target_uri: str
    lookups: list[LookupConfig] = field(default_factory=list)
    starting_version: int = 0
    change_policy: str = "fail"
    transform_sql: str | None = None
    allowed_latency_secs: int | None = None
    max_bytes_per_batch: str | None = None
    max_files_per_batch: int | None = None
    max_output_rows_per_batch: int | None = None
    target_file_size: str | None = None
    watermark_uri: str | None = None
    dedup_timestamp: str | None = None
    dedup_key: str | None = None
    write_mode: str = "append"
    upsert_key: str | None = None
    dq_uri: str | None = None
    upsert_lookback: str | None = None
    upsert_tiebreak: list[str] = field(default_factory=list)
    upsert_grain_check: str = "always"
    stage_uri: str | None = None
    apply_max_bytes: str | None = None
    apply_max_latency_secs: int | None = None
    source_relation: str | None = None
    target_relation: str | None = None
    publish: PublishModel | None = None
    #: Set for the first half of a staged upsert: the table whose columns the stage has.
    stage_for: str | None = None
    #: Set for the second half.
    from_stage: bool = False


@dataclass
class StorageConfig:
    uri_template: str | None = None
    watermark_uri: str | None = None
    options: dict[str, str] = field(default_factory=dict)


@dataclass
class PublishConfig:
    kind: str = "webpubsub"
    connection_string: str | None = None
    hub: str = "hub"
    message_ttl_secs: int = 0
    max_payload_bytes: int = 1_000_000
    timeout_secs: float = 10.0


@dataclass
class Config:
    pipelines: list[PipelineConfig] = field(default_factory=list)
    defaults: Defaults = field(default_factory=Defaults)
    storage: StorageConfig = field(default_factory=StorageConfig)
    publish: PublishConfig | None = None
    manifest: str | None = None


@dataclass
class Resolved:
    """A pipeline whose settings can work, defaults filled in."""

    name: str
    app_id: str
    source_uri: str
    target_uri: str
    lookups: list[LookupConfig] = field(default_factory=list)
    starting_version: int = 0
    change_policy: Policy = Policy.FAIL
    transform_sql: str | None = None
    allowed_latency_secs: int = 30
    max_bytes_per_batch: int = 256 * 10**6
    max_files_per_batch: int = 1000
    max_output_rows_per_batch: int = 5_000_000
    target_file_size: int = 128 * 10**6
    watermark_uri: str | None = None
    dedup_timestamp: str | None = None
    dedup_key: str | None = None
    write_mode: str = "append"
    upsert_key: str | None = None
    upsert_lookback: Lookback | None = None
    upsert_tiebreak: tuple[str, ...] = ()
    upsert_grain_check: str = "always"
    dq_uri: str | None = None
    stage_for: str | None = None
    source_relation: str | None = None
    target_relation: str | None = None
    publish: PublishModel | None = None
    from_stage: bool = False
    #: Bytes of memory that this pipeline's share of max_memory is.
    memory: int | None = None
    #: Bytes that the uniqueness check keeps to, in as many passes as that takes.
    grain_memory: int | None = None


@dataclass
class Resolution:
    pipelines: list[Resolved] = field(default_factory=list)
    #: name -> why it can't run
    rejected: dict[str, str] = field(default_factory=dict)
    #: Pipelines that run, but without their publication -> why
    unpublished: dict[str, str] = field(default_factory=dict)


# ---- reading ----


def _made(kind, values: Any, where: str):
    if not isinstance(values, dict):
        raise ConfigError(f"{where} must be a table")
    known = {f.name: f for f in dataclasses.fields(kind) if f.name not in ("stage_for", "from_stage")}
    if unknown := set(values) - set(known):
        raise ConfigError(f"{where} has no setting {', '.join(sorted(unknown))}")
    if missing := [n for n, f in known.items() if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING and n not in values]:
        raise ConfigError(f"{where} lacks {', '.join(missing)}")
    return kind(**values)


def parse(text: str) -> Config:
    try:
        read = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"the settings are no TOML: {e}") from None
    if unknown := set(read) - {"manifest", "runtime", "defaults", "storage", "pipeline", "publish"}:
        raise ConfigError(f"the settings have no section {', '.join(sorted(unknown))}")
    if "runtime" in read and "defaults" in read:
        raise ConfigError("runtime and defaults are two names of one section; use one")
    out = Config(
        defaults=_made(Defaults, read.get("defaults", read.get("runtime", {})), "defaults"),
        storage=_made(StorageConfig, read.get("storage", {}), "storage"),
        publish=_made(PublishConfig, read["publish"], "publish") if "publish" in read else None,
        manifest=read.get("manifest"),
    )
    for k, p in enumerate(read.get("pipeline", [])):
        where = f"pipeline {p.get('name', k + 1)!r}"
        p = dict(p)
        lookups = [_made(LookupConfig, x, f"{where}: lookup") for x in p.pop("lookups", [])]
        publish = _made(PublishModel, p.pop("publish"), f"{where}: publish") if "publish" in p else None
        one = _made(PipelineConfig, p, where)
        one.lookups, one.publish = lookups, publish
        out.pipelines.append(one)
    return out


def load(path: str) -> Config:
    try:
        with open(path, encoding="utf-8") as f:
            return parse(f.read())
    except OSError as e:
        raise ConfigError(f"{path}: {e.strerror}") from None


# ---- staged upserts ----


def stage_uri(target_uri: str) -> str:
    return target_uri.rstrip("/") + STAGE_END


def expand_staged(pipelines: list[PipelineConfig]) -> list[PipelineConfig]:
    """A staged upsert is two pipelines: one appends to a stage, the other upserts from there, at its own pace."""
    out = []
    for p in pipelines:
        if p.write_mode != "staged_upsert":
            out.append(p)
            continue
        stage = p.stage_uri or stage_uri(p.target_uri)
        out.append(
            dataclasses.replace(
                p, name=f"{p.name}__ingest", app_id=f"{p.app_id}.ingest", target_uri=stage, write_mode="append", publish=None, target_relation=None, upsert_key=None, upsert_lookback=None,
                upsert_tiebreak=[], upsert_grain_check="always", dq_uri=p.dq_uri or dead_letter.default_uri(p.target_uri), stage_uri=None, apply_max_bytes=None, apply_max_latency_secs=None, stage_for=p.target_uri,
            )
        )
        out.append(
            dataclasses.replace(
                p, name=f"{p.name}__apply", app_id=f"{p.app_id}.apply", source_uri=stage, source_relation=None, write_mode="upsert", publish=None, transform_sql=None, lookups=[], watermark_uri=None,
                starting_version=0, change_policy="fail", stage_uri=None, apply_max_bytes=None, apply_max_latency_secs=None,
                from_stage=True, max_bytes_per_batch=p.apply_max_bytes or p.max_bytes_per_batch, allowed_latency_secs=p.apply_max_latency_secs or p.allowed_latency_secs,
            )
        )
    return out


# ---- rules ----


def _conflicts(pipelines: list[PipelineConfig]) -> dict[str, str]:
    """What pipelines do to each other."""
    found: dict[str, str] = {}
    for what in ("name", "app_id"):
        by = defaultdict(list)
        for p in pipelines:
            by[getattr(p, what)].append(p.name)
        for value, names in by.items():
            if len(names) > 1:
                for n in names:
                    found.setdefault(n, f"{what} {value!r} is used {len(names)} times; none of them runs")
    for up in (p for p in pipelines if p.write_mode == "upsert"):
        for down in (d for d in pipelines if d.source_uri == up.target_uri):
            if not (down.change_policy == "ignore_changes" and down.write_mode == "upsert"):
                found.setdefault(down.name, f"it reads {up.target_uri}, which {up.name} upserts into: every commit there rewrites files. Only change_policy ignore_changes together with write_mode upsert can follow that")
    owners = {p.target_uri: p.name for p in pipelines if p.stage_for}
    for p in pipelines:
        for uri in (p.source_uri, p.target_uri):
            if uri in owners and p.name not in (owners[uri], owners[uri].removesuffix("__ingest") + "__apply"):
                found.setdefault(p.name, f"{uri} is the stage of {owners[uri]}, and no one else's")
    return found


def resolve_one(p: PipelineConfig, d: Defaults, spark: SparkSession | None = None) -> Resolved:
    """Raises ConfigError with the reason if it can't run. Without a session the SQL isn't looked at."""
    if not p.app_id.strip():
        raise ConfigError("app_id is empty; the position is recorded under it")
    if p.source_uri.rstrip("/") == p.target_uri.rstrip("/"):
        raise ConfigError("source and target are one table")
    if p.write_mode not in MODES:
        raise ConfigError(f"write_mode {p.write_mode!r} isn't one of {', '.join(MODES)}")
    if p.upsert_grain_check not in ("always", "off"):
        raise ConfigError(f"upsert_grain_check {p.upsert_grain_check!r} is neither always nor off")
    if p.starting_version < 0:
        raise ConfigError("starting_version is negative")
    try:
        policy = Policy(p.change_policy)
    except ValueError:
        raise ConfigError(f"change_policy {p.change_policy!r} isn't one of {', '.join(x.value for x in Policy)}") from None
    names = set()
    for x in p.lookups:
        if not valid_name(x.name):
            raise ConfigError(f"{x.name!r} is no name for a lookup")
        if x.name in names:
            raise ConfigError(f"lookup {x.name} is declared twice")
        if x.uri in (p.source_uri, p.target_uri):
            raise ConfigError(f"lookup {x.name} is the source or the target")
        if x.table_id_change_policy not in {i.value for i in Identity}:
            raise ConfigError(f"table_id_change_policy {x.table_id_change_policy!r} is neither strict nor use_current")
        names.add(x.name)
    if names and not p.transform_sql:
        raise ConfigError("lookups need a transform_sql that joins them")
    if p.transform_sql and spark is not None:
        gate.check(spark, p.transform_sql, gate.Grain.ROW, names)
    key = p.upsert_key or p.dedup_key
    if p.write_mode == "append":
        if p.upsert_key or p.upsert_lookback or p.upsert_tiebreak:
            raise ConfigError("upsert settings do nothing in write_mode append")
    elif not key or not p.dedup_timestamp:
        raise ConfigError(f"write_mode {p.write_mode} needs upsert_key (or dedup_key) and dedup_timestamp")
    for k, c in enumerate(p.upsert_tiebreak):
        if not c.strip():
            raise ConfigError("upsert_tiebreak has an empty name")
        if c == p.dedup_timestamp:
            raise ConfigError(f"upsert_tiebreak lists {c}, which is dedup_timestamp already")
        if c in p.upsert_tiebreak[:k]:
            raise ConfigError(f"upsert_tiebreak lists {c} twice")
    if p.dedup_key and not p.dedup_timestamp:
        raise ConfigError("dedup_key needs dedup_timestamp")
    for uri in (p.source_uri, p.target_uri, *[x.uri for x in p.lookups], *filter(None, [p.dq_uri, p.watermark_uri, p.stage_uri])):
        store_for(uri)
    latency = d.allowed_latency_secs if p.allowed_latency_secs is None else p.allowed_latency_secs
    files = d.max_files_per_batch if p.max_files_per_batch is None else p.max_files_per_batch
    if files < 1:
        raise ConfigError("max_files_per_batch must be 1 at least")
    size = parse_bytes(p.max_bytes_per_batch or d.max_bytes_per_batch)
    if size < 1:
        raise ConfigError("max_bytes_per_batch must be 1 at least")
    rows = d.max_output_rows_per_batch if p.max_output_rows_per_batch is None else p.max_output_rows_per_batch
    return Resolved(
        p.name, p.app_id, p.source_uri, p.target_uri, p.lookups, p.starting_version, policy, p.transform_sql, latency, size, files, rows, parse_bytes(p.target_file_size or d.target_file_size),
        p.watermark_uri, p.dedup_timestamp, p.dedup_key, p.write_mode, key if p.write_mode != "append" else None, parse_lookback(p.upsert_lookback) if p.upsert_lookback else None,
        tuple(p.upsert_tiebreak), p.upsert_grain_check, p.dq_uri, p.stage_for, p.source_relation, p.target_relation, p.publish, p.from_stage,
        grain_memory=parse_bytes(d.max_grain_check_memory) if d.max_grain_check_memory else None,
    )


def publication_problem(p: PipelineConfig, publish: PublishConfig | None, spark: SparkSession | None = None) -> str | None:
    """Why a pipeline can't publish; it runs all the same."""
    if p.publish is None:
        return None
    if p.write_mode != "append":
        return f"write_mode {p.write_mode} replaces rows, so a batch doesn't tell how totals change; publish from an append-only pipeline"
    if publish is None:
        return "there is no [publish] section"
    if p.publish.kind not in PUBLISHERS:
        return f"{p.publish.kind!r} isn't one of {', '.join(PUBLISHERS)}"
    if not valid_group(p.publish.group):
        return f"{p.publish.group!r} is no name for a group"
    if p.publish.sql and spark is not None:
        try:
            gate.check(spark, p.publish.sql, gate.Grain.BATCH)
        except MillraceError as e:
            return str(e)
    return None


def resolve(config: Config, spark: SparkSession | None = None) -> Resolution:
    """All pipelines that can run, and why the others can't."""
    d = config.defaults
    for most in (d.max_concurrent_upsert_merges, d.max_concurrent_upsert_preflights):
        if most is not None and most < 1:
            raise ConfigError("a limit on concurrent merges or checks must be 1 at least")
    check_spill(d.temp_directory, parse_bytes(d.max_temp_directory_size) if d.max_temp_directory_size else None)
    pipelines = config.pipelines
    if config.manifest:
        from ..plans import dbt

        pipelines = pipelines + dbt.convert(dbt.load(config.manifest), config.storage, spark)
    original = {p.name: p for p in pipelines}
    expanded = expand_staged(pipelines)
    out = Resolution()
    # a half of a staged upsert stands for the whole
    bad = _conflicts(pipelines) | _conflicts(expanded)
    by_group = defaultdict(list)
    for p in expanded:
        whole = p.name.removesuffix("__ingest").removesuffix("__apply")
        why = bad.get(p.name) or (bad.get(whole) if whole in original else None)
        if not why:
            try:
                made = resolve_one(p, d, spark)
            except MillraceError as e:
                why = str(e)
        if why:
            out.rejected[p.name] = why
            continue
        if p.publish:
            if problem := publication_problem(p, config.publish, spark):
                out.unpublished[p.name] = problem
                made.publish = None
            else:
                by_group[p.publish.group].append(made)
        out.pipelines.append(made)
    for name, p in original.items():
        if p.write_mode == "staged_upsert" and p.publish:
            out.unpublished[name] = publication_problem(p, config.publish, spark)
    for group, sharers in by_group.items():
        if len(sharers) > 1:
            for r in sharers:
                r.publish = None
                out.unpublished[r.name] = f"group {group!r} is claimed by {len(sharers)} pipelines; none of them publishes"
    if d.max_memory and out.pipelines:
        for r in out.pipelines:  # half of it is for the batch, the rest for what the query makes of it
            r.memory = parse_bytes(d.max_memory) // len(out.pipelines) // 2
    # both halves or none
    for name in list(original):
        halves = {f"{name}__ingest", f"{name}__apply"}
        if original[name].write_mode == "staged_upsert" and halves & set(out.rejected):
            why = next(out.rejected[h] for h in halves if h in out.rejected)
            for r in [r for r in out.pipelines if r.name in halves]:
                out.pipelines.remove(r)
                out.rejected[r.name] = f"its other half can't run: {why}"
    return out
