"""Lookup tables pinned to a version: the newest one that was there before the source's commit."""

from __future__ import annotations

import enum
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..errors import ConfigError, CursorUnavailable, LogError
from ..sources.log import Snapshot, Table
from ..sources.scan import read_snapshot


class Identity(enum.Enum):
    """What to do when the lookup has been replaced by another table, or its history is gone."""

    STRICT = "strict"
    USE_CURRENT = "use_current"


@dataclass
class Lookup:
    name: str
    uri: str
    identity: Identity = Identity.STRICT
    pre_history_version: int | None = None
    #: Table id that commits so far were made with.
    known_id: str | None = None
    table: Table = field(init=False)

    def __post_init__(self):
        if not valid_name(self.name):
            raise ConfigError(f"{self.name!r} is no name for a lookup: lower-case letters, digits and _, and not source")
        self.table = Table(self.uri)


@dataclass(frozen=True)
class Pinned:
    """A lookup at a version, and how it came to be this one."""

    lookup: Lookup
    snapshot: Snapshot
    pre_history: bool = False
    current: bool = False

    def extra(self) -> tuple[tuple[str, str], ...]:
        """What a commit records about it."""
        base = f"millrace.lookup.{self.lookup.name}"
        made = [(f"{base}.version", str(self.snapshot.version)), (f"{base}.tableId", self.snapshot.metadata.id)]
        return tuple(made + [(f"{base}.{k}", "true") for k, on in (("preHistory", self.pre_history), ("current", self.current)) if on])

    def read(self, spark: SparkSession) -> DataFrame:
        return read_snapshot(spark, self.lookup.table, self.snapshot)


def valid_name(name: str) -> bool:
    return bool(re.fullmatch(r"[a-z_][a-z0-9_]*", name)) and name != "source"


def version_before(table: Table, milliseconds: int, pre_history: int | None = None) -> tuple[int, bool]:
    """(version, whether it is the pre-history one): the newest written before this millisecond.

    Versions of one millisecond count as one, whose last is meant.
    """
    found = None
    for v in table.versions():
        if table.committed_at(v) >= milliseconds:
            break
        found = v
    if found is not None:
        return found, False
    if pre_history is None:
        raise LogError(f"{table.uri} has no version from before the source's commit; set pre_history_version to name one for earlier rows")
    return pre_history, True


def pin(lookup: Lookup, milliseconds: int, attempts: int = 3) -> Pinned:
    """The lookup for a commit of this time. Tried again if the table is replaced while it is resolved."""
    for _ in range(attempts):
        before = lookup.table.snapshot().metadata.id
        if lookup.known_id is not None and before != lookup.known_id:
            if lookup.identity is Identity.STRICT:
                raise LogError(f"lookup {lookup.name}: {lookup.uri} is another table now ({before}, was {lookup.known_id})")
            made = Pinned(lookup, lookup.table.snapshot(), current=True)
        else:
            try:
                version, early = version_before(lookup.table, milliseconds, lookup.pre_history_version)
                made = Pinned(lookup, lookup.table.snapshot(version), pre_history=early)
            except CursorUnavailable:
                if lookup.identity is Identity.STRICT:
                    raise
                made = Pinned(lookup, lookup.table.snapshot(), current=True)
        if lookup.table.snapshot().metadata.id == before:
            return made
    raise LogError(f"lookup {lookup.name}: {lookup.uri} keeps being replaced")


def acknowledge(pinned: list[Pinned]) -> None:
    """To be called once the batch is committed: from here on these are the known tables."""
    for p in pinned:
        p.lookup.known_id = p.snapshot.metadata.id


def guard(source: Snapshot, target: Snapshot, lookups: list[Lookup]) -> None:
    """No table in two roles."""
    if source.metadata.id == target.metadata.id:
        raise ConfigError("source and target are one table")
    seen: dict[str, str] = {}
    for x in lookups:
        own = x.table.snapshot().metadata.id
        for role, other in (("source", source), ("target", target)):
            if own == other.metadata.id:
                raise ConfigError(f"lookup {x.name} is the {role}")
        if own in seen:
            raise ConfigError(f"lookups {seen[own]} and {x.name} are one table")
        seen[own] = x.name
