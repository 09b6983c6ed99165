"""Keyed upserts: the newest row of each key, merged into the files that may hold it.

A batch is brought to one row a key. Of the target's files, those whose range of keys
can't hold one of the batch's are skipped by their statistics; a lookback limits how
far back the rest is searched. Only files in which a row really changes
are written again; the rest of the table is left alone.
"""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CommitConflict, ConfigError, SchemaError
from ..sources.log import Add, Remove, Snapshot, Table
from ..sources.scan import FILE, read_files, place_of
from ..sources.sink import Offset, commit, write_files
from ..sources.stats import Bound, all_keys, bound, file_range, provably_below, touches_any
from . import grain

log = logging.getLogger(__name__)

_UNITS = {"us": 1, "ms": 1000, "s": 10**6, "m": 60 * 10**6, "h": 3600 * 10**6, "d": 86400 * 10**6, "w": 7 * 86400 * 10**6}
ATTEMPTS = 3
#: Distinct keys of a batch up to which files are tested against each key; a larger batch is tested by its range.
MOST_KEYS = 200_000


@dataclass(frozen=True)
class Lookback:
    """How far below the batch's smallest sequence the target is searched."""

    amount: int
    duration: bool

    def check(self, kind: T.DataType) -> None:
        temporal = isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))
        if self.duration and not temporal:
            raise ConfigError(f"a lookback of time doesn't fit a {kind.simpleString()} sequence")
        if not self.duration and not isinstance(kind, T.NumericType):
            raise ConfigError(f"a lookback without a unit needs a numeric sequence, not {kind.simpleString()}")


def parse_lookback(text: str | int) -> Lookback:
    m = re.fullmatch(r"\s*(-?\d+)\s*(us|ms|s|m|h|d|w)?\s*", str(text))
    if not m:
        raise ConfigError(f"{text!r} is no lookback; write it like 48h, or a number")
    amount = int(m.group(1))
    if amount < 0:
        raise ConfigError(f"the lookback {text} is negative")
    return Lookback(amount * _UNITS.get(m.group(2), 1), m.group(2) is not None)


@dataclass(frozen=True)
class Keys:
    key: str
    sequence: str
    tiebreak: tuple[str, ...] = ()
    lookback: Lookback | None = None

    @property
    def order(self) -> tuple[str, ...]:
        return (self.sequence, *self.tiebreak)


def collapse(batch: DataFrame, keys: Keys) -> DataFrame:
    """One row a key: the largest sequence, then tie-breakers, then the later row. A null in any of them is an error.

    Rows are moved into partitions of the advised size before they are sorted: a file's row group, or a key with many
    rows, would else be sorted in one task. A key's rows may be parted by that; their newest meet in the second shuffle.
    """
    position = "__mr_position"
    checked = batch.withColumn(position, F.monotonically_increasing_id())
    for c in (keys.key, *keys.order):
        if c not in batch.columns:
            raise ConfigError(f"the batch has no column {c}")
        value = F.col(f"`{c}`")
        checked = checked.withColumn(c, F.when(value.isNull(), F.raise_error(F.lit(f"{c} is null; an upsert can't place the row")).cast(batch.schema[c].dataType)).otherwise(value))
    window = Window.partitionBy(F.col(f"`{keys.key}`")).orderBy(*[F.col(f"`{c}`").desc() for c in keys.order], F.col(position).desc())
    parted = checked.withColumn("__mr_part", F.xxhash64(F.col(f"`{keys.key}`"))).hint("rebalance", "__mr_part")
    ranked = parted.withColumn("__mr_rank", F.row_number().over(window))
    return ranked.filter("__mr_rank = 1").select(*[F.col(f"`{c}`") for c in batch.columns])


def newer(order: tuple[str, ...], new: str, old: str) -> Column:
    """Whether the new row comes after the stored one; null, so false, where a stored value that decides is null."""
    made = None
    for k, c in enumerate(order):
        part = F.col(f"{new}.`{c}`") > F.col(f"{old}.`{c}`")
        for before in order[:k]:
            part = (F.col(f"{new}.`{before}`") == F.col(f"{old}.`{before}`")) & part
        made = part if made is None else made | part
    return made


@dataclass
class Plan:
    """Which files a merge has to look into, and from which sequence on."""

    candidates: list[Add]
    floor: Bound = None
    clamped: bool = False
    unbounded: bool = False


def plan(snapshot: Snapshot, keys: Keys, key_values: list[Bound] | None, smallest: Bound) -> Plan:
    """key_values: the batch's sorted keys (its range would do), None where they can't be compared."""
    key_kind, seq_kind = snapshot.schema[keys.key].dataType, snapshot.schema[keys.sequence].dataType
    candidates, lows = [], []
    for add in snapshot.files.values():
        low, high = file_range(add.stats, keys.key, key_kind)
        if key_values is not None and not touches_any(low, high, key_values):
            continue
        candidates.append(add)
        lows.append(file_range(add.stats, keys.sequence, seq_kind)[0])
    unbounded = any(x is None for x in lows) or smallest is None
    if keys.lookback is None or smallest is None or isinstance(smallest, str):
        return Plan(candidates, None, False, unbounded)
    floor = smallest - keys.lookback.amount
    if not unbounded and (not lows or not provably_below(min(lows), floor)):
        return Plan(candidates, None, False, False)
    # rows below the floor don't match even in files that are read, so files wholly below needn't be
    kept = [a for a in candidates if not provably_below(file_range(a.stats, keys.sequence, seq_kind)[1], floor)]
    return Plan(kept, floor, True, unbounded)


def batch_bounds(batch: DataFrame, keys: Keys) -> tuple[list[Bound] | None, Bound]:
    """(sorted keys, or the ends of their range if they are many; smallest sequence)."""
    low, high, n, seq = batch.agg(F.min(f"`{keys.key}`"), F.max(f"`{keys.key}`"), F.count(F.lit(1)), F.min(f"`{keys.sequence}`")).first()
    if n == 0:
        return [], None
    if n <= MOST_KEYS:
        return all_keys(r[0] for r in batch.select(f"`{keys.key}`").collect()), bound(seq)
    ends = all_keys([low, high])
    return (None if ends is None else _Span(ends)), bound(seq)


class _Span(list):
    """A range as a list of keys that touches whatever overlaps it."""


def _floor_column(floor: Bound, kind: T.DataType) -> Column:
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.timestamp_micros(F.lit(int(floor))).cast(kind)
    if isinstance(kind, T.DateType):
        return F.timestamp_micros(F.lit(int(floor))).cast("date")
    return F.lit(floor).cast(kind)


@dataclass
class Merged:
    version: int
    updated: int = 0
    inserted: int = 0
    files_scanned: int = 0
    files_rewritten: int = 0
    clamped: bool = False
    unbounded: bool = False
    attempts: int = 1


def merge(spark: SparkSession, table: Table, batch: DataFrame, keys: Keys, produced: list[str], offset: Offset | None, attempts: int = ATTEMPTS, file_size: int | None = None) -> Merged:
    """Upserts a batch of the target's schema. Only `produced` columns of stored rows change; new rows get all.

    Planned again on the newest state if someone else commits meanwhile.
    """
    one = collapse(batch, keys).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        values, smallest = batch_bounds(one, keys)
        for attempt in range(1, attempts + 1):
            try:
                made = _merge_once(spark, table, one, keys, produced, offset, values, smallest, file_size)
                made.attempts = attempt
                return made
            except CommitConflict:
                if attempt == attempts:
                    raise
                log.info("%s: planned again, as someone else committed", table.uri)
        raise AssertionError
    finally:
        one.unpersist()


def _merge_once(spark, table: Table, one: DataFrame, keys: Keys, produced: list[str], offset, values, smallest, file_size=None) -> Merged:
    base = table.snapshot()
    schema, partitions = base.schema, base.metadata.partitions
    if values == []:
        return Merged(commit(table, base, offset, []))
    span = values if not isinstance(values, _Span) else None
    planned = plan(base, keys, span, smallest)
    if isinstance(values, _Span):
        kind = schema[keys.key].dataType
        ranges = [(a, *file_range(a.stats, keys.key, kind)) for a in planned.candidates]
        planned.candidates = [a for a, low, high in ranges if low is None or high is None or not provably_below(high, values[0]) and not provably_below(values[1], low)]
    if keys.key in partitions or keys.sequence in partitions:
        planned.candidates = list(base.files.values()) if not planned.clamped else planned.candidates
    stored = read_files(spark, table, [(base.version, a) for a in planned.candidates], schema, partitions, with_file=True)
    floor = _floor_column(planned.floor, schema[keys.sequence].dataType) if planned.clamped else None
    key = f"`{keys.key}`"
    slim = stored.select(key, *[f"`{c}`" for c in dict.fromkeys(keys.order) if c != keys.key], FILE)
    if floor is not None:
        slim = slim.filter(F.col(f"`{keys.sequence}`") >= floor)
    ends = one.agg(F.min(key), F.max(key)).first()
    slim = slim.filter(F.col(key).between(*[F.lit(v).cast(schema[keys.key].dataType) for v in ends]))  # reaches the files' row groups
    hits = one.alias("s").join(slim.alias("t"), F.col(f"s.{key}") == F.col(f"t.{key}"))
    changed = [r[0] for r in hits.filter(newer(keys.order, "s", "t")).select(f"t.{FILE}").distinct().collect()]
    by_path = {place_of(table, a.path): a for a in planned.candidates}
    touched = [by_path[_plain(p)] for p in changed]
    inserts = one.alias("s").join(slim.select(F.col(key).alias("__mr_key")).alias("t"), F.col(f"s.{key}") == F.col("__mr_key"), "left_anti")
    rows = inserts.select(*[F.col(f"`{f.name}`") for f in schema], F.lit(1).alias("__mr_new"))
    if touched:
        old = read_files(spark, table, [(base.version, a) for a in touched], schema, partitions)
        fits = (F.col(f"s.{key}") == F.col(f"t.{key}")) & newer(keys.order, "s", "t")
        if floor is not None:
            fits &= F.col(f"t.`{keys.sequence}`") >= floor
        fresh = F.col(f"s.{key}").isNotNull()
        made = [(F.when(fresh, F.col(f"s.`{f.name}`")).otherwise(F.col(f"t.`{f.name}`")) if f.name in produced else F.col(f"t.`{f.name}`")).alias(f.name) for f in schema]
        rows = rows.unionByName(old.alias("t").join(one.alias("s"), fits, "left").select(*made, F.when(fresh, 2).otherwise(0).alias("__mr_new")))
    counts = F.count_if(F.col("__mr_new") == 1).alias("inserted"), F.count_if(F.col("__mr_new") == 2).alias("updated")
    from pyspark.sql import Observation

    seen = Observation()
    written = write_files(table, base, rows.observe(seen, *counts), file_size)
    inserted, updated = seen.get["inserted"], seen.get["updated"]
    shared = dict(files_scanned=len(planned.candidates), clamped=planned.clamped, unbounded=planned.unbounded)
    if not inserted and not updated:
        return Merged(commit(table, base, offset, []), **shared)
    version = commit(table, base, offset, written.adds, [Remove(a.path) for a in touched]) if touched else _insert_only(table, base, offset, written.adds)
    return Merged(version, updated, inserted, files_rewritten=len(touched), **shared)


def _insert_only(table: Table, base: Snapshot, offset, adds) -> int:
    """New keys only hold on the state they were looked up in, so there is no going on to a later version."""
    actions = (offset.actions() if offset else []) + [a.action() for a in adds]
    table.write_commit(base.version + 1, actions)
    return base.version + 1


def _plain(path: str) -> str:
    """A file's URI as the path it is opened by."""
    parsed = urlparse(path)
    place = unquote(parsed.path)
    return place if parsed.scheme in ("", "file") else f"{parsed.scheme}://{parsed.netloc}{place}"


def preflight(spark: SparkSession, table: Table, keys: Keys, check_grain: bool = True, memory: int | None = None) -> int:
    """Columns, lookback, append-only and one row a key; the passes of the last, 0 if it is left out."""
    snapshot = table.snapshot()
    for c in (keys.key, *keys.order):
        if c not in snapshot.schema.names:
            raise ConfigError(f"{table.uri} has no column {c}")
    if keys.lookback:
        keys.lookback.check(snapshot.schema[keys.sequence].dataType)
    if snapshot.metadata.append_only:
        raise ConfigError(f"{table.uri} is append-only; an upsert can't change it")
    if not check_grain:
        log.warning("%s: whether %s is unique isn't checked", table.uri, keys.key)
        return 0
    from ..sources.scan import read_snapshot

    try:
        return grain.check(read_snapshot(spark, table, snapshot, [keys.key]), [keys.key], table.uri, memory)
    except SchemaError as e:
        raise SchemaError(f"{e}; remove the repeats before upserting") from None
