"""Going on after another job has rebuilt the target: rows that it has already are left out.

The cut-off is the newest timestamp in the target; rows at the cut-off are told
apart by key. How far back the source has to be read follows from the
maxima in its log, and who wrote the target from its commits.
"""

from __future__ import annotations

import enum
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError, CursorUnavailable, SchemaError
from ..sources.log import Snapshot, Table
from ..sources.scan import read_snapshot
from ..sources.stats import Bound, bound, file_range, provably_below

MAX_COMMITS = 10_000


@dataclass
class CutOff:
    """The newest timestamp of the target, and the keys it has there."""

    timestamp: str
    key: str | None
    mark: object | None
    boundary: DataFrame | None

    def apply(self, batch: DataFrame) -> DataFrame:
        """Rows of the batch that the target can't have yet.

        A null timestamp is an error. Without a key, rows at the mark are left out; a null key there stays.
        """
        ts = F.col(f"`{self.timestamp}`")
        checked = F.when(ts.isNull(), F.raise_error(F.lit(f"{self.timestamp} is null; the cut-off can't be applied"))).otherwise(ts)
        if self.mark is None:
            return batch.filter(checked.isNotNull())
        mark = F.lit(self.mark).cast(batch.schema[self.timestamp].dataType)
        if self.key is None or self.boundary is None:
            return batch.filter(checked > mark)
        seen = self.boundary.select(F.col(f"`{self.key}`").cast(batch.schema[self.key].dataType).alias("__mr_seen"))
        late = batch.filter(checked >= mark)
        return late.join(seen, (F.col(f"`{self.key}`") == F.col("__mr_seen")) & (ts == mark), "left_anti")


def cut_off(target: DataFrame, timestamp: str, key: str | None) -> CutOff:
    """Two scans of one and of two columns; nulls don't count."""
    for c in (timestamp, key):
        if c is not None and c not in target.columns:
            raise ConfigError(f"the target has no column {c}")
    mark = target.agg(F.max(f"`{timestamp}`")).first()[0]
    boundary = None
    if key is not None and mark is not None:
        boundary = target.filter(F.col(f"`{timestamp}`") == F.lit(mark).cast(target.schema[timestamp].dataType)).select(f"`{key}`").filter(F.col(f"`{key}`").isNotNull()).distinct()
    return CutOff(timestamp, key, mark, boundary)


def read_cut_off(spark: SparkSession, target: Table, timestamp: str, key: str | None) -> CutOff:
    return cut_off(read_snapshot(spark, target, columns=[timestamp, *([key] if key else [])]), timestamp, key)


def rescan_start(source: Table, timestamp: str, mark: object | None, fallback: int, max_commits: int = MAX_COMMITS) -> int:
    """The version after the newest commit that holds nothing beyond the mark; the fallback where the log doesn't tell."""
    cut: Bound = bound(mark)
    if cut is None:
        return fallback
    snapshot = source.snapshot()
    if timestamp not in snapshot.schema.names:
        return fallback
    kind = snapshot.schema[timestamp].dataType
    for n, version in enumerate(range(snapshot.version, fallback - 1, -1)):
        if n >= max_commits:
            return fallback
        try:
            commit = source.commit(version)
        except CursorUnavailable:
            return fallback
        files = [a for a in commit.adds if a.data_change]
        if not files:
            continue
        highs = [file_range(a.stats, timestamp, kind)[1] for a in files]
        if any(h is None or isinstance(h, str) != isinstance(cut, str) for h in highs):
            return fallback
        if all(not provably_below(cut, h) and (h == cut or provably_below(h, cut)) for h in highs):
            return version + 1
    return fallback


class Rebuilt(enum.Enum):
    OURS = "ours"
    NEVER_WRITTEN = "never written"
    OVERWRITTEN = "overwritten"


def who_wrote(target: Table, app_id: str, max_commits: int = MAX_COMMITS) -> tuple[Rebuilt, int | None]:
    """Whether another job has replaced the target's rows since this one wrote, and in which version."""
    head = target.head()
    for n, version in enumerate(range(head, -1, -1)):
        if n >= max_commits:
            return Rebuilt.OVERWRITTEN, version
        try:
            commit = target.commit(version)
        except CursorUnavailable:
            return Rebuilt.OVERWRITTEN, version
        if app_id in commit.txns:
            return Rebuilt.OURS, version
        if any(r.data_change for r in commit.removes):
            return Rebuilt.OVERWRITTEN, version
    return Rebuilt.NEVER_WRITTEN, None


def watermark(spark: SparkSession, table: Table, app_id: str) -> int | None:
    """The newest source_version that a rebuild recorded for this app_id."""
    found = read_snapshot(spark, table, columns=["app_id", "source_version"]).filter(F.col("app_id") == app_id).agg(F.max("source_version")).first()[0]
    if found is not None and found < 0:
        raise SchemaError(f"{table.uri}: the recorded version {found} is negative")
    return found


def replaced(target: Snapshot, target_table: Table, source: Snapshot, app_id: str, next_version: int) -> bool:
    """Whether the source isn't the table that was read so far: another id, or a log that ends before the cursor."""
    if next_version > source.version + 1:
        return True
    for version in range(target.version, max(-1, target.version - MAX_COMMITS), -1):
        try:
            info = target_table.commit(version)
        except CursorUnavailable:
            return False
        if app_id in info.txns:
            stored = info.info.get("millrace.sourceTableId")
            return stored is not None and stored != source.metadata.id
    return False
