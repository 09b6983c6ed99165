"""One pipeline: batches of a source's log through a query into a target, exactly once.

The position is kept in the target's own log, in the commit that holds the rows,
so a restart goes on behind the last whole batch; there is no checkpoint folder. What
happens before that commit leaves at most rejected rows behind (once), and what comes
after can't fail the batch.
"""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import SparkSession

from ..errors import ConfigError, LogError, SchemaError
from ..operators import coerce, dead_letter, dedup, lookup, upsert
from ..operators.publish import Publisher, Stats
from ..plans.transform import Identity, SqlTransform, Transform
from ..sources.log import Table
from ..sources.scan import read_files
from ..sources.sink import Offset, append, resume_version
from ..sources.stats import rows_of
from ..sources.stream import Cursor, LogStream
from .config import Resolved
from .limits import Gate
from .metrics import Metrics

log = logging.getLogger(__name__)


@dataclass
class Outcome:
    """kind: caught_up, progressed or skipped."""

    kind: str
    cursor: Cursor
    rows: int = 0
    rejected: int = 0
    version: int | None = None
    merged: upsert.Merged | None = None
    published: Stats | None = None
    files: int = 0
    warnings: list[str] = field(default_factory=list)


class Pipeline:
    def __init__(self, spark: SparkSession, settings: Resolved, transform: Transform | None = None, publisher: Publisher | None = None, metrics: Metrics | None = None, merges: Gate | None = None, preflights: Gate | None = None):
        self.spark, self.settings = spark, settings
        self.metrics = metrics or Metrics(settings.name)
        self.merges, self.publisher = merges or Gate(), publisher
        s = settings
        self.source, self.target = Table(s.source_uri), Table(s.target_uri)
        if s.stage_for and not self.target.exists():
            self.target.create_like(Table(s.stage_for))
        self.lookups = [lookup.Lookup(x.name, x.uri, lookup.Identity(x.table_id_change_policy), x.pre_history_version) for x in s.lookups]
        self.transform = transform or (SqlTransform(spark, s.transform_sql, tuple(x.name for x in self.lookups)) if s.transform_sql else Identity())
        source, target = self.source.snapshot(), self.target.snapshot()
        lookup.guard(source, target, self.lookups)
        self.keys = upsert.Keys(s.upsert_key, s.dedup_timestamp, s.upsert_tiebreak, s.upsert_lookback) if s.write_mode == "upsert" else None
        self.cut_off: dedup.CutOff | None = None
        start = self._resume(source, target)
        if self.keys:
            with (preflights or Gate()).entered():
                passes = upsert.preflight(spark, self.target, self.keys, s.upsert_grain_check == "always", s.grain_memory)
                self.metrics.set(grain_check_passes=passes)
        self.letters = dead_letter.open_table(s.dq_uri or dead_letter.default_uri(s.target_uri))
        self._known_lookups(target)
        # the stage's commits are our own: one is as large as what a batch became, which no setting bounds
        self.stream = LogStream(self.source, Cursor(start), s.change_policy, s.max_files_per_batch, s.max_bytes_per_batch, one_commit=bool(self.lookups), memory=s.memory, any_size=s.from_stage)

    # ---- where to begin ----

    def _resume(self, source, target) -> int:
        s = self.settings
        own = resume_version(target, s.app_id)
        if own is None:
            state, _ = (dedup.who_wrote(self.target, s.app_id) if s.dedup_timestamp or s.watermark_uri else (dedup.Rebuilt.NEVER_WRITTEN, None))
            if state is dedup.Rebuilt.OVERWRITTEN and s.write_mode == "append":
                return self._after_rebuild(s.starting_version)
            return s.starting_version
        if dedup.replaced(target, self.target, source, s.app_id, own):
            if not s.dedup_timestamp:
                raise LogError(f"{s.name}: {s.source_uri} isn't the table that was read so far; set dedup_timestamp to begin anew without repeats")
            log.warning("%s: the source was replaced; it is read from version %d", s.name, s.starting_version)
            if s.write_mode == "append":
                self.cut_off = dedup.read_cut_off(self.spark, self.target, s.dedup_timestamp, s.dedup_key)
            return s.starting_version
        if s.write_mode == "append":
            state, version = dedup.who_wrote(self.target, s.app_id)
            if state is dedup.Rebuilt.OVERWRITTEN:
                log.warning("%s: version %s of the target was made by someone else", s.name, version)
                return self._after_rebuild(own)
        return own

    def _after_rebuild(self, otherwise: int) -> int:
        s = self.settings
        if s.dedup_timestamp:
            self.cut_off = dedup.read_cut_off(self.spark, self.target, s.dedup_timestamp, s.dedup_key)
            return dedup.rescan_start(self.source, s.dedup_timestamp, self.cut_off.mark, s.starting_version)
        if s.watermark_uri:
            found = dedup.watermark(self.spark, Table(s.watermark_uri), s.app_id)
            if found is None:
                raise LogError(f"{s.name}: {s.watermark_uri} has no row for {s.app_id}, so it isn't known what the rebuild has read")
            return found + 1
        return otherwise

    def _known_lookups(self, target) -> None:
        """Table ids that this pipeline's last commit was made with; another set of lookups than then is an error."""
        for version in range(target.version, max(-1, target.version - dedup.MAX_COMMITS), -1):
            made = self.target.commit(version)
            if self.settings.app_id in made.txns:
                prefix = "millrace.lookup."
                recorded = {k[len(prefix) : -len(".tableId")]: v for k, v in made.info.items() if k.startswith(prefix) and k.endswith(".tableId")}
                if recorded and set(recorded) != {x.name for x in self.lookups}:
                    raise ConfigError(f"{self.settings.name}: the lookups were {', '.join(sorted(recorded))} so far; take a new app_id for another set")
                for x in self.lookups:
                    x.known_id = recorded.get(x.name)
                return

    # ---- a batch ----

    def step(self) -> Outcome:
        """The next batch, whole or not at all."""
        s, before = self.settings, self.stream.cursor
        skipped = self.stream.skipped
        batch = self.stream.next_batch()
        self.metrics.set(source_head_version=self.source.head(), source_lag_versions=self.stream.lag())
        self.metrics.add(commits_skipped=self.stream.skipped - skipped)
        if batch is None:
            return Outcome("caught_up" if self.stream.cursor == before else "skipped", self.stream.cursor)
        try:
            made = self._run(batch)
        except BaseException:
            self.stream.cursor = before  # it is read again
            raise
        self.metrics.add(batches_committed=1, rows_written=made.rows, files_read=made.files, rows_rejected=made.rejected)
        self.metrics.set(last_source_version=batch.end.last_whole(), progressed_at=time.time())
        if made.rejected and not made.rows:
            self.metrics.add(batches_fully_rejected=1)
        return made

    def _run(self, batch) -> Outcome:
        s = self.settings
        pinned = [lookup.pin(x, batch.committed_at) for x in self.lookups]
        self.stream.observe(*coerce.refuse_unreadable(self.source, batch.files, batch.schema))
        source = read_files(self.spark, self.source, batch.files, batch.schema, batch.partitions, ordered=self.keys is not None)
        rows = self.transform.apply(source, {p.lookup.name: p.read(self.spark) for p in pinned})
        target = self.target.snapshot()
        produced = coerce.columns_present(rows, target.schema)
        if s.stage_for and len(produced) < len(target.schema):
            raise SchemaError(f"{s.name}: a staged upsert needs every column of the target; {', '.join(sorted(set(target.schema.names) - set(produced)))} missing")
        version = batch.end.last_whole()
        held, rejected = None, 0
        try:
            if self.letters:
                parted = coerce.quarantining(rows, target.schema)
                held = parted.marked = parted.marked.persist(StorageLevel.MEMORY_AND_DISK)
                good = parted.good()
                if parted.marked.filter(f"{coerce.AT} is not null").limit(1).count():
                    rejected = dead_letter.write(self.letters, parted.rejects(), s.app_id, s.name, version)
            else:
                good = coerce.strict(rows, target.schema)
                if self.publisher and not self.publisher.breaker.open():
                    held = good = good.persist(StorageLevel.MEMORY_AND_DISK)  # rows and message are of one computation
            if self.cut_off is not None:
                good = self.cut_off.apply(good)
            rendered = self.publisher.render(good) if self.publisher else None
            extra = tuple(e for p in pinned for e in p.extra())
            offset = Offset(s.app_id, version, self.source.snapshot(batch.through).metadata.id, extra)
            merged = None
            if self.keys:
                with self.merges.entered() as waited:
                    began = time.monotonic()
                    merged = upsert.merge(self.spark, self.target, good, self.keys, produced, offset, file_size=s.target_file_size)
                    self.metrics.add(merges=1, merge_milliseconds=int((time.monotonic() - began) * 1000), merge_queue_milliseconds=int(waited * 1000), upsert_rows_updated=merged.updated, upsert_rows_inserted=merged.inserted)
                    self.metrics.add(upsert_target_files_scanned=merged.files_scanned, upsert_window_clamped=int(merged.clamped), upsert_window_unbounded=int(merged.unbounded))
                at, count = merged.version, merged.updated + merged.inserted
            else:
                at, count = append(self.target, good, offset, s.target_file_size)
        finally:
            if held is not None:
                held.unpersist()
        lookup.acknowledge(pinned)
        made = Outcome("progressed", self.stream.cursor, count, rejected, at, merged, files=len(batch.files))
        if count > s.max_output_rows_per_batch:
            made.warnings.append(f"{count} rows came out of one batch, more than the {s.max_output_rows_per_batch} expected")
            log.warning("%s: %s", s.name, made.warnings[-1])
        if self.publisher:
            made.published = self.publisher.send(rendered, batch.versions[0], version, at)
            self.metrics.published(made.published)
        return made

    def run_once(self, most: int = 1_000_000) -> list[Outcome]:
        """Batches until the source has no more."""
        made = []
        for _ in range(most):
            out = self.step()
            made.append(out)
            if out.kind == "caught_up":
                break
        return made


def input_rows(batch) -> int | None:
    """Rows of a batch by its files' statistics; None where one has none."""
    counts = [rows_of(a.stats) for _, a in batch.files]
    return None if any(c is None for c in counts) else sum(counts)
