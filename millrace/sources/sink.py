"""Commits of rows together with how far their source has been read."""

from __future__ import annotations

import datetime as dt
import json
import logging
import re
import threading
import uuid
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CommitConflict, LogError, SchemaError
from .log import Add, Remove, Snapshot, Table
from .stats import footer_stats, rows_of, written

log = logging.getLogger(__name__)

ATTEMPTS = 20


@dataclass(frozen=True)
class Offset:
    """The position that a commit records: under app_id, `source_version` has been read."""

    app_id: str
    source_version: int
    source_table_id: str | None = None
    extra: tuple[tuple[str, str], ...] = ()

    def actions(self) -> list[dict]:
        if self.source_version < 0:
            raise LogError(f"{self.app_id}: {self.source_version} is no version to record")
        info = {"timestamp": int(dt.datetime.now(dt.timezone.utc).timestamp() * 1000), "millrace.sourceVersion": self.source_version, "millrace.appId": self.app_id}
        if self.source_table_id is not None:
            info["millrace.sourceTableId"] = self.source_table_id
        return [{"txn": {"appId": self.app_id, "version": self.source_version}}, {"commitInfo": info | dict(self.extra)}]


def resume_version(snapshot: Snapshot, app_id: str) -> int | None:
    """The version to go on with, or None where nothing is recorded."""
    stored = snapshot.txns.get(app_id)
    if stored is None:
        return None
    if stored < 0:
        raise LogError(f"{app_id}: the recorded version {stored} is negative")
    return stored + 1


@dataclass
class Written:
    """Files that are there but in no commit yet."""

    adds: list[Add] = field(default_factory=list)

    @property
    def rows(self) -> int:
        return sum(rows_of(a.stats) or 0 for a in self.adds)


#: Files from which their footers are read by the executors.
MANY_FILES = 64
_SIZING = threading.Lock()
_ADVISED, _MANY, _LEAST = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.parallelismFirst", "spark.sql.adaptive.coalescePartitions.minPartitionSize"


def _write(rows: DataFrame, partitions: list[str], path: str, file_size: int | None) -> None:
    """One write of its own rows only: a folder is never written twice."""

    def write(df: DataFrame) -> None:
        writer = df.write.mode("error").option("parquet.outputTimestampType", "TIMESTAMP_MICROS")
        (writer.partitionBy(*partitions) if partitions else writer).parquet(path)

    columns = [F.col(f"`{p}`") for p in partitions]
    if not file_size:
        write(rows.repartition(*columns) if partitions else rows)  # a partition's rows meet in few files
        return
    conf = rows.sparkSession.conf
    with _SIZING:  # the settings are the session's
        before = {k: conf.get(k, None) for k in (_ADVISED, _MANY, _LEAST)}
        conf.set(_ADVISED, str(file_size))
        conf.set(_MANY, "false")
        conf.set(_LEAST, str(min(file_size, 1 << 20)))
        try:
            write(rows.hint("rebalance", *columns))
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)


def _footers(spark: SparkSession, paths: list[str]) -> list[str]:
    """Statistics of each file."""
    if len(paths) < MANY_FILES:
        return [footer_stats(p) for p in paths]

    def read(frames):
        for frame in frames:
            yield frame.assign(stats=[footer_stats(p) for p in frame.path])

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths) // 16, 200)))
    found = dict(files.mapInPandas(read, "path string, stats string").collect())  # a row a file, as the commit has
    return [found[p] for p in paths]


def _queried(spark: SparkSession, table: Table, folder: str, snapshot: Snapshot) -> dict[str, str]:
    """Statistics of each file below a folder that only Spark can open, by one aggregation over them; by the files' names."""
    stored = T.StructType([f for f in snapshot.schema if f.name not in snapshot.metadata.partitions])
    flat = [f.name for f in list(stored)[:32] if not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.BooleanType, T.BinaryType))]
    asked = [F.count(F.lit(1))] + [a for n in flat for c in (F.col(f"`{n}`"),) for a in (F.min(c), F.max(c), F.count_if(c.isNull()))]
    df = spark.read.schema(stored).option("recursiveFileLookup", "true").parquet(table.store.path(folder))
    found = {}
    for row in df.groupBy(F.col("_metadata.file_path").alias("__mr_file")).agg(*asked).collect():  # a row a file, as the commit has
        values = {n: tuple(row[2 + 3 * k : 5 + 3 * k]) for k, n in enumerate(flat)}
        bounds = {n: v for n, v in values.items() if v[0] is not None and v[0] == v[0] and v[1] == v[1]}
        stats = {"numRecords": row[1], "minValues": {n: written(v[0]) for n, v in bounds.items()}, "maxValues": {n: written(v[1]) for n, v in bounds.items()}, "nullCount": {n: v[2] for n, v in values.items()}}
        found[unquote(row[0]).rsplit(f"/{folder}/", 1)[1]] = json.dumps(stats)
    return found


def write_files(table: Table, snapshot: Snapshot, df: DataFrame, file_size: int | None = None) -> Written:
    """The rows as Parquet files in a folder of their own below the table; files without rows are left out.

    With file_size, rows are moved together or apart for files of about as many bytes (as shuffled, which is near what
    they take); without, every task writes its own.
    """
    names = snapshot.schema.names
    if missing := set(names) - set(df.columns):
        raise SchemaError(f"{table.uri}: the rows lack {', '.join(sorted(missing))}")
    partitions = [p for p in snapshot.metadata.partitions]
    folder = f"data-{uuid.uuid4().hex}"
    rows = df.select(*[F.col(f"`{n}`") for n in names])
    _write(rows, partitions, table.store.path(folder), file_size)
    made = Written()
    files = [f for f in table.store.listing(folder) if f[0].endswith(".parquet") and not f[0].rsplit("/", 1)[-1].startswith(("_", "."))]
    if table.store.local:
        told = _footers(df.sparkSession, [table.store.path(f"{folder}/{f[0]}") for f in files])
    else:
        queried = _queried(df.sparkSession, table, folder, snapshot) if files else {}
        told = [queried.get(f[0]) for f in files]  # none for a file without rows
    for (name, size, modified), stats in zip(files, told):
        if rows_of(stats):
            values = tuple((unquote(k), None if v == "__HIVE_DEFAULT_PARTITION__" else unquote(v)) for k, v in re.findall(r"([^/=]+)=([^/]*)/", name))
            made.adds.append(Add(f"{folder}/{name}", size, True, tuple(sorted(values)), stats, False, modified))
    return made


def commit(table: Table, base: Snapshot, offset: Offset | None, adds: list[Add], removes: list[Remove] = (), operation: str = "WRITE") -> int:
    """One version with everything in it.

    A commit that removes files holds for exactly the state it was planned on. An append goes to the
    next free version, unless the commits in between changed the table or recorded the same app_id.
    """
    version = base.version + 1
    actions = [r.action() for r in removes] + [a.action() for a in adds]
    actions = (offset.actions() if offset else [{"commitInfo": {"operation": operation}}]) + actions
    for _ in range(ATTEMPTS):
        try:
            table.write_commit(version, actions)
            table.maybe_checkpoint(version)
            return version
        except CommitConflict:
            if removes:
                raise
            other = table.commit(version)
            if other.metadata is not None and other.metadata.id != base.metadata.id or other.metadata is not None and other.metadata.schema != base.schema:
                raise LogError(f"{table.uri}: version {version} changed the table meanwhile") from None
            if offset and offset.app_id in other.txns:
                raise LogError(f"{table.uri}: another process commits as {offset.app_id}") from None
            version += 1
    raise CommitConflict(table.uri, version)


def append(table: Table, df: DataFrame | None, offset: Offset | None = None, file_size: int | None = None) -> tuple[int, int]:
    """(version, rows): rows and offset in one commit; without rows the offset alone."""
    base = table.snapshot()
    made = Written() if df is None else write_files(table, base, df, file_size)
    return commit(table, base, offset, made.adds), made.rows
