"""A table's log as a structured stream of its files, for jobs that are built on readStream.

The stream carries the files of each commit (version, path, size), not their rows: rows are read
in foreachBatch, by Spark's own Parquet reader (`rows_of_batch`). Where a target is named, the stream
begins behind what the target's log says is committed under an app_id, so the
stream's own checkpoint may be thrown away at any time.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..sources.log import Table
from ..sources.scan import read_files
from ..sources.sink import resume_version
from ..sources.stream import Cursor, LogStream, Policy, parse_bytes

NAME = "millrace_log"


class LogFiles(DataSource):
    """Options: uri, startingVersion, changePolicy, maxFilesPerTrigger, maxBytesPerTrigger, targetUri, appId."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "version bigint, path string, size bigint"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return LogFilesReader({k.lower(): v for k, v in self.options.items()})


class LogFilesReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.uri = options["uri"]
        self.start = int(options.get("startingversion", 0))
        self.policy = Policy(options.get("changepolicy", "fail"))
        self.max_files, self.max_bytes = int(options.get("maxfilespertrigger", 1000)), parse_bytes(options.get("maxbytespertrigger", "256MB"))
        self.target, self.app_id = options.get("targeturi"), options.get("appid")

    def initialOffset(self) -> dict:
        own = resume_version(Table(self.target).snapshot(), self.app_id) if self.target and self.app_id else None
        return {"version": self.start if own is None else own}

    def _stream(self, start: dict) -> LogStream:
        return LogStream(Table(self.uri), Cursor(start["version"]), self.policy, self.max_files, self.max_bytes)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        stream = self._stream(start)
        batch = stream.next_batch()
        files = [(v, a.path, a.size) for v, a in batch.files] if batch else []
        return iter(files), {"version": stream.cursor.version}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The same files again, after a restart."""
        stream, files = self._stream(start), []
        while stream.cursor.version < end["version"] and (batch := stream.next_batch()):
            files += [(v, a.path, a.size) for v, a in batch.files if v < end["version"]]
        return iter(files)

    def commit(self, end: dict) -> None:
        pass


def files_stream(spark: SparkSession, uri: str, **options) -> DataFrame:
    """The stream of a table's files."""
    spark.dataSource.register(LogFiles)
    made = spark.readStream.format(NAME).option("uri", uri)
    for k, v in options.items():
        made = made.option(k, str(v))
    return made.load()


def rows_of_batch(spark: SparkSession, uri: str, files: DataFrame) -> DataFrame:
    """The rows of one batch of files_stream, in foreachBatch; the batch is as small as its trigger's limits make it."""
    table = Table(uri)
    listed = [(r.version, r.path) for r in files.collect()]
    by_version = {v: {a.path: a for a in table.commit(v).adds} for v in {v for v, _ in listed}}
    snapshot = table.snapshot(max(by_version, default=None))
    return read_files(spark, table, [(v, by_version[v][p]) for v, p in listed], snapshot.schema, snapshot.metadata.partitions)
