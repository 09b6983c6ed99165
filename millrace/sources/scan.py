"""Reading listed files as one DataFrame."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SourceFileVacuumed
from .log import Add, Snapshot, Table

#: Column with the file that a row comes from.
FILE = "__mr_file"


def _nullable(kind: T.DataType) -> T.DataType:
    """Files are read as if anything could be null: what a target demands is checked by the coercion."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType), True) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_nullable(kind.elementType), True)
    if isinstance(kind, T.MapType):
        return T.MapType(_nullable(kind.keyType), _nullable(kind.valueType), True)
    return kind


def place_of(table: Table, path: str) -> str:
    """Where a file of the table is, as file_path has it once it is decoded; local ones without a scheme."""
    place = table.store.path(path)
    return "/" + place[5:].lstrip("/") if place.startswith("file:") else place


_DEFAULT = "__HIVE_DEFAULT_PARTITION__"


def _folder(name: str, value: str | None) -> str:
    """The folder of a partition value, as a writer names it."""
    return f"/{name}={_DEFAULT if value is None else value}/"


def _partition_columns(df: DataFrame, table: Table, files: list[Add], schema: T.StructType, partitions: tuple[str, ...]) -> DataFrame:
    """df with the files' partition values: from the folders of their paths where those say what the log says, else by a join on the path."""
    path = F.col("_metadata.file_path")
    wanted = [f for f in schema if f.name in partitions]
    values = [dict(a.partition_values) for a in files]
    if all(_folder(f.name, v.get(f.name)) in f"/{unquote(a.path)}" and (v.get(f.name) or "x").isascii() and "%" not in a.path for a, v in zip(files, values) for f in wanted):
        for f in wanted:
            text = F.url_decode(F.replace(F.regexp_extract(path, f"/{re.escape(f.name)}=([^/]*)/", 1), F.lit("+"), F.lit("%2B")))
            df = df.withColumn(f.name, F.nullif(text, F.lit(_DEFAULT)).cast(f.dataType))
        return df
    spark, at = df.sparkSession, "__mr_path"
    rows = [(place_of(table, a.path), *[v.get(f.name) for f in wanted]) for a, v in zip(files, values)]
    named = spark.createDataFrame(rows, T.StructType([T.StructField(at, T.StringType())] + [T.StructField(f.name, T.StringType()) for f in wanted]))
    named = named.select(at, *[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wanted])
    if sum(len(r[0]) + 100 for r in rows) <= BROADCAST_BYTES:
        named = F.broadcast(named)
    plain = F.url_decode(F.replace(F.regexp_replace(path, "^file:/+", "/"), F.lit("+"), F.lit("%2B")))
    return df.join(named, plain == F.col(at)).drop(at)


#: Bytes of paths and values up to which they are sent to every executor.
BROADCAST_BYTES = 64 << 20


def read_files(spark: SparkSession, table: Table, files: Iterable[tuple[int, Add]], schema: T.StructType, partitions: tuple[str, ...] = (), with_file: bool = False, ordered: bool = False) -> DataFrame:
    """Exactly these files, in the declared types, with partition values as typed columns.

    All files share one scan; with `ordered`, those of a version do, and the scans follow each other in the
    order of versions. A file that is gone is named with the version that added it.
    """
    schema = _nullable(schema)
    stored = T.StructType([f for f in schema if f.name not in partitions])
    groups: dict[int, list[tuple[int, Add]]] = {}
    for version, add in files:
        groups.setdefault(version if ordered else 0, []).append((version, add))
    parts = []
    for group in groups.values():
        try:
            df = spark.read.schema(stored).parquet(*[table.store.path(a.path) for _, a in group])
        except AnalysisException:
            for version, a in group:
                if not table.store.exists(a.path):
                    raise SourceFileVacuumed(table.uri, version, a.path) from None
            raise
        if with_file:
            df = df.withColumn(FILE, F.col("_metadata.file_path"))
        if partitions:
            df = _partition_columns(df, table, [a for _, a in group], schema, partitions)
        parts.append(df.select(*[F.col(f"`{f.name}`") for f in schema], *([F.col(FILE)] if with_file else [])))
    if not parts:
        wide = T.StructType([*schema, T.StructField(FILE, T.StringType())]) if with_file else schema
        return spark.createDataFrame([], wide)
    return reduce(DataFrame.unionAll, parts)


def read_snapshot(spark: SparkSession, table: Table, snapshot: Snapshot | None = None, columns: Iterable[str] | None = None) -> DataFrame:
    """All rows of a version; only `columns` are read where they are given."""
    snapshot = snapshot or table.snapshot()
    schema = snapshot.schema if columns is None else T.StructType([snapshot.schema[c] for c in columns])
    return read_files(spark, table, [(0, a) for a in snapshot.files.values()], schema, tuple(p for p in snapshot.metadata.partitions if p in schema.names))
