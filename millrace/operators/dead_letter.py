"""The data-quality table: rows that don't fit the target, with the reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.log import Snapshot, Table
from ..sources.sink import Offset, append
from .coerce import AT, REASON

SCHEMA = T.StructType(
    [
        T.StructField("app_id", T.StringType(), False),
        T.StructField("pipeline", T.StringType()),
        T.StructField("source_version", T.LongType(), False),
        T.StructField("column_name", T.StringType()),
        T.StructField("reason", T.StringType(), False),
        T.StructField("payload", T.StringType()),
        T.StructField("_timestamp", T.TimestampNTZType(), False),
    ]
)


def default_uri(target_uri: str) -> str:
    return target_uri.rstrip("/") + "__mr_dq"


def open_table(uri: str) -> Table | None:
    """None where there is no such table; one that can't be read is an error."""
    table = Table(uri)
    if not table.exists():
        return None
    table.snapshot()
    return table


def letters(rejects: DataFrame, app_id: str, pipeline: str, source_version: int) -> DataFrame:
    """Rows of the data-quality table; the payload is the row as JSON, nulls spelled out."""
    columns = [F.col(f"`{c}`") for c in rejects.columns if c not in (AT, REASON)]
    return rejects.select(
        F.lit(app_id).alias("app_id"),
        F.lit(pipeline).alias("pipeline"),
        F.lit(source_version).cast("long").alias("source_version"),
        F.col(AT).alias("column_name"),
        F.col(REASON).alias("reason"),
        F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("payload"),
        F.current_timestamp().cast("timestamp_ntz").alias("_timestamp"),
    )


def write(table: Table, rejects: DataFrame, app_id: str, pipeline: str, source_version: int) -> int:
    """Rows written, in a commit of its own; 0 where this version was written before."""
    own = f"{app_id}.dq"
    snapshot: Snapshot = table.snapshot()
    if snapshot.txns.get(own) == source_version:
        return 0
    return append(table, letters(rejects, app_id, pipeline, source_version), Offset(own, source_version))[1]
