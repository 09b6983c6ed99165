"""Running an accepted query over one batch."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from ..functions import json_text
from . import gate


class Transform(Protocol):
    """A stateless change of one batch."""

    def apply(self, batch: DataFrame, lookups: Mapping[str, DataFrame]) -> DataFrame: ...

    def describe(self) -> str: ...


class Identity:
    def apply(self, batch: DataFrame, lookups: Mapping[str, DataFrame] | None = None) -> DataFrame:
        return batch

    def describe(self) -> str:
        return "copy"


class SqlTransform:
    """One SELECT over `source` and declared lookups."""

    def __init__(self, spark: SparkSession, sql: str, lookups: tuple[str, ...] = (), grain: gate.Grain = gate.Grain.ROW):
        self.verdict = gate.check(spark, sql, grain, lookups)

    def apply(self, batch: DataFrame, lookups: Mapping[str, DataFrame] | None = None) -> DataFrame:
        """The lazy result; `batch` keeps its scan, so filters and columns reach the files."""
        session = batch.sparkSession.newSession()
        for key in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.advisoryPartitionSizeInBytes"):
            if (value := batch.sparkSession.conf.get(key, None)) is not None:
                session.conf.set(key, value)
        session.conf.set("spark.sql.session.timeZone", "UTC")
        session.conf.set("spark.sql.ansi.enabled", "true")
        json_text.register(session)
        _moved(batch, session).createOrReplaceTempView(gate.SOURCE)
        for name, df in (lookups or {}).items():
            _moved(df, session).createOrReplaceTempView(name)
        return session.sql(self.verdict.sql)

    def describe(self) -> str:
        return self.verdict.sql


def _moved(df: DataFrame, session: SparkSession) -> DataFrame:
    """The same plan in another session of the same context."""
    dataset = session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, df._jdf.queryExecution().logical())
    return DataFrame(dataset, session)


def run_sql(batch: DataFrame, sql: str, lookups: Mapping[str, DataFrame] | None = None, grain: gate.Grain = gate.Grain.ROW) -> DataFrame:
    """sql over batch, checked first."""
    return SqlTransform(batch.sparkSession, sql, tuple(lookups or ()), grain).apply(batch, lookups)
