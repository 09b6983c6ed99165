"""Reading the input tables, and adding computed columns to a DataFrame batch by batch."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textvec import slices


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str | None]:
    return batch.column(column).to_pylist()


def place_of(name: str, columns: list[str]) -> int:
    """Of the column of that name, else of the first whose name differs in case only, as Spark finds it."""
    return columns.index(name) if name in columns else [c.lower() for c in columns].index(name.lower())


def release() -> None:
    """Hands freed memory back to the system: Python workers live on between tasks, and an executor has several."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def lean(run: Callable) -> Callable:
    """run for mapInArrow or applyInArrow, with release() after each task or group."""

    def mapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    def grouped(group: pa.Table) -> pa.Table:
        try:
            return run(group)
        finally:
            release()

    return grouped if getattr(run, "__annotations__", {}).get("group") is not None else mapped


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """df.mapInArrow(run, schema) for columns of any name, dots included."""
    names = df.columns

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(b.rename_columns(names) for b in batches)

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(lean(renamed), schema)


def fresh_name(name: str, columns: list[str]) -> str:
    """name, with underscores where a column has it, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def with_computed(docs: DataFrame, added: list[T.StructField], compute: Callable[[list[str | None]], list], column: str = "text", chars: int = 1_500_000) -> DataFrame:
    """docs with one column more for each of added, from compute(texts) -> one list or Arrow array per column.

    The column of texts is found whatever the case of its name; of several that differ in case, the one written as asked.
    Input columns that have the name of an added one are replaced, whatever
    their case; all others pass through untouched. Rows are handed over in
    runs of about `chars` characters, so that long texts don't add up in memory.
    """
    taken = {f.name.lower() for f in added}
    kept = docs.select(*[F.col(quoted(c)) for c in docs.columns if c.lower() not in taken])
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [(f.name, to_arrow_type(f.dataType)) for f in added]
    at = place_of(column, kept.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for first, last in slices(texts, chars):
                part = batch.slice(first, last - first)
                made = compute(texts[first:last])
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, (_, kind) in zip(made, kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*part.schema.names, *[n for n, _ in kinds]])

    return map_arrow(kept, run, T.StructType([*kept.schema.fields, *added]))
