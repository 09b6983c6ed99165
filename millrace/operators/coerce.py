"""Bringing rows to the target's schema, which is fixed.

Columns are cast to the target's types and put in its order; columns that the
target doesn't have are dropped, a nullable one that the rows lack is null. Strictly,
a value that can't be cast, or a null where none may be, fails the batch. In the quarantining form such
rows are parted off with the first column at fault and the reason; nested columns stay strict there too, since
casting them leniently would put nulls inside of values.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError, SourceFileVacuumed
from ..sources.log import Add, Table

AT, REASON = "__mr_column", "__mr_reason"


def _nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StructType, T.ArrayType, T.MapType))


def _columns(df: DataFrame) -> dict[str, str]:
    return {c.lower(): c for c in df.columns}


def columns_present(df: DataFrame, target: T.StructType) -> list[str]:
    """The target columns that the rows have."""
    have = _columns(df)
    return [f.name for f in target if f.name.lower() in have]


def _checked(df: DataFrame, target: T.StructType) -> dict[str, str]:
    have = _columns(df)
    missing = [f.name for f in target if f.name.lower() not in have and not f.nullable]
    if missing:
        raise SchemaError(f"the rows lack {', '.join(missing)}, which may not be null in the target")
    if len({c.lower() for c in df.columns}) < len(df.columns):
        raise SchemaError("two columns of the rows have one name")
    return have


def _source(have: dict[str, str], name: str) -> Column:
    return F.col(f"`{have[name.lower()]}`")


def strict(df: DataFrame, target: T.StructType) -> DataFrame:
    """Rows as the target has them; evaluating it fails where a value doesn't fit."""
    have = _checked(df, target)
    out = []
    for f in target:
        if f.name.lower() not in have:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        value = _cast(df, _source(have, f.name), have[f.name.lower()], f)
        if not f.nullable:
            value = F.when(value.isNull(), F.raise_error(F.lit(f"{f.name} is null, which the target doesn't allow"))).otherwise(value)
        out.append(value.alias(f.name))
    return df.select(*out)


def _cast(df: DataFrame, value: Column, name: str, f: T.StructField) -> Column:
    """An ANSI cast whatever the session's setting: what can't be cast raises an error."""
    kind = df.schema[name].dataType
    if kind == f.dataType:
        return value
    if _nested(f.dataType) or _nested(kind):
        return value.cast(f.dataType)
    tried = value.try_cast(f.dataType)
    return F.when(value.isNotNull() & tried.isNull(), F.raise_error(F.concat(F.lit(f"{f.name}: can't cast to {f.dataType.simpleString()}: "), value.cast("string"))).cast(f.dataType)).otherwise(tried)


@dataclass
class Parted:
    """Rows with the first fault of each, if any: good ones in the target's schema, the others as they came."""

    marked: DataFrame
    target: T.StructType
    original: list[str]

    def good(self) -> DataFrame:
        return self.marked.filter(f"{AT} is null").select(*[F.col(f"__mr_{i}").alias(f.name) for i, f in enumerate(self.target)])

    def rejects(self) -> DataFrame:
        """The original columns, and the two about the fault."""
        return self.marked.filter(f"{AT} is not null").select(*[F.col(f"`{c}`") for c in self.original], AT, REASON)


def quarantining(df: DataFrame, target: T.StructType) -> Parted:
    """A lazy split. Persist `marked` before both sides are used, or the rows are computed twice."""
    have = _checked(df, target)
    made, at, reason = [], None, None
    for i, f in enumerate(target):
        if f.name.lower() not in have:
            made.append(F.lit(None).cast(f.dataType).alias(f"__mr_{i}"))
            continue
        value = _source(have, f.name)
        kind = df.schema[have[f.name.lower()]].dataType
        cast = value if kind == f.dataType else value.cast(f.dataType) if _nested(f.dataType) or _nested(kind) else value.try_cast(f.dataType)
        made.append(cast.alias(f"__mr_{i}"))
        faults = [(value.isNotNull() & cast.isNull(), f"can't be cast to {f.dataType.simpleString()}")]
        if not f.nullable:
            faults.append((cast.isNull(), "is null, which the target doesn't allow"))
        for condition, why in faults:
            at = F.when(condition, F.lit(f.name)) if at is None else at.when(condition, F.lit(f.name))
            reason = F.when(condition, F.lit(f"{f.name} {why}")) if reason is None else reason.when(condition, F.lit(f"{f.name} {why}"))
    nothing = F.lit(None).cast("string")
    marked = df.select("*", *made, (nothing if at is None else at).alias(AT), (nothing if reason is None else reason).alias(REASON))
    return Parted(marked, target, df.columns)


#: Types whose values Spark's reader takes as any later one of the same row.
_WIDENING = ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), (T.FloatType, T.DoubleType), (T.ByteType, T.ShortType, T.IntegerType, T.DoubleType))


def may_read_as(physical: T.DataType, declared: T.DataType) -> bool:
    """Whether a file's column of one type can be read as a declared one without changing its meaning.

    Spark's Parquet reader takes times of every unit as declared, and numbers as wider ones; the same holds for
    everything inside of structs, arrays and maps.
    """
    if isinstance(physical, T.StructType) and isinstance(declared, T.StructType):
        have = {f.name: f.dataType for f in physical}
        return all(f.name not in have or may_read_as(have[f.name], f.dataType) for f in declared)
    if isinstance(physical, T.ArrayType) and isinstance(declared, T.ArrayType):
        return may_read_as(physical.elementType, declared.elementType)
    if isinstance(physical, T.MapType) and isinstance(declared, T.MapType):
        return may_read_as(physical.keyType, declared.keyType) and may_read_as(physical.valueType, declared.valueType)
    if isinstance(physical, T.DecimalType) and isinstance(declared, T.DecimalType):
        return declared.scale >= physical.scale and declared.precision - declared.scale >= physical.precision - physical.scale
    times, kind, wanted = (T.TimestampType, T.TimestampNTZType), type(physical), type(declared)
    return kind is wanted or kind in times and wanted in times or any(kind in row and wanted in row[row.index(kind) :] for row in _WIDENING)


def refuse_unreadable(table: Table, files: list[tuple[int, Add]], schema: T.StructType) -> tuple[int, int]:
    """Raises SchemaError for the first column of a file that can't be read as declared; else (bytes stored, bytes decoded).

    Both come from the files' footers, of local stores; others give (0, 0) and are left to the reader.
    """
    stored = decoded = 0
    if not table.store.local:
        return 0, 0
    from pyspark.sql.pandas.types import from_arrow_type

    for version, add in files:
        try:
            with pq.ParquetFile(table.store.path(add.path)) as footer:
                physical, meta = footer.schema_arrow, footer.metadata
        except FileNotFoundError:
            raise SourceFileVacuumed(table.uri, version, add.path) from None
        stored += add.size
        decoded += sum(meta.row_group(g).total_byte_size for g in range(meta.num_row_groups))
        for f in schema:
            at = physical.get_field_index(f.name)
            if at < 0:
                continue
            try:
                kind = from_arrow_type(physical.field(at).type)
            except Exception:  # a type that Spark has no name for: the reader will say
                continue
            if not may_read_as(kind, f.dataType):
                raise SchemaError(f"{table.uri}: {f.name} is {kind.simpleString()} in {add.path}, of version {version}, but declared as {f.dataType.simpleString()}")
    return stored, decoded
