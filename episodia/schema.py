"""Telemetry schema, drift guard and time helpers."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

US_PER_DAY = 86_400_000_000


def us(column: str | Column = "ts") -> Column:
    """Microseconds since the epoch of a timestamp with or without zone (sessions run in UTC)."""
    return F.unix_micros((F.col(column) if isinstance(column, str) else column).cast("timestamp"))


def from_us(column: str | Column) -> Column:
    return F.timestamp_micros(F.col(column) if isinstance(column, str) else column)


def no_nan(column: str | Column) -> Column:
    """Missing is NULL, never NaN: Spark orders NaN above all numbers."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(~F.isnan(c), c)


def with_fields(df: DataFrame, *names: str) -> T.StructType:
    """df's schema and further double columns (a schema object is shared, so it is never added to in place)."""
    return T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])


def plan_table(spark: SparkSession, rows: Sequence[tuple], ddl: str) -> DataFrame:
    """A table of a handful of rows without NaN, as createDataFrame() makes it, but read in one task without Python workers."""

    def named(value, kind: T.DataType):
        if value is None or not isinstance(kind, (T.StructType, T.ArrayType)):
            return value
        if isinstance(kind, T.ArrayType):
            return [named(v, kind.elementType) for v in value]
        return {f.name: named(v, f.dataType) for f, v in zip(kind.fields, value, strict=True)}

    whole = T.ArrayType(T.StructType.fromDDL(ddl))
    text = json.dumps(named(rows, whole), allow_nan=False)
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(text), whole)))


def guard_columns(df: DataFrame, known: Iterable[str], keys: Sequence[str] = ("asset_id", "scope_id", "ts", "us", "regime")) -> None:
    """Raise for columns that no list names."""
    if unknown := sorted(set(df.columns) - set(known) - set(keys)):
        raise ValueError(f"columns that no list names: {', '.join(unknown)}")


def need_columns(df: DataFrame, wanted: Iterable[str]) -> None:
    if missing := sorted(set(wanted) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")


def duplicate_times(df: DataFrame, by: Sequence[str] = ("asset_id",)) -> DataFrame:
    """(by, ts) that occur more than once; ordered operators need them unique."""
    return df.groupBy(*by, "ts").count().where("count > 1")
