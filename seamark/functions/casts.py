"""Text and number conversions with the rounding the relational tables expect."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def int_from_text(text: Column) -> Column:
    """Integer out of decimal text: half away from zero, anything unreadable is null."""
    return F.round(text.try_cast("double")).try_cast("int")


def int_from_number(number: Column) -> Column:
    """Integer out of a double: half to even; a value that does not fit raises."""
    return F.rint(number).cast("int")


def to_int(df: DataFrame, name: str) -> Column:
    """Safe integer cast of a column, by the type it has in the file."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return int_from_text(F.col(name))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.rint(F.col(name)).try_cast("int")
    return F.col(name).try_cast("int")


def parse_time(text: Column, pattern: str, strict: bool = True) -> Column:
    """Zone-less timestamp from text; bad text raises when strict, else is null."""
    if strict:
        return F.to_timestamp_ntz(text, F.lit(pattern))
    return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")


def timestamp(value: object) -> Column:
    """A bound given as text, date or datetime, as a zone-less timestamp literal."""
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp_ntz")


def not_null(column: Column, message: str) -> Column:
    """The column itself, or a failed job when a null turns up."""
    return F.when(column.isNull(), F.raise_error(F.lit(message))).otherwise(column)


def conform(
    df: DataFrame, target: T.StructType, values: Mapping[str, Column] | None = None, check: bool = True
) -> DataFrame:
    """Columns of ``target`` in order and with its types, checking its NOT NULL columns.

    Without ``check``, for rows checked when they were written, columns stay plain and filters on them reach the scan.

    A double that goes into an integer column is rounded half to even, as an
    INSERT into a declared table rounds it.
    """
    values = values or {}
    source = df.select([values.get(f.name, F.col(f.name)).alias(f.name) for f in target.fields])
    fractional = (T.FloatType, T.DoubleType, T.DecimalType)
    columns = []
    for f in target.fields:
        column = F.col(f.name)
        if isinstance(f.dataType, T.IntegerType) and isinstance(source.schema[f.name].dataType, fractional):
            column = int_from_number(column)
        elif source.schema[f.name].dataType != f.dataType:
            column = column.cast(f.dataType)
        if check and not f.nullable:
            column = not_null(column, f"{f.name} must not be null")
        columns.append(column.alias(f.name))
    return source.select(columns)


def add_missing(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add nullable columns that are not there yet."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def fill_text(df: DataFrame, columns: list[str], value: str = "Unknown") -> DataFrame:
    """Columns as text with ``value`` for what is missing."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(value)) for c in columns})


def float_features(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("float") for c in columns})
