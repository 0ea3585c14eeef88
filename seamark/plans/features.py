"""Labelled geometry features at the n-th message."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamark.functions.labels import equals_label, member_label
from seamark.functions.times import hour_number
from seamark.operators.joins import fan_out
from seamark.operators.ranking import nth_row
from seamark.plans.build import in_period
from seamark.schema import OFFSETS


def nth_times(positions: DataFrame, n: int, start: object = None, end: object = None, key: str = "mmsi", time: str = "timestamp") -> DataFrame:
    """(key, nth_timestamp): the n-th value of each key inside the period, once per key that has one."""
    rows = in_period(positions.select(key, time).where(F.col(key).isNotNull()), start, end, time)
    nth = nth_row(rows, n, by=[key], order=[time], slice_=hour_number(F.col(time)))
    return nth.withColumnRenamed(time, "nth_timestamp")


def nth_geometry_features(
    positions: DataFrame,
    ships: DataFrame,
    details: DataFrame,
    n: int,
    start: object = None,
    end: object = None,
    key: str = "mmsi",
    time: str = "timestamp",
    target: str = "shiptype",
    columns: Sequence[str] = OFFSETS,
    label: Column | None = None,
    merged: bool = False,
) -> DataFrame:
    """(key, target label, offsets, nth_timestamp), one row for every detail message of a ship that reaches n.

    ``merged`` gives equal rows once, with their number in ``rows``. The details are
    then counted per ship and offsets before the join: a ship has few different
    offsets, so the join moves a sliver of the messages and no ship is a hot key.

    Rows with any null are dropped before the label is made. The default label is
    1 for cargo ships and tankers; pass ``cargo_only()`` for cargo against the rest.
    """
    nth = nth_times(positions, n, start, end, key, time)
    label = member_label(F.col(target)) if label is None else label
    extra = []
    if merged:
        details = details.select(key, *columns).na.drop("any", subset=list(columns)).groupBy(key, *columns).agg(F.count("*").alias("rows"))
        extra = ["rows"]
    rows = fan_out(nth.join(ships.select(key, target), key), details, key, [*columns, *extra])
    rows = rows.select(key, target, *columns, "nth_timestamp", *extra).na.drop("any")
    return rows.withColumn(target, label)


def cargo_only(target: str = "shiptype") -> Column:
    return equals_label(F.col(target), "Cargo")


def nth_mode_features(
    positions: DataFrame,
    ships: DataFrame,
    n: int,
    columns: Sequence[str],
    start: object = None,
    end: object = None,
    key: str = "mmsi",
    time: str = "timestamp",
    target: str = "shiptype",
) -> DataFrame:
    """The same with one row per ship, from its own columns, so busy ships weigh no more than others."""
    nth = nth_times(positions, n, start, end, key, time)
    rows = nth.join(ships.select(key, target, *columns), key).na.drop("any")
    return rows.select(key, member_label(F.col(target)).alias(target), *columns, "nth_timestamp")


def with_size(df: DataFrame) -> DataFrame:
    """Add length (bow + stern) and width (port + starboard); null when a part is."""
    return df.withColumns(
        {
            "length": F.col("to_bow") + F.col("to_stern"),
            "width": F.col("to_port") + F.col("to_starboard"),
        }
    )
