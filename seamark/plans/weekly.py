"""Activity per class and week.

Messages are counted per (key, week) first, so the join to the classes meets one
row per ship and week instead of every message, and a busy ship is no hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.functions.times import iso_week, iso_week_text, iso_year_week
from seamark.operators.ranking import every_kth_row
from seamark.plans.build import in_period


def per_class(counted: DataFrame, ships: DataFrame, key: str, target: str, weeks: Sequence[str]) -> DataFrame:
    """(target, weeks, count) of counts ``_n`` per ship and week."""
    classes = ships.select(key, target).where(F.col(target).isNotNull())
    return counted.join(classes, key).groupBy(target, *weeks).agg(F.sum("_n").alias("count"))


def weekly_counts(
    positions: DataFrame, ships: DataFrame, key: str = "mmsi", time: str = "timestamp", target: str = "shiptype"
) -> DataFrame:
    """(target, year_week, week_number, count) with weeks as text."""
    ts = F.col(time)
    counted = positions.groupBy(
        key, iso_year_week(ts).alias("year_week"), iso_week_text(ts).alias("week_number")
    ).agg(F.count("*").alias("_n"))
    return per_class(counted, ships, key, target, ["year_week", "week_number"])


def weekly_counts_every_kth(
    positions: DataFrame,
    ships: DataFrame,
    step: int = 500,
    start: object = None,
    end: object = None,
    key: str = "mmsi",
    time: str = "timestamp",
    target: str = "shiptype",
) -> DataFrame:
    """(target, week, count) over every ``step``-th message of each ship."""
    rows = in_period(positions.select(key, time).where(F.col(key).isNotNull()), start, end, time)
    kept = every_kth_row(rows, step, by=[key], order=[time], time=time)
    counted = kept.groupBy(key, iso_week(F.col(time)).alias("week")).agg(F.count("*").alias("_n"))
    return per_class(counted, ships, key, target, ["week"])


def weekly_pivot(counts: DataFrame, target: str, week: str, classes: Sequence[str] | None = None) -> DataFrame:
    """A row per week in order, a column per class, 0 where a class has no messages."""
    return counts.groupBy(week).pivot(target, classes).agg(F.sum("count")).na.fill(0).orderBy(week)


def class_totals(counts: DataFrame, target: str) -> DataFrame:
    return counts.groupBy(target).agg(F.sum("count").alias("total"))


def top_classes(counts: DataFrame, target: str, n: int = 4) -> DataFrame:
    return class_totals(counts, target).orderBy(F.desc("total"), F.asc(target)).limit(n)


def week_labels(counts: DataFrame, pivoted: DataFrame) -> DataFrame:
    """The weeks of a pivot with the short text shown for each."""
    names = counts.select("year_week", "week_number").dropDuplicates(["year_week"])
    return pivoted.join(names, "year_week")
