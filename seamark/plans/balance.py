"""Class balance, periods and sizes of the splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamark.functions.labels import percentage, split_label
from seamark.operators.histograms import equal_width_histogram, size_pairs, unit_histogram
from seamark.operators.profile import distinct_per_group
from seamark.operators.sampling import downsample_repeated, shuffled


def with_split(df: DataFrame, time: str, val_start: object, test_start: object) -> DataFrame:
    return df.withColumn("split", split_label(F.col(time), val_start, test_start))


def class_balance(df: DataFrame, label: str, by: Sequence[str] = ("split",)) -> DataFrame:
    """(by, total, class_1, class_0, percent_1, percent_0), of merged rows by their ``rows``."""
    rows = F.col("rows") if "rows" in df.columns else F.lit(1).cast("long")

    def count(condition: Column) -> Column:
        return F.sum(F.when(condition, rows).otherwise(0))

    counts = df.groupBy(*by).agg(
        F.sum(rows).alias("total"),
        count(F.col(label) == 1).alias("class_1"),
        count(F.col(label) == 0).alias("class_0"),
    )
    return counts.withColumns(
        {f"percent_{k}": percentage(F.col(f"class_{k}"), F.col("total")) for k in (1, 0)}
    )


def rebalanced(df: DataFrame, label: str, value: int, fraction: float, seed: int = 42) -> DataFrame:
    """A feature frame with an exact ``fraction`` of the rows of one class and all of the others, in random order.

    The rows need no key; on a fan-out frame most of them are copies.
    """
    return shuffled(downsample_repeated(df, F.col(label) == value, fraction, seed), seed)


def distinct_entities(df: DataFrame, key: str, by: Sequence[str] = ("split",)) -> DataFrame:
    return distinct_per_group(df, key, by)


def split_periods(df: DataFrame, time: str, val_start: str, test_start: str) -> DataFrame:
    """(split, first_day, last_day): from the data outside and up to the day before the next cut-off inside."""
    span = df.agg(F.to_date(F.min(time)).alias("lo"), F.to_date(F.max(time)).alias("hi"))
    val, test = (F.to_date(F.lit(x)) for x in (val_start, test_start))
    rows = F.array(
        F.struct(F.lit("train").alias("split"), F.col("lo").alias("first_day"), F.date_sub(val, 1).alias("last_day")),
        F.struct(F.lit("val").alias("split"), val.alias("first_day"), F.date_sub(test, 1).alias("last_day")),
        F.struct(F.lit("test").alias("split"), test.alias("first_day"), F.col("hi").alias("last_day")),
    )
    return span.select(F.inline(rows))


def size_profile(df: DataFrame, label: str, split: str = "split", bins: int = 40) -> dict[str, DataFrame]:
    """The data behind the size figures: shared unit bins per split, ``bins`` cells per split and class, points."""
    return {
        "length_units": unit_histogram(df, "length", [split]),
        "width_units": unit_histogram(df, "width", [split]),
        "length_classes": equal_width_histogram(df, "length", bins, [split, label]),
        "width_classes": equal_width_histogram(df, "width", bins, [split, label]),
        "points": size_pairs(df, "length", "width", [split, label]),
    }
