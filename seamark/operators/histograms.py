"""Histograms with the bin edges the profiles use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.operators.ranking import PART, finite, with_part, with_row

#: Bins that one row stands for before they are laid out.
RUN = 65_536


def unit_histogram(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, bin, n): counts in [bin, bin+1) from the column's minimum to its maximum, empty bins included.

    The edges come from the whole frame, so all groups share them. The number of
    bins is the range of the column, never the number of rows; they are made by a
    distributed range, so a far value makes many rows but no long array. A null
    key is a group like any other. NaN and infinities are in no bin.
    """
    value = finite(F.col(column).cast("double"))
    values = df.where(value.isNotNull()).withColumn("bin", F.floor(value).cast("long"))
    counted = values.groupBy(*by, "bin").agg(F.count("*").alias("n"))
    edges = counted.agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    groups = counted.select(*by).distinct() if by else counted.select(F.lit(1).alias("_all")).distinct()
    # Runs of bins first, spread over tasks, then the bins of each run.
    runs = with_row(groups, edges, "_edges").select(
        *by, "_edges", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_edges.hi - _edges.lo) DIV {RUN}"))).alias("_run")
    )
    first = F.col("_edges.lo") + F.col("_run") * RUN
    bins = runs.repartition("_run").select(
        *by, F.explode(F.sequence(first, F.least(first + RUN - 1, F.col("_edges.hi")))).alias("bin")
    )
    keys = [*by, "bin"]
    found = with_part(counted, keys).select(PART, "n")
    return with_part(bins, keys).join(found, PART, "left").select(*keys, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def equal_width_histogram(df: DataFrame, column: str, bins: int = 40, by: Sequence[str] = ()) -> DataFrame:
    """(by, bin, bin_start, bin_end, n): ``bins`` cells over each group's own range, the last edge inclusive.

    A group of one value gets a range one wide around it. A null key is a group like
    any other. NaN and infinities are in no bin.
    """
    value = finite(F.col(column).cast("double"))
    values = df.where(value.isNotNull()).select(*by, value.alias("_v")).groupBy(*by, "_v").agg(F.count("*").alias("_n"))
    spans = values.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    spans = spans.select(
        *by,
        F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
        F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"),
    )
    if by:
        joined = with_part(values, by).join(with_part(spans, by).drop(*by), PART)
    else:
        span = spans.select(F.struct("_lo", "_hi")).scalar()
        joined = values.withColumn("_lo", span["_lo"]).withColumn("_hi", span["_hi"])

    def edge(i):
        step = (F.col("_hi") - F.col("_lo")) / bins
        return F.when(i == bins, F.col("_hi")).otherwise(F.col("_lo") + i * step)

    last = F.lit(bins - 1)
    guess = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), last)
    joined = joined.withColumn("bin", guess)
    # A value next to an edge may be off by one cell in floating point; the edges decide.
    joined = joined.withColumn(
        "bin",
        F.when(F.col("_v") < edge(F.col("bin")), F.col("bin") - 1)
        .when((F.col("bin") < last) & (F.col("_v") >= edge(F.col("bin") + 1)), F.col("bin") + 1)
        .otherwise(F.col("bin")),
    )
    counted = joined.groupBy(*by, "bin").agg(F.sum("_n").alias("n"))
    grid = spans.select(*by, "_lo", "_hi", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    keys = [*by, "bin"]
    return with_part(grid, keys).join(with_part(counted, keys).select(PART, "n"), PART, "left").select(
        *keys,
        edge(F.col("bin")).alias("bin_start"),
        edge(F.col("bin") + 1).alias("bin_end"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"),
    )


def size_pairs(df: DataFrame, length: str, width: str, by: Sequence[str] = ()) -> DataFrame:
    """Points of a scatter figure with how many rows fall on each."""
    return df.groupBy(*by, length, width).agg(F.count("*").alias("n"))
