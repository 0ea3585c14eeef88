"""Profiles of tables and columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamark.functions.times import component_vector, second_number
from seamark.operators.quantiles import exact_quantiles
from seamark.operators.ranking import PART, with_part
from seamark.operators.reduction import sieve, sift

QUARTILES = [0.0, 0.25, 0.5, 0.75, 1.0]
TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def null_profile(df: DataFrame) -> DataFrame:
    """(column, data_type, nulls), from one aggregate over the table."""
    counts = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in df.columns])
    entries = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.col(f.name).alias("nulls"),
        )
        for f in df.schema.fields
    ]
    return counts.select(F.inline(F.array(*entries)))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(df.columns)).cast("long"))


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def time_span(df: DataFrame, time: str) -> DataFrame:
    return df.agg(F.min(time).alias("first_time"), F.max(time).alias("last_time"))


def database_span(tables: Mapping[str, DataFrame], times: Mapping[str, str | None]) -> DataFrame:
    """First and last time over all timed tables; each table is reduced before the union."""
    spans = [time_span(tables[name], column) for name, column in times.items() if column]
    out = spans[0]
    for span in spans[1:]:
        out = out.unionByName(span)
    return out.agg(F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The ``n`` most frequent values."""
    return value_counts(df, column).orderBy(F.desc("n"), F.asc(column)).limit(n)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def distinct_per_group(df: DataFrame, column: str, by: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct values per group: exact through a two-step count, or a bounded sketch."""
    if approximate:
        return df.groupBy(*by).agg(F.approx_count_distinct(column).alias("n_distinct"))
    return df.select(*by, column).distinct().groupBy(*by).agg(F.count(column).alias("n_distinct"))


def numeric_summary(df: DataFrame, column: str) -> DataFrame:
    """Range, mean and sample deviation of a target."""
    return df.agg(
        F.min(column).alias("min"),
        F.max(column).alias("max"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
    )


def numeric_stats(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, column, n, mean, std, q): population deviation and exact quartiles of the non-null values."""
    moments = df.groupBy(*by).agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.count(c).alias("n"),
                F.avg(F.col(c).cast("double")).alias("mean"),
                F.stddev_pop(F.col(c).cast("double")).alias("std"),
            ).alias(f"_{c}")
            for c in columns
        ]
    )
    moments = moments.select(*by, F.inline(F.array(*[f"_{c}" for c in columns])))
    keys = [*by, "column"]
    quartiles = with_part(exact_quantiles(df, columns, QUARTILES, by), keys).select(PART, "q")
    return with_part(moments, keys).join(quartiles, PART, "left").drop(PART)


def categorical_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) over text forms of the values; sort by ``n`` to read it."""
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return (
        df.select(F.inline(entries)).where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))
    )


def _from_seconds(seconds: Column) -> Column:
    zero = F.lit(0)
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(zero, zero, zero, seconds.cast("decimal(18,6)"))


def time_stats(df: DataFrame, time: str) -> DataFrame:
    """First and last year, and oldest, newest and median time as component vectors."""
    seconds = df.where(F.col(time).isNotNull()).select(second_number(F.col(time)).alias("seconds"))
    median = exact_quantiles(seconds, ["seconds"], [0.5]).select(F.floor(F.col("q")[0]).alias("m")).scalar()
    return df.agg(
        F.year(F.min(time)).alias("first_year"),
        F.year(F.max(time)).alias("last_year"),
        component_vector(F.min(time)).alias("oldest"),
        component_vector(F.max(time)).alias("newest"),
    ).withColumn("median", component_vector(_from_seconds(median)))


def _pairs(df: DataFrame, names: Mapping[str, str], value: str) -> DataFrame:
    """The items of a small dictionary about the columns, as rows."""
    rows = [F.struct(F.lit(k).alias("column"), F.lit(v).alias(value)) for k, v in names.items()]
    return df.sparkSession.range(1).select(F.inline(F.array(*rows)))


def semantic_types(
    df: DataFrame,
    keys: Sequence[str] = (),
    max_levels: int = 24,
    min_repeats: int = 5,
) -> DataFrame:
    """(column, semantic_type) by these rules, taken in order:

    keys are numerical (they become dense ids); times are timestamps; booleans
    are categorical; fractional numbers are numerical; an integer or text column
    is categorical when it has at most ``max_levels`` values that each occur at
    least ``min_repeats`` times, and numerical or text otherwise.

    A sketch of all columns in one pass shows which can have so few values, with
    far more room than it errs by; only the values of those are counted.
    """
    fixed, judged = {}, []
    for f in df.schema.fields:
        if f.name in keys:
            fixed[f.name] = "numerical"
        elif isinstance(f.dataType, TIMES):
            fixed[f.name] = "timestamp"
        elif isinstance(f.dataType, T.BooleanType):
            fixed[f.name] = "categorical"
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            fixed[f.name] = "numerical"
        elif isinstance(f.dataType, (T.IntegralType, T.StringType)):
            judged.append(f.name)
        else:
            fixed[f.name] = "text"
    out = _pairs(df, fixed, "semantic_type") if fixed else None
    if judged:
        other = {c: "text" if isinstance(df.schema[c].dataType, T.StringType) else "numerical" for c in judged}
        sketched = df.agg(*[F.approx_count_distinct(c, 0.03).alias(f"_{i}") for i, c in enumerate(judged)]).first()
        few = [c for i, c in enumerate(judged) if sketched[i] <= 2 * max_levels]
        counted = categorical_stats(df, few) if few else categorical_stats(df.limit(0), judged)
        levels = counted.groupBy("column").agg(F.count("*").alias("levels"), F.min("n").alias("least"))
        names = _pairs(df, other, "other")
        repeats = (F.col("levels") <= max_levels) & (F.col("least") >= min_repeats)
        found = names.join(levels, "column", "left").select(
            "column", F.when(repeats, F.lit("categorical")).otherwise(F.col("other")).alias("semantic_type")
        )
        out = out.unionByName(found) if out is not None else found
    return out


def seen_only(static: DataFrame, key: str, activity: Sequence[tuple[DataFrame, str]], reduced: bool = False) -> DataFrame:
    """Static rows whose key occurs in the given (table, column) pairs, for statistics that see training data only.

    With ``reduced``, for activity of many keys that have no static row, such activity goes before any shuffle.
    """
    keys, filter_ = None, sieve(static, [key]) if reduced else None
    for table, column in activity:
        one = table.select(F.col(column).alias(key)).where(F.col(key).isNotNull())
        one = (sift(one, filter_) if reduced else one).distinct()
        keys = one if keys is None else keys.unionByName(one)
    return static.join(keys.distinct(), key, "left_semi")
