"""Summaries that merge: quantiles, distinct counts and frequent values from parts of a table.

A sketch of fixed size is made per group and day and stored; any period's answer is a merge
of stored sketches, without a new scan of the rows. Answers are approximate within a stated
bound; the exact operators stay the default everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamark.operators.profile import top_values
from seamark.session import write_out

#: Size parameter of the quantile sketches, and the logarithm of the registers of the distinct ones.
K, LG_K = 800, 14
#: Values that the sketch of frequent ones tracks.
TRACKED = 10_000


def quantile_error(k: int = K) -> float:
    """How far, as a share of all rows, a sketched quantile's rank is off, in 99 of 100 cases at most."""
    return 2.296 / k**0.9021


def distinct_error(lg_k: int = LG_K) -> float:
    """How far a sketched distinct count is off as a share of it: three standard deviations."""
    return 3 * 1.04 / 2 ** (lg_k / 2)


def day_sketches(
    df: DataFrame, time: str, numbers: Sequence[str] = (), kinds: Sequence[str] = (), by: Sequence[str] = (), k: int = K, lg_k: int = LG_K
) -> DataFrame:
    """(by, day, column, n, quantiles, distinct): sketches of each column per group and day, from one aggregate.

    Columns in ``numbers`` have quantiles, those in ``kinds`` distinct counts, and may be in both. ``n``
    counts the values; nulls, and NaN among numbers, are in no sketch. Rows without a time are the null day's.
    A sketch's size doesn't depend on the rows, so a group moves a few kilobytes per task.
    """

    def entry(c: str) -> Column:
        value = F.col(c).cast("double") if c in numbers else F.col(c)
        seen = F.when(~F.isnan(value), value) if c in numbers else value
        none = F.lit(None).cast("binary")
        text = F.col(c).cast("string")
        return F.struct(
            F.lit(c).alias("column"),
            F.count(seen).alias("n"),
            (F.kll_sketch_agg_double(seen, k) if c in numbers else none).alias("quantiles"),
            (F.hll_sketch_agg(text, lg_k) if c in kinds else none).alias("distinct"),
        )

    columns = list(dict.fromkeys([*numbers, *kinds]))
    day = F.to_date(F.col(time)).alias("day")
    made = df.groupBy(*by, day).agg(*[entry(c).alias(f"_{i}") for i, c in enumerate(columns)])
    return made.select(*by, "day", F.inline(F.array(*[f"_{i}" for i in range(len(columns))])))


def write_sketches(sketches: DataFrame, path: str) -> None:
    """One folder per day; days that are there already are replaced, others left alone."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def sketched_quantiles(sketches: DataFrame, probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, column, n, q) of stored sketches: each wanted quantile's rank is off by ``quantile_error`` at most."""
    merged = (
        sketches.where(F.col("quantiles").isNotNull() & (F.col("n") > 0))
        .groupBy(*by, "column")
        .agg(F.sum("n").alias("n"), F.kll_merge_agg_double("quantiles").alias("_all"))
    )
    ranks = F.array(*[F.lit(float(p)) for p in probabilities])
    return merged.select(*by, "column", "n", F.kll_sketch_get_quantile_double("_all", ranks).alias("q"))


def sketched_distinct(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, column, n, n_distinct) of stored sketches; the count is off by ``distinct_error`` of it at most."""
    merged = sketches.where(F.col("distinct").isNotNull()).groupBy(*by, "column")
    return merged.agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("n_distinct"))


def top_values_bounded(df: DataFrame, column: str, n: int = 10, tracked: int = TRACKED) -> DataFrame:
    """(column, n): the ``n`` most frequent values, as ``top_values`` has them, without a shuffle of all values if that can be proved.

    Every task keeps ``tracked`` candidates of the values it reads (Misra and Gries's
    way, in a built-in aggregate), the lists are merged, and the candidates are counted
    exactly in a second pass that moves their counts alone. No value that isn't a candidate is more frequent than
    3.5 / ``tracked`` of the rows, or than the last candidate's estimate. Where the n-th exact count is above that the
    candidates hold the answer; else all values are counted, as the answer needs it then.
    """
    rows = df.where(F.col(column).isNotNull()).select(column)
    sketch = rows.agg(F.expr(f"approx_top_k(`{column}`, {tracked // 4}, {tracked})").alias("top"), F.count(F.lit(1)).alias("n"))
    last_one = F.try_element_at("top", F.lit(-1))["count"]
    found = write_out(sketch.select("n", F.size("top").alias("size"), last_one.alias("last"), "top"), "candidates")
    total, size, last = found.select("n", "size", "last").first()
    if not total:
        return top_values(df, column, n)
    bound = max(3.5 * total / tracked, last if size >= tracked // 4 else 0)
    # ``tracked`` / 4 values at most.
    candidates = found.select(F.explode("top.item").alias(column))
    counted = rows.join(F.broadcast(candidates), column, "left_semi").groupBy(column).agg(F.count("*").alias("n"))
    best = write_out(counted.orderBy(F.desc("n"), F.asc(column)).limit(n), "top-values")
    kept = [r["n"] for r in best.select("n").collect()]
    proven = len(kept) == n and min(kept) > bound
    return best.orderBy(F.desc("n"), F.asc(column)) if proven else top_values(df, column, n)
