"""Exact medians, quantiles and modes from one shared table of value counts.

``value_counts`` unpivots the columns and counts equal values before the
shuffle, so what moves grows with the number of distinct values. A quantile is
then found as a rank: counts per slice say which slice holds it, and only that
slice is put in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamark.operators.ranking import PART, ROWS, SLICE, TARGET, finite, first_row, grid, spread, with_part, with_row
from seamark.session import write_out

CELLS = 4096


def value_counts(
    df: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = (),
    bounds: tuple[float, float] | None = None,
    cells: int = CELLS,
) -> DataFrame:
    """(by, column, slice, value, n) of numeric columns, with one row of ``n`` 0 for the nulls of a group.

    A null key is a group like any other. Readers tell the null rows by ``n``, an
    aggregate, so no reader's filter moves below the shuffle and all share it.
    ``bounds``, where most values lie, save the pass that looks up the extremes.
    """
    if bounds:
        placed = df
        edges = {c: tuple(F.lit(float(b)) for b in bounds) for c in columns}
    else:
        placed = with_row(df.select(*by, *columns), spread(df, columns), "_spread")
        edges = {c: (F.col(f"_spread.lo_{c}"), F.col(f"_spread.hi_{c}")) for c in columns}
    entries = []
    for c in columns:
        value = F.col(c).cast("double")
        cell = grid(value, *edges[c], cells)
        entries.append(F.struct(F.lit(c).alias("column"), cell.alias(SLICE), value.alias("value")))
    return (
        placed.select(*by, F.inline(F.array(*entries)))
        .groupBy(*by, "column", SLICE, "value")
        .agg(F.count("value").alias("n"))
    )


def quantiles_of(counts: DataFrame, probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, column, q) with ``q`` an array: linear interpolation between neighbours.

    The cells that hold the wanted ranks are cut into cells of their own range
    before anything is put in order, so values far from all others, which leave the
    rest in one cell, leave it in thousands of finer ones.
    """
    keys = [*by, "column"]
    counts = counts.where(F.col("n") > 0)
    total = F.sum("_here").over(Window.partitionBy(*keys))
    wanted = []
    for i, p in enumerate(probabilities):
        place = F.lit(float(p)) * (F.col("_total") - 1)
        for side, rank in enumerate((F.floor(place), F.ceil(place))):
            wanted.append(
                F.struct(
                    F.lit(2 * i + side).alias("slot"),
                    rank.cast("long").alias("rank"),
                    (place - F.floor(place)).alias("weight"),
                )
            )
    value = finite(F.col("value"))
    per_slice = counts.groupBy(*keys, SLICE).agg(
        F.sum("n").alias("_here"), F.min(value).alias("_lo"), F.max(value).alias("_hi")
    )
    asked = per_slice.withColumn("_total", total).withColumn("_wanted", F.array(*wanted))
    holding = _holding(asked.withColumn("_from", F.lit(0).cast("long")), keys, SLICE)
    cells = (
        with_part(counts, [*keys, SLICE])
        .join(with_part(holding, [*keys, SLICE]).select(PART, "_lo", "_hi", "_wanted", F.col("_skip").alias("_from")), PART)
        .drop(PART)
        .withColumn("_cell", grid(F.col("value"), F.col("_lo"), F.col("_hi"), CELLS))
    )
    fine = [*keys, SLICE]
    per_cell = cells.groupBy(*fine, "_cell").agg(
        F.sum("n").alias("_here"), F.any_value("_from").alias("_from"), F.any_value("_wanted").alias("_wanted")
    )
    narrow = with_part(_holding(per_cell, fine, "_cell"), [*fine, "_cell"]).select(PART, "_skip", "_wanted")
    inside = Window.partitionBy(PART).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        with_part(cells.drop("_wanted"), [*fine, "_cell"])
        .join(narrow, PART)
        .withColumn("_upto", F.col("_skip") + F.sum("n").over(inside))
        .select(*keys, "value", "_upto", "n", F.explode("_wanted").alias("_w"))
        .where((F.col("_w.rank") < F.col("_upto")) & (F.col("_w.rank") >= F.col("_upto") - F.col("n")))
        .groupBy(*keys)
        .agg(
            *[F.max(F.when(F.col("_w.slot") == s, F.col("value"))).alias(f"_v{s}") for s in range(len(wanted))],
            *[
                F.max(F.when(F.col("_w.slot") == 2 * i, F.col("_w.weight"))).alias(f"_f{i}")
                for i in range(len(probabilities))
            ],
        )
    )

    def between(low: Column, high: Column, weight: Column) -> Column:
        # Of equal neighbours, infinite ones included, no difference is taken.
        return F.when((low == high) | (weight == 0), low).otherwise(low + (high - low) * weight)

    q = [between(F.col(f"_v{2 * i}"), F.col(f"_v{2 * i + 1}"), F.col(f"_f{i}")) for i in range(len(probabilities))]
    return found.select(*keys, F.array(*q).alias("q"))


def _holding(counted: DataFrame, keys: Sequence[str], slice_: str) -> DataFrame:
    """The slices of ``counted(keys, slice, _here, _from, _wanted)`` that hold a wanted rank, ``_skip`` being what lies before them."""
    earlier = Window.partitionBy(*keys).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("_skip", F.col("_from") + F.coalesce(F.sum("_here").over(earlier), F.lit(0)))
    here = F.filter(
        "_wanted", lambda w: (w["rank"] >= F.col("_skip")) & (w["rank"] < F.col("_skip") + F.col("_here"))
    )
    return placed.withColumn("_wanted", here).where(F.size("_wanted") > 0)


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    bounds: tuple[float, float] | None = None,
) -> DataFrame:
    """Exact quantiles of several numeric columns, per group or of the whole table."""
    return quantiles_of(value_counts(df, columns, by, bounds), probabilities, by)


def modes_of(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, column, value): the most frequent value, the smallest one of equals, null where all values are."""
    keys = [*by, "column"]
    best = first_row(counts, by=keys, order=[F.desc("n"), F.asc("value")])
    return best.select(*keys, "value")


def grouped_mode(df: DataFrame, column: str, by: Sequence[str], name: str) -> DataFrame:
    """Most frequent value of one column of any type; nulls do not count."""
    counted = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_n"))
    best = first_row(counted, by=by, order=[F.desc("_n"), F.asc(column)])
    return best.select(*by, F.col(column).alias(name))


def medians_and_modes(
    df: DataFrame, columns: Sequence[str], key: str, bounds: tuple[float, float] | None = None
) -> DataFrame:
    """One row per key: ``median_x`` (double) and ``mode_x`` for each column, null where all values are.

    Both statistics read the same exchange of value counts.
    """
    return medians_and_modes_of(value_counts(df, columns, [key], bounds), columns, key)


def with_slices(counts: DataFrame, bounds: tuple[float, float], cells: int = CELLS) -> DataFrame:
    """Counts of values, summed up elsewhere, as ``value_counts`` gives them."""
    return counts.withColumn(SLICE, grid(F.col("value"), F.lit(float(bounds[0])), F.lit(float(bounds[1])), cells))


def medians_and_modes_of(counts: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    medians = quantiles_of(counts, [0.5], [key]).select(
        key, F.concat(F.lit("median_"), F.col("column")).alias("name"), F.col("q")[0].alias("value")
    )
    modes = modes_of(counts, [key]).select(key, F.concat(F.lit("mode_"), F.col("column")).alias("name"), "value")
    names = [f"{kind}_{c}" for kind in ("median", "mode") for c in columns]
    wide = medians.unionByName(modes)
    return wide.groupBy(key).agg(*[F.max(F.when(F.col("name") == x, F.col("value"))).alias(x) for x in names])


def medians_and_modes_by_key(
    counts: DataFrame, columns: Sequence[str], key: str, bounds: tuple[float, float], target: int = TARGET
) -> DataFrame:
    """``medians_and_modes`` from stored rows (key, column, value, n), of which several may count the same value.

    Keys are read and counted first. Those of at most ``target`` rows each meet in one task, all of them in
    one shuffle by the key, and are put in order as they are; only the others, at most a ``target``-th of
    the rows in number, are cut into slices. Values are neither null nor NaN, and ``n`` is above 0.
    """
    counted = counts.groupBy(key).agg(F.count(F.lit(1)).alias(ROWS)).where(F.col(ROWS) > target)
    busy = write_out(counted.select(F.col(key).alias(PART)), "busy-keys")
    if busy.isEmpty():
        return _in_order(counts, columns, key)
    met = F.col(key).eqNullSafe(F.col(PART))
    large = counts.join(busy, met, "left_semi").groupBy(key, "column", "value").agg(F.sum("n").alias("n"))
    sliced = medians_and_modes_of(with_slices(large, bounds), columns, key)
    return _in_order(counts.join(busy, met, "left_anti"), columns, key).unionByName(sliced)


def _in_order(counts: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Everything of a key is found in the task that one shuffle by the key brings it to."""
    keys = [key, "column"]
    summed = counts.repartition(key).groupBy(*keys, "value").agg(F.sum("n").alias("n"))
    inside = Window.partitionBy(*keys).orderBy("value")
    upto = F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    placed = summed.withColumns({"_upto": upto, "_total": F.sum("n").over(Window.partitionBy(*keys))})
    last = F.col("_total") - 1

    def at(rank: Column) -> Column:
        return F.when((rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("n")), F.col("value"))

    low, high = at(F.floor(last / 2)), at(F.ceil(last / 2))
    rows = placed.select(*keys, low.alias("_low"), high.alias("_high"), F.struct((-F.col("n")).alias("n"), "value").alias("_mode"))

    def of(c: str, name: str) -> Column:
        return F.when(F.col("column") == c, F.col(name))

    found = [
        *[F.max(of(c, name)).alias(f"{name}_{c}") for c in columns for name in ("_low", "_high")],
        *[F.min(of(c, "_mode"))["value"].alias(f"mode_{c}") for c in columns],
    ]
    ends = [(c, F.col(f"_low_{c}"), F.col(f"_high_{c}")) for c in columns]
    # Of equal neighbours, infinite ones included, no difference is taken.
    middle = [F.when(low == high, low).otherwise(low + (high - low) * 0.5).alias(f"median_{c}") for c, low, high in ends]
    return rows.groupBy(key).agg(*found).select(key, *middle, *[f"mode_{c}" for c in columns])
