"""Running values and ranks that never gather a whole group in one task.

A group (a vessel, a class, a whole table) may hold a third of all rows, so a
window over the group alone is out. Every order column used here comes with a
*slice*: an expression that never decreases along the order (the hour of a
timestamp, the leading digits of a hash, an equal-width cell of a number).
Values are aggregated per (group, slice) with map-side combining, the small
result is accumulated per group, and the full rows only meet a window over
(group, slice), which the running value before the slice is joined to on the
same keys. One shuffle of the rows, no task larger than a slice.

Slices may be nested, finest first. Then the accumulation over fine slices goes
by the same scheme over coarse ones, for orders with very many slices.

Two ways give slices of a bounded size for any data. ``in_value_ranges`` writes rows in
ranges of their values between splitters that Spark draws from the data, for numbers
as for text. ``time_slices`` counts rows per (group, hour) and splits what is above a
target into minutes, seconds and instants, and an instant by the rest of the order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import takewhile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seamark.functions.times import micros
from seamark.session import write_out

AGGREGATES = {"sum": F.sum, "min": F.min, "max": F.max}
SLICE = "_slice"
SALT, SALTS, SALT_FROM = "_salt", 256, 16
GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"
PART = "_part"
#: Rows of a time slice above which it is split, and the widths it is split into, in microseconds.
TARGET, WIDTHS = 2_000_000, (3_600_000_000, 60_000_000, 1_000_000, 1)
ROWS = "_rows"
#: The instant of null times, before all others.
NO_TIME = -(1 << 62)
#: Splitters kept of each instant that is split, and the values drawn for each of them.
SPLITTERS, DRAWN = 255, 16


@dataclass(frozen=True)
class Running:
    """A running aggregate; without the current row when ``before`` is set."""

    how: str
    column: str
    before: bool = False


@dataclass(frozen=True)
class Total:
    """The aggregate of the whole group, on each of its rows."""

    how: str
    column: str


Slices = Column | Sequence[Column]


def running(
    df: DataFrame,
    values: Mapping[str, Running | Total],
    *,
    by: Sequence[str],
    order: Sequence[str | Column],
    slice_: Slices,
    per_slice: DataFrame | None = None,
) -> DataFrame:
    """Add running aggregates along ``order`` within the groups ``by``.

    A null group key is a group like any other, and rows with a null slice come first
    in their group, so ``order`` must put nulls first, as Spark does for ascending
    columns. For repeatable results it must be total within a group. ``per_slice`` brings the
    values per (by, slice), as ``_in_<name>``, where they are known already.
    """
    nested = [slice_] if isinstance(slice_, Column) else list(slice_)
    coarse = [f"{SLICE}_{i}" for i in range(1, len(nested))]
    rows = df.withColumns(dict(zip([SLICE, *coarse], nested)))
    if per_slice is None:
        per_slice = rows.groupBy(*by, SLICE, *coarse).agg(
            *[AGGREGATES[v.how](v.column).alias(f"_in_{name}") for name, v in values.items()]
        )
    carried = _carried(per_slice, values, by, coarse)
    inside = Window.partitionBy(PART).orderBy(*order)

    def total(name: str, v: Running | Total) -> Column:
        carry = F.col(f"_carry_{name}")
        if isinstance(v, Total):
            return carry
        frame = inside.rowsBetween(Window.unboundedPreceding, -1 if v.before else 0)
        here = AGGREGATES[v.how](v.column).over(frame)
        if v.how == "sum":
            return F.coalesce(carry, F.lit(0)) + F.coalesce(here, F.lit(0))
        return F.least(carry, here) if v.how == "min" else F.greatest(carry, here)

    joined = with_part(rows, [*by, SLICE]).join(with_part(carried, [*by, SLICE]).drop(*by, SLICE), PART)
    added = {name: total(name, v).alias(name) for name, v in values.items()}
    return joined.select(*[c for c in df.columns if c not in added], *added.values())


def with_part(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the keys as one struct. Structs with equal nulls are equal, so a join on it keeps rows with null keys."""
    return df.withColumn(PART, F.struct(*keys))


def _carried(
    per_slice: DataFrame, values: Mapping[str, Running | Total], by: Sequence[str], coarse: list[str]
) -> DataFrame:
    """(by, slice, _carry_x): what lies before each slice, or in the whole group."""
    if coarse:
        fine = per_slice.withColumnRenamed(SLICE, "_fine")
        inner = {
            f"_carry_{name}": Total(v.how, f"_in_{name}")
            if isinstance(v, Total)
            else Running(v.how, f"_in_{name}", before=True)
            for name, v in values.items()
        }
        slices = [F.col(c) for c in coarse]
        found = running(fine, inner, by=by, order=["_fine"], slice_=slices)
        return found.select(*by, F.col("_fine").alias(SLICE), *inner)
    group = Window.partitionBy(*by)
    earlier = group.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return per_slice.select(
        *by,
        SLICE,
        *[
            AGGREGATES[v.how](f"_in_{name}").over(group if isinstance(v, Total) else earlier).alias(f"_carry_{name}")
            for name, v in values.items()
        ],
    )


def row_ranks(
    df: DataFrame,
    name: str,
    *,
    by: Sequence[str],
    order: Sequence[str | Column],
    slice_: Slices | None = None,
    time: str | None = None,
    target: int = TARGET,
) -> DataFrame:
    """Rank of every row in its group, from 1.

    Either ``slice_`` is given, or ``time``, the first column of the order, whose slices are then split by
    counts until none has more than ``target`` rows; the order's other columns split equal times.
    """
    per_slice = None
    rows = df.withColumn("_one", F.lit(1).cast("long"))
    if slice_ is None:
        rest = list(takewhile(lambda c: isinstance(c, str), order[1:]))
        rows, per_slice = time_slices(rows, by, time, rest, target)
        per_slice = per_slice.withColumnRenamed(ROWS, f"_in_{name}")
        slice_ = F.col(SLICE)
    ranked = running(rows, {name: Running("sum", "_one")}, by=by, order=order, slice_=slice_, per_slice=per_slice)
    return ranked.select(*[c for c in df.columns if c != name], name)


def nth_row(
    df: DataFrame,
    n: int,
    *,
    by: Sequence[str],
    order: Sequence[str | Column],
    slice_: Column | None = None,
    limit: int | None = None,
) -> DataFrame:
    """The n-th row of every group, if it has one; null keys are a group, and null slices come first.

    Up to the optimiser's group limit every map task forwards at most ``n`` rows
    of a group, so ``row_number`` is the cheapest plan. A group present in very
    many tasks would still bring ``n`` rows from each together, so the rows are
    first limited per group and salt, which leaves ``SALTS * n`` of them. A larger
    ``n`` finds the slice that holds the row from counts and ranks that slice alone.
    ``limit`` stands for the optimiser's; both ways give the same rows.
    """
    if limit is None:
        limit = int(df.sparkSession.conf.get(GROUP_LIMIT, "1000"))
    if slice_ is None or n <= limit:
        rows = df
        if n >= SALT_FROM:
            # Any salt gives the same result, so it may differ when a task is run again.
            rows = df.withColumn(SALT, F.spark_partition_id() % SALTS)
            rank = F.row_number().over(Window.partitionBy(*by, SALT).orderBy(*order))
            rows = rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop(SALT)
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        return rows.withColumn("_rank", rank).where(F.col("_rank") == n).drop("_rank")
    rows = df.withColumn(SLICE, slice_)
    earlier = Window.partitionBy(*by).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    holding = (
        rows.groupBy(*by, SLICE)
        .agg(F.count("*").alias("_rows"))
        .withColumn("_skip", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .where((F.col("_skip") < n) & (F.col("_skip") + F.col("_rows") >= n))
        .select(F.struct(*by, SLICE).alias(PART), "_skip")
    )
    rank = F.row_number().over(Window.partitionBy(PART).orderBy(*order))
    return (
        with_part(rows, [*by, SLICE])
        .join(holding, PART)
        .withColumn("_rank", rank + F.col("_skip"))
        .where(F.col("_rank") == n)
        .select(*df.columns)
    )


def first_row(df: DataFrame, *, by: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per group, the first along a total order."""
    return nth_row(df, 1, by=by, order=order)


def every_kth_row(
    df: DataFrame,
    step: int,
    *,
    by: Sequence[str],
    order: Sequence[str | Column],
    slice_: Slices | None = None,
    time: str | None = None,
    target: int = TARGET,
) -> DataFrame:
    """Rows ``step``, ``2*step``, ... of every group; slices as for ``row_ranks``."""
    ranked = row_ranks(df, "_rank", by=by, order=order, slice_=slice_, time=time, target=target)
    return ranked.where(F.col("_rank") % step == 0).drop("_rank")


def with_row(df: DataFrame, row: DataFrame, name: str) -> DataFrame:
    """Add a one-row result as a struct column.

    A scalar subquery that several expressions refer to is planned once this way.
    """
    return df.withColumn(name, row.select(F.struct(*row.columns).alias(name)).scalar())


def spread(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the smallest and largest finite value of each column: ``lo_x`` and ``hi_x``."""
    edges = [(how, name, c) for c in columns for how, name in ((F.min, "lo"), (F.max, "hi"))]
    return df.agg(*[how(finite(F.col(c).cast("double"))).alias(f"{name}_{c}") for how, name, c in edges])


def finite(value: Column) -> Column:
    """The number, null for NaN and infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def grid(value: Column, low: Column, high: Column, cells: int) -> Column:
    """Equal-width cell of a number, growing with it; a single cell when there is no width.

    What lies below or above falls into cells of its own at the ends, and NaN, the largest value, into the last of all.
    """
    cell = F.width_bucket(finite(value), low, high, F.lit(cells).cast("long"))
    flat = F.when(value.isNull() | (value < low), 0).when(value > high, cells + 1).otherwise(1).cast("long")
    end = F.when(F.isnan(value), cells + 2).when(value == float("inf"), cells + 1).when(value == float("-inf"), 0)
    return F.coalesce(end.cast("long"), cell, flat)


def range_count(spark: SparkSession) -> int:
    """How many ranges rows are written in: the partitions that shuffles start with."""
    start = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    return int(start or spark.conf.get("spark.sql.shuffle.partitions"))


def in_value_ranges(df: DataFrame, columns: Sequence[str], name: str, ranges: int | None = None) -> DataFrame:
    """``df`` written in ranges of ``columns``, with the number of its range as ``name``, which grows with them.

    The splitters are drawn from the rows, so ranges hold about as many rows as one another,
    however the values lie: outliers on any scale, keys that begin alike. Rows of equal
    values share a range; nulls come first, NaN last. Writing fixes the ranges, so several
    results may be taken from them.
    """
    n = ranges or range_count(df.sparkSession)
    return write_out(df.repartitionByRange(n, *columns).withColumn(name, F.spark_partition_id().cast("long")), "ranges")


def positions(df: DataFrame, column: str, name: str, ranges: int | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """(column, columns, name): each row's place from 0 in the order of a column without repeated values.

    Rows are written in sorted ranges with their place inside; the counts of the ranges, one row
    each, are added up and give the places where ranges begin. No window over rows.
    """
    n = ranges or range_count(df.sparkSession)
    place = F.monotonically_increasing_id()  # the number of the partition and, in the lower 33 bits, of the row in it
    sorted_ = df.select(column, *columns).repartitionByRange(n, column).sortWithinPartitions(column).withColumn("_place", place)
    rows = write_out(sorted_, "ranges").withColumn("_range", F.shiftright("_place", 33))
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias(ROWS))
    before = F.sum(ROWS).over(Window.orderBy("_range")) - F.col(ROWS)
    starts = counts.select(F.col("_range").alias("_of"), before.alias("_before"))
    # One row per range: ``n`` rows, whatever the table's size.
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    found = rows.join(F.broadcast(starts), F.col("_range") == F.col("_of"))
    return found.select(column, *columns, (F.col("_before") + inside).alias(name))


def time_slices(
    df: DataFrame,
    by: Sequence[str],
    time: str,
    rest: Sequence[str] = (),
    target: int = TARGET,
    values: Mapping[str, Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(``df`` with ``SLICE``, the rows and ``values`` per (by, slice)): slices of one group and hour, or of less.

    Rows are counted per (group, hour). A slice of more than ``target`` rows is split into its
    minutes, of these into seconds, and those into single instants; at each step only rows of split
    slices are counted. An instant of more rows than that is split by the columns ``rest``, which
    follow the time in the order, between values drawn from its rows. Slices grow along
    (time, rest); null times are one instant, the first. Counts decide, so a busy key costs
    finer slices for itself alone; without one nothing is read twice. The lists of split slices have at
    most rows / target rows; Spark sees their size when it plans the joins with them.
    """
    at = F.coalesce(micros(F.col(time)), F.lit(NO_TIME))
    starts = [at - F.pmod(at, F.lit(w)) for w in WIDTHS]
    wanted = [F.count(F.lit(1)).alias(ROWS), *[v.alias(n) for n, v in (values or {}).items()]]
    counts = write_out(df.groupBy(*by, starts[0].alias(SLICE)).agg(*wanted), "slices")
    busy = [_busy(counts, by, target)]
    if busy[0].isEmpty():
        return df.withColumn(SLICE, starts[0]), counts
    slim = df.select(*by, time, *[c for c in rest if c not in by])
    for start, finer in zip(starts, starts[1:]):
        slim = with_part(slim.withColumn(SLICE, start), [*by, SLICE]).join(busy[-1], PART, "left_semi").drop(PART, SLICE)
        found = write_out(_busy(slim.groupBy(*by, finer.alias(SLICE)).agg(F.count(F.lit(1)).alias(ROWS)), by, target), "busy")
        if found.isEmpty():
            break
        busy.append(found)
    placed, chosen = df, starts[len(busy)] if len(busy) < len(starts) else at
    for k in reversed(range(len(busy))):
        marks = busy[k].withColumn(f"_busy_{k}", F.lit(True))
        placed = with_part(placed.withColumn(SLICE, starts[k]), [*by, SLICE]).join(marks, PART, "left").drop(PART, SLICE)
        chosen = F.when(F.col(f"_busy_{k}"), chosen).otherwise(starts[k])
    part = F.lit(0).cast("long")
    if len(busy) == len(starts) and rest:
        instants = with_part(slim.withColumn(SLICE, at), [*by, SLICE]).join(busy[-1], PART, "left_semi")
        share = F.pmod(F.xxhash64(PART, *rest), F.lit(1 << 30))
        # Drawn by a hash of the row, about SPLITTERS * DRAWN an instant; every DRAWN-th of them splits it.
        totals = instants.groupBy(PART).agg(F.count(F.lit(1)).alias(ROWS))
        drawn = instants.join(totals, PART).where(share < F.lit(float(SPLITTERS * DRAWN << 30)) / F.col(ROWS))
        lists = drawn.groupBy(PART).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("_all"))
        edges = write_out(lists.select(PART, F.filter("_all", lambda _, i: i % DRAWN == DRAWN - 1).alias("_edges")), "splitters")
        placed = with_part(placed.withColumn(SLICE, at), [*by, SLICE]).join(edges, PART, "left").drop(PART, SLICE)
        inside = F.col(f"_busy_{len(busy) - 1}") & F.col("_edges").isNotNull()
        part = F.when(inside, upper_bound(F.col("_edges"), F.struct(*rest))).otherwise(part)
    placed = placed.withColumn(SLICE, F.struct(chosen.alias("start"), part.alias("part"))).select(*df.columns, SLICE)
    return placed, placed.groupBy(*by, SLICE).agg(*wanted)


def _busy(counts: DataFrame, by: Sequence[str], target: int) -> DataFrame:
    return with_part(counts.where(F.col(ROWS) > target), [*by, SLICE]).select(PART)


def upper_bound(edges: Column, value: Column) -> Column:
    """How many of the sorted ``edges``, at most 2047, are not above the value, by bisection."""
    start = F.struct(F.lit(0).alias("lo"), F.size(edges).alias("hi"))

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["lo"] + state["hi"]) / 2).cast("int")
        done = state["lo"] >= state["hi"]
        above = F.get(edges, middle) > value
        return F.struct(
            F.when(done | above, state["lo"]).otherwise(middle + 1).alias("lo"),
            F.when(~done & above, middle).otherwise(state["hi"]).alias("hi"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(12)), start, halve)["lo"].cast("long")
