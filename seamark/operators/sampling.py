"""Exact-fraction downsampling of one class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamark.operators.ranking import Running, Total, running

HASH_DIGITS = 4
#: Copies of a row that one step makes.
RUN = 65_536


def seeded_hash(keys: Sequence[str], seed: int) -> Column:
    """Hex text that is uniform over the keys and fixed by the seed."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def downsample(df: DataFrame, chosen: Column, fraction: float, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Keep ``round(fraction * rows)`` rows where ``chosen`` holds and all other rows.

    The kept rows are those with the smallest hashes of ``keys``, which must
    identify a row. Counts per leading hash digits tell where the cut falls:
    rows clearly below it pass a filter without any shuffle, and only the rows
    that share the digits of the cut are ranked.
    """
    picked = F.coalesce(chosen, F.lit(False))
    rows = df.withColumn("_hash", F.when(picked, seeded_hash(keys, seed)))
    rows = rows.withColumn("_band", F.substring("_hash", 1, HASH_DIGITS))
    bands = rows.where(F.col("_band").isNotNull()).groupBy("_band").agg(F.count("*").alias("_rows"))
    in_order = Window.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        bands.withColumn("_skip", F.coalesce(F.sum("_rows").over(in_order), F.lit(0)))
        .withColumn("_quota", F.rint(F.sum("_rows").over(Window.partitionBy()) * F.lit(fraction)).cast("long"))
        .where((F.col("_skip") <= F.col("_quota")) & (F.col("_quota") < F.col("_skip") + F.col("_rows")))
        .select(F.struct("_band", (F.col("_quota") - F.col("_skip")).alias("need")).alias("cut"))
        .scalar()
    )
    # Other classes have no band; without a band to cut the whole class is kept (fraction 1).
    whole = rows.where(F.col("_band").isNull() | cut.isNull() | (F.col("_band") < cut["_band"]))
    rank = F.row_number().over(Window.partitionBy("_band").orderBy("_hash", *keys))
    edge = rows.where(F.col("_band") == cut["_band"]).withColumn("_rank", rank).where(F.col("_rank") <= cut["need"])
    return whole.select(*df.columns).unionByName(edge.select(*df.columns))


def downsample_repeated(df: DataFrame, chosen: Column, fraction: float, seed: int = 42) -> DataFrame:
    """``downsample`` for rows that nothing identifies: keep ``round(fraction * rows)`` of the chosen ones and all others.

    Equal rows stand for one another, so they are counted, the counts run along
    the hashes of the rows, and the row at the cut is repeated as often as is still
    needed. Equal rows thereby never meet in one place, however many there are.
    """
    columns = df.columns
    picked = df.where(F.coalesce(chosen, F.lit(False)))
    content = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    counted = picked.groupBy(*columns).agg(F.count(F.lit(1)).alias("_rows"))
    counted = counted.withColumn("_hash", F.md5(F.concat_ws(":", F.lit(str(seed)), content)))
    placed = running(
        counted,
        {"_before": Running("sum", "_rows", before=True), "_all": Total("sum", "_rows")},
        by=[],
        order=["_hash", *columns],
        slice_=F.substring("_hash", 1, HASH_DIGITS),
    )
    quota = F.rint(F.col("_all") * F.lit(fraction)).cast("long")
    taken = F.least(F.col("_rows"), quota - F.col("_before"))
    kept = placed.withColumn("_taken", taken).where("_taken > 0")
    repeated = kept.select(*columns, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_taken - 1) DIV {RUN}"))).alias("_run"), "_taken")
    # Runs of copies first, so that a row taken very often makes no long array.
    copies = F.least(F.lit(RUN).cast("long"), F.col("_taken") - F.col("_run") * RUN)
    out = repeated.select(*columns, F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).select(*columns)
    return out.unionByName(df.where(~F.coalesce(chosen, F.lit(False))))


def downsample_fast(df: DataFrame, label: str, value: int, fraction: float, seed: int = 42) -> DataFrame:
    """About ``fraction`` of the rows of one class, in one pass over the data."""
    kept = (F.col(label) != value) | F.col(label).isNull() | (F.rand(seed) < fraction)
    return df.where(kept)


def shuffled(df: DataFrame, seed: int = 42) -> DataFrame:
    return df.orderBy(F.rand(seed))
