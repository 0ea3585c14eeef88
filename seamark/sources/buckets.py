"""Catalog tables stored in buckets of a key, so that joins and first rows by the key move nothing.

A bucket is read by one task, and adaptive execution can't split it as it splits a shuffle. So a
key of more rows than a target is stored in several parts, each a bucket key of its own: tables
are bucketed by (key, ``part``), and rows that meet such a key stand once in each of its parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamark.session import write_out

#: Rows of a key in one part.
TARGET = 2_000_000
PART = "part"


def busy_keys(facts: DataFrame, key: str, target: int = TARGET) -> DataFrame:
    """(key, parts int): the keys of more than ``target`` rows, null among them, at most a ``target``-th of the rows in number.

    Counted with map-side combining and written, so that Spark knows its size when joins with it are planned.
    """
    counts = facts.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > target)
    return write_out(counts.select(key, F.ceil(F.col("rows") / target).cast("int").alias("parts")), "busy-keys")


def _with_parts(df: DataFrame, busy: DataFrame, key: str) -> tuple[DataFrame, Column]:
    busy = busy.select(F.col(key).alias("_busy"), F.col("parts").alias("_parts"))
    return df.join(busy, F.col(key).eqNullSafe(F.col("_busy")), "left").drop("_busy"), F.coalesce("_parts", F.lit(1))


def in_parts(facts: DataFrame, busy: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    """Add ``part``, from a hash of ``by``, which should tell the rows of a key apart. Rows equal in ``by`` share a part."""
    rows, parts = _with_parts(facts, busy, key)
    return rows.withColumn(PART, F.pmod(F.xxhash64(*by), parts).cast("int")).drop("_parts")


def in_all_parts(df: DataFrame, busy: DataFrame, key: str) -> DataFrame:
    """Each row once for every part of its key; for tables with few rows a key, such as ships."""
    rows, parts = _with_parts(df, busy, key)
    return rows.withColumn(PART, F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int, sort: Sequence[str] = (), replace: bool = False) -> DataFrame:
    """Store rows that have a ``part`` in ``buckets`` files by (key, part), sorted inside, and read them back.

    Tables that are to meet without a shuffle need the same ``buckets``. One shuffle puts each
    bucket in one task, so there is one file a bucket. A table of that name is left alone, or replaced.
    """
    rows = df.repartition(buckets, key, PART)
    writer = rows.write.bucketBy(buckets, key, PART).sortBy(key, PART, *sort)
    writer.mode("overwrite" if replace else "ignore").saveAsTable(name)
    return df.sparkSession.table(name)


def join_parts(facts: DataFrame, other: DataFrame, key: str, columns: Sequence[str], how: str = "inner") -> DataFrame:
    """Join stored facts with a table stored ``in_all_parts``, bucket by bucket. ``how`` is inner, left, left_semi or left_anti."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"rows of the second table stand in several parts, so {how!r} would repeat them")
    return facts.join(other.select(key, PART, *columns), [key, PART], how).drop(PART)


def first_rows(facts: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key along ``order``, ties by the other columns; nulls come first.

    The first of each part is found without a shuffle; only these meet by key.
    """
    columns = [c for c in facts.columns if c != PART]
    payload = [*order, *[c for c in columns if c != key and c not in order]]
    least = facts.groupBy(key, PART).agg(F.min(F.struct(*payload)).alias("row"))
    return least.groupBy(key).agg(F.min("row").alias("row")).select(key, "row.*").select(*columns)
