"""Joins. No side is forced to broadcast: Spark compares a side's size with
``spark.sql.autoBroadcastJoinThreshold`` when it plans and again at run time,
and splits skewed partitions of the sort-merge join beyond it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.operators.ranking import PART


def attach(df: DataFrame, other: DataFrame, key: str, columns: Sequence[str], how: str = "left") -> DataFrame:
    """Add columns of a keyed table, by key and never by row position."""
    return df.join(other.select(key, *columns), key, how)


def update_from(target: DataFrame, source: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Set ``columns`` from ``source`` where the key matches, nulls included; leave other rows as they are."""
    fresh = source.select(
        key, F.lit(True).alias("_hit"), *[F.col(c).cast(target.schema[c].dataType).alias(f"_new_{c}") for c in columns]
    )
    joined = target.join(fresh, key, "left")
    return joined.select(
        *[
            F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
            for c in target.columns
        ]
    )


def known_codes(df: DataFrame, column: str, codes: DataFrame, code: str, known: bool = True) -> DataFrame:
    """Rows whose ``column`` is one of the codes, or those whose is not."""
    return df.join(codes.select(F.col(code).alias(column)).distinct(), column, "left_semi" if known else "left_anti")


def fan_out(df: DataFrame, details: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Every row with every detail row of its key."""
    return df.join(details.select(key, *columns), key, "inner")


def align(frames: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Series side by side on shared keys, null ones included; each frame's columns get its name as prefix."""
    out = None
    for name, df in frames.items():
        renamed = df.select(
            F.struct(*keys).alias(PART), *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in keys]
        )
        out = renamed if out is None else out.join(renamed, PART, "full")
    return out.select(*[F.col(f"{PART}.{k}").alias(k) for k in keys], *[c for c in out.columns if c != PART])
