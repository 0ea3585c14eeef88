"""Raw ship messages: daily text files in, typed and dated parquet out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamark.functions.casts import parse_time, to_int
from seamark.operators.joins import known_codes
from seamark.schema import DATE_FORMAT, OFFSETS, RAW_MESSAGE


def read_daily_text(spark: SparkSession, paths: str | Sequence[str], schema=RAW_MESSAGE) -> DataFrame:
    """Daily CSV files with a header, all columns as declared."""
    return spark.read.schema(schema).option("header", True).csv(paths)


def read_messages(spark: SparkSession, paths: str | Sequence[str], schema=None) -> DataFrame:
    """Parquet files or a glob of them; a declared schema saves reading footers."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(*([paths] if isinstance(paths, str) else paths))


def typed(raw: DataFrame, strict: bool = True) -> DataFrame:
    """Parse the two text dates and cast imo and the offsets to integers.

    Unreadable dates raise when ``strict``, as an unreadable date in the source
    would; otherwise they become null. Columns that have their type already, as in
    files written by ``write_messages``, are left alone, so filters on them reach the scan.
    """
    kinds = dict(raw.dtypes)
    parsed = {c: parse_time(F.col(c), DATE_FORMAT, strict) for c in ("timestamp", "eta") if kinds[c] == "string"}
    numbers = {c: to_int(raw, c) for c in ["imo", *OFFSETS] if kinds[c] != "int"}
    return raw.withColumns({**parsed, **numbers})


def clean(messages: DataFrame, ports: DataFrame | None = None) -> DataFrame:
    """Messages with a ship and a time and, given ports, a destination that is a known port code."""
    kept = messages.where(F.col("mmsi").isNotNull() & F.col("timestamp").isNotNull())
    return kept if ports is None else known_codes(kept, "destination", ports, "port_code")


def write_messages(messages: DataFrame, path: str) -> None:
    """One folder per day, so a period prunes folders and min/max of ``timestamp`` prune row groups."""
    dated = messages.withColumn("date", F.to_date("timestamp"))
    # Many sorted files per day instead of one task per day.
    dated.repartitionByRange("date", "timestamp", "mmsi").sortWithinPartitions("date", "timestamp").write.mode(
        "overwrite"
    ).option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
