"""Destinations against known port codes, and country names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.operators.joins import known_codes


def matched_codes(messages: DataFrame, destination: str, ports: DataFrame, code: str) -> DataFrame:
    """(code): port codes that occur as a destination."""
    seen = messages.select(F.col(destination).alias(code)).where(F.col(code).isNotNull()).distinct()
    return known_codes(seen, code, ports, code)


def match_report(messages: DataFrame, destination: str, ports: DataFrame, code: str) -> DataFrame:
    """(known_ports, distinct_destinations, matched_ports)"""
    seen = messages.select(F.col(destination).alias("_d")).where(F.col("_d").isNotNull()).distinct()
    known = ports.select(F.col(code).alias("_d")).where(F.col("_d").isNotNull()).distinct()
    # One pass over the two distinct sets side by side.
    sides = seen.select("_d", F.lit(1).alias("s"), F.lit(0).alias("k")).unionByName(
        known.select("_d", F.lit(0).alias("s"), F.lit(1).alias("k"))
    )
    codes = sides.groupBy("_d").agg(F.max("s").alias("s"), F.max("k").alias("k"))
    return codes.agg(
        F.count(F.when(F.col("k") == 1, 1)).alias("known_ports"),
        F.count(F.when(F.col("s") == 1, 1)).alias("distinct_destinations"),
        F.count(F.when((F.col("s") == 1) & (F.col("k") == 1), 1)).alias("matched_ports"),
    )


def with_country_names(ports: DataFrame, countries: DataFrame) -> DataFrame:
    """Ports with the name of their country; null where the code is unknown."""
    names = countries.select(F.col("CountryCode").alias("country_code"), F.col("CountryName").alias("country_name"))
    return ports.drop("country_name").join(names, "country_code", "left")
