"""Small lookup files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamark.schema import COUNTRY, PORT


def read_ports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PORT).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def repair_quoted_rows(df: DataFrame, first: str, second: str) -> DataFrame:
    """Split rows that were quoted as a whole, so that both fields landed in the first column."""
    merged = F.col(second).isNull() & F.col(first).contains(",")
    pattern = '^([^,]*),"?(.*?)"?$'
    return df.withColumns(
        {
            second: F.when(merged, F.regexp_extract(first, pattern, 2)).otherwise(F.col(second)),
            first: F.when(merged, F.regexp_extract(first, pattern, 1)).otherwise(F.col(first)),
        }
    )


def read_countries(spark: SparkSession, path: str) -> DataFrame:
    """Country codes and names. ``NA`` is a country here, not a missing value."""
    raw = (
        spark.read.schema(COUNTRY)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", "")
        .csv(path)
    )
    return repair_quoted_rows(raw, "CountryCode", "CountryName")
