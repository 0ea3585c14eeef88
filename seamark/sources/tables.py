"""Tables kept as parquet folders or in the session catalog."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamark.session import in_ranges


def read_table(spark: SparkSession, folder: str, name: str, schema=None, columns: Sequence[str] | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(f"{folder.rstrip('/')}/{name}")
    return df.select(*columns) if columns else df


def write_table(
    df: DataFrame,
    folder: str,
    name: str,
    mode: str = "overwrite",
    sort: Sequence[str] = (),
    ranged: bool = False,
) -> None:
    """Write one table. ``ignore`` keeps a table that is there, ``overwrite`` replaces it, so reruns never double rows.

    With ``sort`` the files cover ranges of the sort columns and are sorted
    inside. ``ranged`` says that the input's partitions already are such ranges,
    which leaves a local sort and no shuffle.
    """
    if sort:
        df = df.sortWithinPartitions(*sort) if ranged else in_ranges(df, sort)
    df.write.mode(mode).parquet(f"{folder.rstrip('/')}/{name}")


def save_catalog_table(df: DataFrame, name: str, replace: bool = False) -> None:
    """Create a table from a query: leave an existing one alone, or replace it."""
    df.write.mode("overwrite" if replace else "ignore").saveAsTable(name)


def insert_into(df: DataFrame, name: str, replace: bool = False) -> None:
    """Insert by position, cast to the table's types, as INSERT ... SELECT does."""
    df.write.insertInto(name, overwrite=replace)


def list_tables(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW TABLES").select(F.col("tableName").alias("name"))


def register_views(tables: Mapping[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def query(spark: SparkSession, text: str, **parameters: object) -> DataFrame:
    """SQL with bound ``:name`` parameters."""
    return spark.sql(text, args=parameters)


def scalar(df: DataFrame):
    """The single value of a one-row, one-column result."""
    return df.first()[0]
