"""Registration, loading and the derived frames the queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamark.functions.casts import int_from_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

N = 30
VAL, TEST = "2024-01-13", "2024-01-16"
MEMBERS = ["BUILDING", "MACHINERY"]


class Source:
    """Tables of a data folder as attributes, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        df = self._spark.read.parquet(f"{self._folder}/{name}.parquet")
        setattr(self, name, df)
        return df

    @property
    def measured(self) -> DataFrame:
        """Events with the whole number kept in ``props``."""
        return self.events.withColumn("k", int_from_text(F.get_json_object("props", "$.k"))).drop("props")

    @property
    def segments(self) -> DataFrame:
        return self.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))


def in_hour(seconds: Column) -> Column:
    zero = F.lit(0)
    return F.lit("2024-01-10 10:00:00").cast("timestamp_ntz") + F.make_dt_interval(zero, zero, zero, seconds.cast("int"))


def hub_hour(t: Source) -> DataFrame:
    """Events of few keys, one with most of the rows, that all lie in seven seconds of one hour."""
    hub = F.when(F.col("user_id") % 3 != 0, 0).otherwise(F.col("user_id") % 5)
    return t.events.select("event_id", hub.cast("long").alias("hub"), in_hour(F.col("event_id") % 7).alias("moment"))


def query(name: str, sql: str | None = None):
    """Register ``fn(source)`` under a name, with its SQL if it has one."""

    def add(fn: Callable[[Source], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Source(spark, folder))
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


def r6(column: Column | str) -> Column:
    return F.round(column, 6)


# SQL pieces used by several queries.
K = "CAST(regexp_extract(props, '[0-9]+') AS INTEGER)"


def split_sql(ts: str) -> str:
    return (
        f"CASE WHEN {ts} < TIMESTAMP '{VAL}' THEN 'train' "
        f"WHEN {ts} < TIMESTAMP '{TEST}' THEN 'val' ELSE 'test' END"
    )


HUB = """
h AS (SELECT event_id, CASE WHEN user_id % 3 <> 0 THEN 0 ELSE user_id % 5 END AS hub,
             TIMESTAMP '2024-01-10 10:00:00' + to_seconds(CAST(event_id % 7 AS BIGINT)) AS moment FROM events)"""

NTH = f"""
nth AS (
  SELECT user_id, ts AS nth_time FROM (
    SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn
    FROM (SELECT DISTINCT user_id, ts FROM events)
  ) WHERE rn = {N}
)"""
