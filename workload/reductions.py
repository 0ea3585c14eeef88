"""Joins behind a filter of the other side's keys, over the tables with most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.operators import profile, reduction
from seamark.plans import task
from workload.base import MEMBERS, NTH, VAL, Source, query, split_sql
from workload.firsts import TASK, grouped_segments

SPRING = "o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate < TIMESTAMP '1997-05-01'"


def spring_orders(t: Source) -> DataFrame:
    return t.orders.where(SPRING.replace("TIMESTAMP", "TIMESTAMP_NTZ")).withColumnRenamed("o_orderkey", "l_orderkey")


@query(
    "reduced_join",
    f"""
SELECT l_orderkey, l_linenumber, l_quantity, o_custkey, o_orderdate
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE {SPRING}
""",
)
def reduced_join(t: Source) -> DataFrame:
    """Lines of two months' orders."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    return reduction.join(lines, spring_orders(t), ["l_orderkey"], ["o_custkey", "o_orderdate"])


@query(
    "reduced_left_join",
    f"""
SELECT l_orderkey, l_linenumber, o_orderpriority
FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE {SPRING}) ON o_orderkey = l_orderkey
""",
)
def reduced_left_join(t: Source) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_linenumber")
    return reduction.join(lines, spring_orders(t), ["l_orderkey"], ["o_orderpriority"], "left")


RETURNED = "SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45"
PAIR = "r.l_partkey = l.l_partkey AND r.l_suppkey = l.l_suppkey"


def returned(t: Source) -> DataFrame:
    return t.lineitem.where("l_returnflag = 'R' AND l_quantity >= 45").select("l_partkey", "l_suppkey")


@query(
    "reduced_semi_join",
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem l WHERE EXISTS (SELECT 1 FROM ({RETURNED}) r WHERE {PAIR})",
)
def reduced_semi_join(t: Source) -> DataFrame:
    """Lines of a part and supplier of which many came back at once."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return reduction.semi_join(lines, returned(t), ["l_partkey", "l_suppkey"])


@query(
    "reduced_anti_join",
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM ({RETURNED}) r WHERE {PAIR})",
)
def reduced_anti_join(t: Source) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return reduction.anti_join(lines, returned(t), ["l_partkey", "l_suppkey"])


@query(
    "sieve_passes",
    f"""
SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE o_orderkey IS NOT NULL) AS partners, true AS within
FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE {SPRING}) ON o_orderkey = l_orderkey GROUP BY 1
""",
)
def sieve_passes(t: Source) -> DataFrame:
    """Rows and those with a partner, counted behind the filter, and whether it lets less than 2 % of the others pass."""
    filter_ = reduction.sieve(spring_orders(t), ["l_orderkey"])
    passed = reduction.sift(t.lineitem.select("l_orderkey", "l_returnflag"), filter_)
    met = passed.join(filter_.keys.withColumn("here", F.lit(1)), "l_orderkey", "left").groupBy("l_returnflag")
    counts = met.agg(F.count(F.lit(1)).alias("passed"), F.count("here").alias("partners"))
    rows = t.lineitem.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    counts = rows.join(counts, "l_returnflag", "left").fillna(0, ["passed", "partners"])
    within = F.col("passed") - F.col("partners") <= (F.col("n") - F.col("partners")) * 0.02
    return counts.select("l_returnflag", "n", "partners", within.alias("within"))


@query(
    "nth_event_task_reduced",
    f"""
WITH {NTH}
SELECT user_id, nth_time, 1 AS segment, {split_sql('nth_time')} AS split
FROM nth JOIN customer ON c_custkey = user_id WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
""",
)
def nth_event_task_reduced(t: Source) -> DataFrame:
    """The task of labelled users only; events of the others don't reach the ranking."""
    labelled = grouped_segments(t).withColumn("segment", F.when(F.col("segment") == "/".join(MEMBERS), F.col("segment")))
    return task.task_rows(t.events, labelled, TASK, reduced=True)


@query(
    "seen_keys_reduced",
    f"""
SELECT c_mktsegment, count(*) AS n FROM customer
WHERE c_acctbal < 0 AND (c_custkey IN (SELECT user_id FROM events WHERE ts < TIMESTAMP '{VAL}')
   OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-03-01')) GROUP BY 1
""",
)
def seen_keys_reduced(t: Source) -> DataFrame:
    """Customers in debt that were active in training, by segment."""
    events = t.events.where(F.col("ts") < F.lit(VAL).cast("timestamp_ntz"))
    orders = t.orders.where(F.col("o_orderdate") < F.lit("1995-03-01").cast("timestamp_ntz"))
    debtors = t.customer.where("c_acctbal < 0")
    seen = profile.seen_only(debtors, "c_custkey", [(events, "user_id"), (orders, "o_custkey")], reduced=True)
    return seen.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
