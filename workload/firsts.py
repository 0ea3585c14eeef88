"""First, n-th and every k-th rows; medians and modes; updates; times and casts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.functions import casts, labels, times
from seamark.operators import joins, quantiles, ranking
from seamark.plans import build, features, task
from workload.base import HUB, K, MEMBERS, N, NTH, TEST, VAL, hub_hour, query, r6, Source, split_sql

TASK = task.NthInteractionTask(
    n=N,
    entity="user_id",
    time="ts",
    target="segment",
    val_start=VAL,
    test_start=TEST,
    labels={"BUILDING/MACHINERY": 1, "Other": 0},
)


def grouped_segments(t: Source) -> DataFrame:
    return t.segments.withColumn("segment", labels.grouped_ship_type(F.col("segment"), MEMBERS))


@query(
    "nth_event_task",
    f"""
WITH {NTH}
SELECT user_id, nth_time,
       CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 1 ELSE 0 END AS segment,
       {split_sql('nth_time')} AS split
FROM nth JOIN customer ON c_custkey = user_id
""",
)
def nth_event_task(t: Source) -> DataFrame:
    return task.task_rows(t.events, grouped_segments(t), TASK)


@query(
    "task_table_val",
    f"""
WITH {NTH}
SELECT user_id, nth_time, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 1 ELSE 0 END AS segment
FROM nth JOIN customer ON c_custkey = user_id
WHERE nth_time >= TIMESTAMP '{VAL}' AND nth_time < TIMESTAMP '{TEST}'
""",
)
def task_table_val(t: Source) -> DataFrame:
    return task.task_table(t.events, grouped_segments(t), TASK, "val")


@query(
    "task_table_test_masked",
    f"""
WITH {NTH}
SELECT user_id, nth_time FROM nth JOIN customer ON c_custkey = user_id WHERE nth_time >= TIMESTAMP '{TEST}'
""",
)
def task_table_test_masked(t: Source) -> DataFrame:
    return task.task_table(t.events, grouped_segments(t), TASK, "test", mask_label=True)


@query(
    "first_row_per_user",
    """
SELECT user_id, ts, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE user_id IS NOT NULL
) WHERE rn = 1
""",
)
def first_row_per_user(t: Source) -> DataFrame:
    rows = t.events.where(F.col("user_id").isNotNull()).select("user_id", "ts", "event_id", "event_type", "value")
    return ranking.first_row(rows, by=["user_id"], order=["ts", "event_id"])


@query(
    "dedupe_user_hour",
    """
SELECT user_id, hour, event_id, event_type, value FROM (
  SELECT user_id, date_trunc('hour', ts) AS hour, event_id, event_type, value,
         row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS rn
  FROM events
) WHERE rn = 1
""",
)
def dedupe_user_hour(t: Source) -> DataFrame:
    rows = t.events.select("user_id", times.to_hour(F.col("ts")).alias("hour"), "ts", "event_id", "event_type", "value")
    return ranking.first_row(rows, by=["user_id", "hour"], order=["ts", "event_id"]).drop("ts")


@query(
    "nth_value_distinct",
    f"""
SELECT DISTINCT user_id, nth_timestamp FROM (
  SELECT user_id, nth_value(ts, {N}) OVER (PARTITION BY user_id ORDER BY ts) AS nth_timestamp FROM events
) WHERE nth_timestamp IS NOT NULL
""",
)
def nth_value_distinct(t: Source) -> DataFrame:
    return features.nth_times(t.events, N, key="user_id", time="ts")


@query(
    "nth_value_in_period",
    """
SELECT DISTINCT user_id, nth_timestamp FROM (
  SELECT user_id, nth_value(ts, 12) OVER (PARTITION BY user_id ORDER BY ts) AS nth_timestamp
  FROM events WHERE ts >= '2024-01-05' AND ts < '2024-01-12'
) WHERE nth_timestamp IS NOT NULL
""",
)
def nth_value_in_period(t: Source) -> DataFrame:
    return features.nth_times(t.events, 12, "2024-01-05", "2024-01-12", key="user_id", time="ts")


@query(
    "every_kth_event",
    """
SELECT user_id, ts, CAST(week(ts) AS INTEGER) AS week FROM (
  SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events
) WHERE rn % 10 = 0
""",
)
def every_kth_event(t: Source) -> DataFrame:
    rows = t.events.select("user_id", "ts", "event_id")
    kept = ranking.every_kth_row(
        rows, 10, by=["user_id"], order=["ts", "event_id"], slice_=times.hour_number(F.col("ts"))
    )
    return kept.select("user_id", "ts", times.iso_week(F.col("ts")).alias("week"))


@query(
    "nth_event_per_type",
    """
SELECT event_type, event_id, ts FROM (
  SELECT event_type, event_id, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events
) WHERE rn = 1500
""",
)
def nth_event_per_type(t: Source) -> DataFrame:
    """An n past the optimiser's group limit in groups that each hold a fifth of all rows."""
    rows = t.events.select("event_type", "event_id", "ts")
    return ranking.nth_row(
        rows, 1500, by=["event_type"], order=["ts", "event_id"], slice_=times.hour_number(F.col("ts"))
    )


NULLED = """
n AS (SELECT nullif(event_type, 'click') AS event_type,
             CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS ts, event_id FROM events)"""


def nulled(t: Source) -> DataFrame:
    """Events with a null type and null times, each a good part of the rows."""
    return t.events.select(
        F.nullif("event_type", F.lit("click")).alias("event_type"),
        F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("ts"),
        "event_id",
    )


def nth_null_sql(n: int) -> str:
    return f"""
WITH {NULLED}
SELECT event_type, ts, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts NULLS FIRST, event_id) AS rn FROM n) WHERE rn = {n}
"""


def nth_null(t: Source, n: int, limit: int) -> DataFrame:
    order = [F.asc_nulls_first("ts"), "event_id"]
    return ranking.nth_row(
        nulled(t), n, by=["event_type"], order=order, slice_=times.hour_number(F.col("ts")), limit=limit
    )


@query("nth_row_null_times", nth_null_sql(20))
def nth_row_null_times(t: Source) -> DataFrame:
    return nth_null(t, 20, limit=1000)


@query("nth_row_null_times_by_slices", nth_null_sql(20))
def nth_row_null_times_by_slices(t: Source) -> DataFrame:
    """The same rows the other way, which finds them from counts."""
    return nth_null(t, 20, limit=1)


@query(
    "every_kth_null_times",
    f"""
WITH {NULLED}
SELECT event_type, ts, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts NULLS FIRST, event_id) AS rn FROM n) WHERE rn % 3 = 0
""",
)
def every_kth_null_times(t: Source) -> DataFrame:
    order = [F.asc_nulls_first("ts"), "event_id"]
    return ranking.every_kth_row(nulled(t), 3, by=["event_type"], order=order, slice_=times.hour_number(F.col("ts")))


@query(
    "every_kth_hub_hour",
    f"""
WITH {HUB}
SELECT hub, moment, event_id FROM (SELECT *, row_number() OVER (PARTITION BY hub ORDER BY moment, event_id) AS rn FROM h) WHERE rn % 10 = 0
""",
)
def every_kth_hub_hour(t: Source) -> DataFrame:
    """Most rows belong to one key, in one hour and few instants, all above what a slice may have."""
    return ranking.every_kth_row(hub_hour(t), 10, by=["hub"], order=["moment", "event_id"], time="moment", target=50)


MEDIAN_MODE_SQL = f"""
m AS (SELECT user_id, value, {K} AS k, event_type FROM events),
med AS (SELECT user_id, median(value) AS median_value, median(k) AS median_k FROM m GROUP BY user_id),
mode_k AS (
  SELECT user_id, k AS mode_k FROM (
    SELECT user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, k) AS rn
    FROM m WHERE k IS NOT NULL GROUP BY user_id, k) WHERE rn = 1),
mode_type AS (
  SELECT user_id, event_type AS mode_event_type FROM (
    SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn
    FROM m WHERE event_type IS NOT NULL GROUP BY user_id, event_type) WHERE rn = 1)
"""


@query(
    "user_median_mode",
    f"""
WITH {MEDIAN_MODE_SQL}
SELECT user_id, round(median_value, 6) AS median_value, round(median_k, 6) AS median_k,
       mode_k, mode_event_type
FROM med LEFT JOIN mode_k USING (user_id) LEFT JOIN mode_type USING (user_id)
""",
)
def user_median_mode(t: Source) -> DataFrame:
    stats = quantiles.medians_and_modes(t.measured, ["value", "k"], "user_id")
    types = quantiles.grouped_mode(t.events, "event_type", ["user_id"], "mode_event_type")
    return joins.attach(stats, types, "user_id", ["mode_event_type"]).select(
        "user_id",
        r6("median_value").alias("median_value"),
        r6("median_k").alias("median_k"),
        F.col("mode_k").cast("int").alias("mode_k"),
        "mode_event_type",
    )


@query(
    "update_from_stats",
    f"""
WITH {MEDIAN_MODE_SQL}
SELECT c_custkey AS user_id, c_mktsegment AS segment, CAST(median_k AS INTEGER) AS median_k, mode_k
FROM customer LEFT JOIN med ON med.user_id = c_custkey LEFT JOIN mode_k ON mode_k.user_id = c_custkey
""",
)
def update_from_stats(t: Source) -> DataFrame:
    stats = quantiles.medians_and_modes(t.measured, ["k"], "user_id").withColumn("median_k", F.rint("median_k"))
    wide = casts.add_missing(t.segments, {"median_k": "int", "mode_k": "int"})
    return joins.update_from(wide, stats, "user_id", ["median_k", "mode_k"])


@query(
    "first_n_days",
    """
SELECT event_id, user_id, ts FROM events
WHERE ts < (SELECT min(ts) FROM events) + INTERVAL 7 DAY
""",
)
def first_n_days(t: Source) -> DataFrame:
    return build.first_days(t.events.select("event_id", "user_id", "ts"), 7, "ts")


@query(
    "composite_id_dateparts",
    """
SELECT user_id || '_' || strftime(ts, '%Y%m%d%H%M%S') AS row_id,
       CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day,
       CAST(hour(ts) AS INTEGER) AS hour, CAST(minute(ts) AS INTEGER) AS minute,
       strftime(ts, '%G-%V') AS year_week, strftime(ts, '%V') AS week_text
FROM events
""",
)
def composite_id_dateparts(t: Source) -> DataFrame:
    ts = F.col("ts")
    return t.events.select(
        times.composite_id(F.col("user_id"), ts).alias("row_id"),
        *[c.alias(name) for name, c in times.time_parts(ts).items()],
        times.iso_year_week(ts).alias("year_week"),
        times.iso_week_text(ts).alias("week_text"),
    )


@query(
    "iso_weeks_of_orders",
    """
SELECT strftime(o_orderdate, '%G-%V') AS year_week, CAST(week(o_orderdate) AS INTEGER) AS week, count(*) AS n
FROM orders GROUP BY 1, 2
""",
)
def iso_weeks_of_orders(t: Source) -> DataFrame:
    """Six years of dates, so ISO years and calendar years differ around each new year."""
    day = F.col("o_orderdate")
    return t.orders.groupBy(times.iso_year_week(day).alias("year_week"), times.iso_week(day).alias("week")).agg(
        F.count("*").alias("n")
    )


@query(
    "text_date_roundtrip",
    """
SELECT event_id, strptime(text, '%d/%m/%Y %H:%M:%S') AS parsed, TRY_CAST(value_text AS INTEGER) AS value_int,
       TRY_CAST(event_type AS INTEGER) AS type_int
FROM (SELECT event_id, strftime(ts, '%d/%m/%Y %H:%M:%S') AS text, CAST(value AS VARCHAR) AS value_text, event_type FROM events)
WHERE strptime(text, '%d/%m/%Y %H:%M:%S') >= strptime('2024-01-05 00:00:00', '%Y-%m-%d %H:%M:%S')
  AND strptime(text, '%d/%m/%Y %H:%M:%S') < strptime('2024-01-20 00:00:00', '%Y-%m-%d %H:%M:%S')
""",
)
def text_date_roundtrip(t: Source) -> DataFrame:
    text = t.events.select(
        "event_id",
        F.date_format("ts", "dd/MM/yyyy HH:mm:ss").alias("text"),
        F.col("value").cast("string").alias("value_text"),
        "event_type",
    )
    parsed = text.select(
        "event_id",
        casts.parse_time(F.col("text"), "dd/MM/yyyy HH:mm:ss").alias("parsed"),
        casts.to_int(text, "value_text").alias("value_int"),
        casts.to_int(text, "event_type").alias("type_int"),
    )
    return build.in_period(parsed, "2024-01-05 00:00:00", "2024-01-20 00:00:00", "parsed")


@query(
    "rounding_casts",
    f"""
SELECT event_id, CAST(value AS INTEGER) AS rounded, CAST({K} / 2 AS INTEGER) AS half_even,
       date_trunc('second', ts) AS second, CAST(ts AS DATE) AS day, CAST(CAST(ts AS DATE) - 1 AS DATE) AS day_before
FROM events
""",
)
def rounding_casts(t: Source) -> DataFrame:
    return t.measured.select(
        "event_id",
        casts.int_from_number(F.col("value")).alias("rounded"),
        casts.int_from_number(F.col("k") / 2).alias("half_even"),
        times.to_second(F.col("ts")).alias("second"),
        F.to_date("ts").alias("day"),
        F.date_sub(F.to_date("ts"), 1).alias("day_before"),
    )


@query(
    "label_variants",
    """
SELECT c_custkey,
       CASE WHEN s IN ('BUILDING', 'MACHINERY') THEN 'BUILDING/MACHINERY' ELSE 'Other' END AS grouped,
       CASE WHEN s IN ('BUILDING', 'MACHINERY') THEN 1 ELSE 0 END AS member,
       CASE WHEN s = 'BUILDING' THEN 1 ELSE 0 END AS equal,
       CASE s WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 0 END AS mapped,
       coalesce(s, 'Unknown') AS filled
FROM (SELECT c_custkey, nullif(c_mktsegment, 'FURNITURE') AS s FROM customer)
""",
)
def label_variants(t: Source) -> DataFrame:
    rows = t.customer.select("c_custkey", F.nullif("c_mktsegment", F.lit("FURNITURE")).alias("s"))
    s = F.col("s")
    made = rows.select(
        "c_custkey",
        labels.grouped_ship_type(s, MEMBERS).alias("grouped"),
        labels.member_label(s, MEMBERS).alias("member"),
        labels.equals_label(s, "BUILDING").alias("equal"),
        labels.mapped_label(s, {"BUILDING": 1, "MACHINERY": 0}).alias("mapped"),
        s.alias("filled"),
    )
    return casts.fill_text(made, ["filled"])
