"""Feature frames, splits, balance, histograms, samples and weekly activity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.functions import casts, labels
from seamark.operators import histograms, profile, sampling
from seamark.plans import balance, features, weekly
from workload.base import K, MEMBERS, N, NTH, TEST, VAL, Source, query, r6, split_sql


def offsets(t: Source) -> DataFrame:
    """Four offsets per event, one of them missing for errors."""
    return t.measured.select(
        "user_id",
        "event_id",
        F.col("k").alias("to_bow"),
        casts.int_from_number(F.col("value")).alias("to_stern"),
        (F.col("k") % 10).alias("to_port"),
        F.when(F.col("event_type") != "error", F.col("k") % 7).alias("to_starboard"),
    )


OFFSETS_SQL = f"""
o AS (SELECT user_id, event_id, {K} AS to_bow, CAST(value AS INTEGER) AS to_stern, {K} % 10 AS to_port,
             CASE WHEN event_type <> 'error' THEN {K} % 7 END AS to_starboard FROM events)"""

FAN_SQL = f"""
{NTH}, {OFFSETS_SQL},
fan AS (
  SELECT user_id, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 1 ELSE 0 END AS segment,
         to_bow, to_stern, to_port, to_starboard, nth_time AS nth_timestamp
  FROM nth JOIN customer ON c_custkey = user_id JOIN o USING (user_id)
  WHERE c_mktsegment IS NOT NULL AND to_bow IS NOT NULL AND to_stern IS NOT NULL
    AND to_port IS NOT NULL AND to_starboard IS NOT NULL)"""


def fanned(t: Source, merged: bool = False) -> DataFrame:
    return features.nth_geometry_features(
        t.events,
        t.segments,
        offsets(t),
        N,
        key="user_id",
        time="ts",
        target="segment",
        label=labels.member_label(F.col("segment"), MEMBERS),
        merged=merged,
    )


def split_features(t: Source, merged: bool = False) -> DataFrame:
    return features.with_size(balance.with_split(fanned(t, merged), "nth_timestamp", VAL, TEST))


SPLIT_SQL = f"""
{FAN_SQL},
f AS (SELECT *, {split_sql('nth_timestamp')} AS split, to_bow + to_stern AS length, to_port + to_starboard AS width FROM fan)"""


@query("nth_feature_fanout", f"WITH {FAN_SQL} SELECT * FROM fan")
def nth_feature_fanout(t: Source) -> DataFrame:
    return fanned(t)


@query(
    "nth_feature_merged",
    f"WITH {FAN_SQL} SELECT *, count(*) AS rows FROM fan GROUP BY ALL",
)
def nth_feature_merged(t: Source) -> DataFrame:
    return fanned(t, merged=True)


@query(
    "nth_feature_per_entity",
    f"""
WITH {NTH}, {OFFSETS_SQL},
modes AS (
  SELECT user_id, max(v) FILTER (c = 'to_bow') AS to_bow, max(v) FILTER (c = 'to_stern') AS to_stern FROM (
    SELECT user_id, c, v, row_number() OVER (PARTITION BY user_id, c ORDER BY count(*) DESC, v) AS rn FROM (
      SELECT user_id, 'to_bow' AS c, to_bow AS v FROM o UNION ALL SELECT user_id, 'to_stern', to_stern FROM o)
    WHERE v IS NOT NULL GROUP BY user_id, c, v) WHERE rn = 1 GROUP BY user_id)
SELECT user_id, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 1 ELSE 0 END AS segment,
       to_bow AS mode_to_bow, to_stern AS mode_to_stern, nth_time AS nth_timestamp
FROM nth JOIN customer ON c_custkey = user_id JOIN modes USING (user_id)
""",
)
def nth_feature_per_entity(t: Source) -> DataFrame:
    from seamark.operators.quantiles import modes_of, value_counts

    modes = modes_of(value_counts(offsets(t), ["to_bow", "to_stern"], ["user_id"]), ["user_id"])
    wide = modes.groupBy("user_id").agg(
        *[
            F.max(F.when(F.col("column") == c, F.col("value"))).cast("int").alias(f"mode_{c}")
            for c in ("to_bow", "to_stern")
        ]
    )
    ships = t.segments.join(wide, "user_id")
    rows = features.nth_mode_features(
        t.events, ships, N, ["mode_to_bow", "mode_to_stern"], key="user_id", time="ts", target="segment"
    )
    return rows.drop("segment").join(
        t.segments.select("user_id", labels.member_label(F.col("segment"), MEMBERS).alias("segment")), "user_id"
    )


@query(
    "split_class_balance",
    f"""
WITH {SPLIT_SQL}
SELECT split, count(*) AS total, count(*) FILTER (segment = 1) AS class_1, count(*) FILTER (segment = 0) AS class_0,
       round(100.0 * count(*) FILTER (segment = 1) / count(*), 2) AS percent_1,
       round(100.0 * count(*) FILTER (segment = 0) / count(*), 2) AS percent_0
FROM f GROUP BY split
""",
)
def split_class_balance(t: Source) -> DataFrame:
    return balance.class_balance(split_features(t, merged=True), "segment")


@query("split_entities", f"WITH {SPLIT_SQL} SELECT split, count(DISTINCT user_id) AS n_distinct FROM f GROUP BY split")
def split_entities(t: Source) -> DataFrame:
    return balance.distinct_entities(split_features(t), "user_id")


@query(
    "split_periods",
    f"""
WITH {SPLIT_SQL}, s AS (SELECT CAST(min(nth_timestamp) AS DATE) AS lo, CAST(max(nth_timestamp) AS DATE) AS hi FROM f)
SELECT 'train' AS split, lo AS first_day, CAST(DATE '{VAL}' - 1 AS DATE) AS last_day FROM s
UNION ALL SELECT 'val', DATE '{VAL}', CAST(DATE '{TEST}' - 1 AS DATE) FROM s
UNION ALL SELECT 'test', DATE '{TEST}', hi FROM s
""",
)
def split_periods(t: Source) -> DataFrame:
    return balance.split_periods(split_features(t), "nth_timestamp", VAL, TEST)


@query(
    "size_points",
    f"WITH {SPLIT_SQL} SELECT split, segment, length, width, count(*) AS n FROM f GROUP BY ALL",
)
def size_points(t: Source) -> DataFrame:
    return balance.size_profile(split_features(t), "segment")["points"]


@query(
    "size_class_histogram",
    f"""
WITH {SPLIT_SQL},
s AS (SELECT split, segment, min(length)::DOUBLE AS lo, max(length)::DOUBLE AS hi FROM f GROUP BY ALL),
b AS (SELECT split, segment, least(floor((length - lo) / (hi - lo) * 40), 39)::BIGINT AS bin, count(*) AS n
      FROM f JOIN s USING (split, segment) GROUP BY ALL)
SELECT s.split, s.segment, g.bin, round(lo + g.bin * (hi - lo) / 40, 6) AS bin_start, coalesce(n, 0) AS n
FROM s CROSS JOIN (SELECT unnest(range(40)) AS bin) g LEFT JOIN b ON b.split = s.split AND b.segment = s.segment AND b.bin = g.bin
""",
)
def size_class_histogram(t: Source) -> DataFrame:
    hist = balance.size_profile(split_features(t), "segment")["length_classes"]
    return hist.select("split", "segment", "bin", r6("bin_start").alias("bin_start"), "n")


@query(
    "hist_unit",
    """
WITH e AS (SELECT CAST(floor(min(l_quantity)) AS BIGINT) AS lo, CAST(floor(max(l_quantity)) AS BIGINT) AS hi FROM lineitem),
g AS (SELECT l_returnflag, bin FROM (SELECT DISTINCT l_returnflag FROM lineitem), (SELECT unnest(range(lo, hi + 1)) AS bin FROM e))
SELECT g.l_returnflag, g.bin, count(l_quantity) AS n
FROM g LEFT JOIN lineitem l ON l.l_returnflag = g.l_returnflag AND floor(l.l_quantity) = g.bin GROUP BY ALL
""",
)
def hist_unit(t: Source) -> DataFrame:
    return histograms.unit_histogram(t.lineitem, "l_quantity", ["l_returnflag"])


@query(
    "hist_40",
    """
WITH s AS (SELECT o_orderstatus, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1),
b AS (SELECT o_orderstatus, least(floor((o_totalprice - lo) / (hi - lo) * 40), 39)::BIGINT AS bin, count(*) AS n
      FROM orders JOIN s USING (o_orderstatus) GROUP BY ALL)
SELECT s.o_orderstatus, g.bin, round(lo + g.bin * (hi - lo) / 40, 6) AS bin_start, coalesce(n, 0) AS n
FROM s CROSS JOIN (SELECT unnest(range(40)) AS bin) g
LEFT JOIN b ON b.o_orderstatus = s.o_orderstatus AND b.bin = g.bin
""",
)
def hist_40(t: Source) -> DataFrame:
    hist = histograms.equal_width_histogram(t.orders, "o_totalprice", 40, ["o_orderstatus"])
    return hist.select("o_orderstatus", "bin", r6("bin_start").alias("bin_start"), "n")


LINES = "l AS (SELECT nullif(l_returnflag, 'N') AS flag, l_quantity FROM lineitem)"


@query(
    "hist_unit_null_group",
    f"""
WITH {LINES}, e AS (SELECT CAST(floor(min(l_quantity)) AS BIGINT) AS lo, CAST(floor(max(l_quantity)) AS BIGINT) AS hi FROM l),
g AS (SELECT flag, bin FROM (SELECT DISTINCT flag FROM l), (SELECT unnest(range(lo, hi + 1)) AS bin FROM e))
SELECT g.flag, g.bin, count(l_quantity) AS n
FROM g LEFT JOIN l ON l.flag IS NOT DISTINCT FROM g.flag AND floor(l.l_quantity) = g.bin GROUP BY ALL
""",
)
def hist_unit_null_group(t: Source) -> DataFrame:
    rows = t.lineitem.select(F.nullif("l_returnflag", F.lit("N")).alias("flag"), "l_quantity")
    return histograms.unit_histogram(rows, "l_quantity", ["flag"])


@query(
    "hist_40_null_group",
    """
WITH o AS (SELECT nullif(o_orderstatus, 'O') AS status, o_totalprice AS x FROM orders),
s AS (SELECT status, min(x) AS lo, max(x) AS hi FROM o GROUP BY 1),
b AS (SELECT o.status, least(floor((x - lo) / (hi - lo) * 40), 39)::BIGINT AS bin, count(*) AS n
      FROM o JOIN s ON o.status IS NOT DISTINCT FROM s.status GROUP BY ALL)
SELECT s.status, g.bin, round(lo + g.bin * (hi - lo) / 40, 6) AS bin_start, coalesce(n, 0) AS n
FROM s CROSS JOIN (SELECT unnest(range(40)) AS bin) g
LEFT JOIN b ON b.status IS NOT DISTINCT FROM s.status AND b.bin = g.bin
""",
)
def hist_40_null_group(t: Source) -> DataFrame:
    rows = t.orders.select(F.nullif("o_orderstatus", F.lit("O")).alias("status"), "o_totalprice")
    hist = histograms.equal_width_histogram(rows, "o_totalprice", 40, ["status"])
    return hist.select("status", "bin", r6("bin_start").alias("bin_start"), "n")


@query(
    "rebalanced_fanout",
    f"""
WITH {SPLIT_SQL}, n AS (SELECT segment, count(*) AS rows FROM f GROUP BY 1)
SELECT segment, CASE WHEN segment = 1 THEN CAST(round_even(rows * 0.3, 0) AS BIGINT) ELSE rows END AS rows FROM n
""",
)
def rebalanced_fanout(t: Source) -> DataFrame:
    """Rows of each class once three tenths of class 1 are kept of a frame most of whose rows are copies."""
    kept = balance.rebalanced(split_features(t), "segment", 1, 0.3)
    return kept.groupBy("segment").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "exact_downsample",
    """
WITH c AS (SELECT event_id, event_type, row_number() OVER (ORDER BY md5('42:' || event_id), event_id) AS rn,
                  count(*) OVER () AS total FROM events WHERE event_type IN ('click', 'view', 'purchase'))
SELECT event_id, event_type FROM c WHERE rn <= round_even(total * 0.4, 0)
UNION ALL SELECT event_id, event_type FROM events WHERE event_type NOT IN ('click', 'view', 'purchase')
""",
)
def exact_downsample(t: Source) -> DataFrame:
    major = F.col("event_type").isin("click", "view", "purchase")
    return sampling.downsample(t.events.select("event_id", "event_type"), major, 0.4, ["event_id"])


@query(
    "weekly_counts",
    """
SELECT c_mktsegment AS segment, strftime(ts, '%G-%V') AS year_week, strftime(ts, '%V') AS week_number, count(*) AS count
FROM events JOIN customer ON c_custkey = user_id WHERE c_mktsegment IS NOT NULL GROUP BY 1, 2, 3
""",
)
def weekly_counts(t: Source) -> DataFrame:
    return weekly.weekly_counts(t.events, t.segments, "user_id", "ts", "segment")


PIVOT_CLASSES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "weekly_pivot",
    f"""
SELECT strftime(ts, '%G-%V') AS year_week, strftime(ts, '%V') AS week_number,
       {', '.join(f"count(*) FILTER (c_mktsegment = '{c}') AS {c}" for c in PIVOT_CLASSES)}
FROM events JOIN customer ON c_custkey = user_id GROUP BY 1, 2
""",
)
def weekly_pivot(t: Source) -> DataFrame:
    counts = weekly_counts(t)
    return weekly.week_labels(counts, weekly.weekly_pivot(counts, "segment", "year_week", PIVOT_CLASSES))


@query(
    "class_totals",
    "SELECT c_mktsegment AS segment, count(*) AS total FROM events JOIN customer ON c_custkey = user_id GROUP BY 1",
)
def class_totals(t: Source) -> DataFrame:
    return weekly.class_totals(weekly_counts(t), "segment")


@query(
    "top4_classes",
    """
SELECT c_mktsegment AS segment, count(*) AS total FROM events JOIN customer ON c_custkey = user_id
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4
""",
)
def top4_classes(t: Source) -> DataFrame:
    return weekly.top_classes(weekly_counts(t), "segment")


@query(
    "weekly_every_kth",
    """
SELECT c_mktsegment AS segment, CAST(week(ts) AS INTEGER) AS week, count(*) AS count FROM (
  SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events
  WHERE ts >= '2024-01-03' AND ts < '2024-01-28'
) JOIN customer ON c_custkey = user_id WHERE rn % 5 = 0 GROUP BY 1, 2
""",
)
def weekly_every_kth(t: Source) -> DataFrame:
    return weekly.weekly_counts_every_kth(
        t.events, t.segments, 5, "2024-01-03", "2024-01-28", "user_id", "ts", "segment"
    )


@query("distinct_classes", "SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL")
def distinct_classes(t: Source) -> DataFrame:
    known = t.customer.where(F.col("c_mktsegment").isNotNull())
    return profile.distinct_values(known, "c_mktsegment").orderBy("c_mktsegment")


