"""Column and table profiles, port-code matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.functions.times import component_vector
from seamark.operators import joins, profile
from seamark.operators.quantiles import exact_quantiles
from seamark.plans import ports
from seamark.plans.dataset import Database, KeyedTable
from seamark.schema import Keys
from workload.base import K, VAL, Source, query, r6


def gappy(t: Source) -> DataFrame:
    """Events with nulls in three columns."""
    return t.events.select(
        "event_id",
        F.nullif("event_type", F.lit("error")).alias("event_type"),
        F.when(F.col("value") < 20, None).otherwise(F.col("value")).alias("value"),
        F.when(F.col("user_id") % 3 == 0, None).otherwise(F.col("user_id")).alias("user_id"),
    )


@query(
    "null_profile",
    """
SELECT unnest(['event_id', 'event_type', 'value', 'user_id']) AS column,
       unnest(['bigint', 'string', 'double', 'bigint']) AS data_type,
       unnest([0, count(*) FILTER (event_type = 'error'), count(*) FILTER (value < 20),
               count(*) FILTER (user_id % 3 = 0)]) AS nulls
FROM events
""",
)
def null_profile(t: Source) -> DataFrame:
    return profile.null_profile(gappy(t))


@query("table_shape", "SELECT count(*) AS rows, CAST(11 AS BIGINT) AS columns FROM lineitem")
def table_shape(t: Source) -> DataFrame:
    return profile.shape(t.lineitem)


@query("preview", "SELECT event_id, ts, value FROM events ORDER BY ts, event_id LIMIT 5")
def preview(t: Source) -> DataFrame:
    return profile.preview(t.events.select("event_id", "ts", "value").orderBy("ts", "event_id"))


@query("time_span", "SELECT min(ts) AS first_time, max(ts) AS last_time FROM events")
def time_span(t: Source) -> DataFrame:
    return profile.time_span(t.events, "ts")


def activity(t: Source) -> Database:
    """Customers with their events and orders as a keyed database."""
    return Database(
        {
            "customers": KeyedTable(t.customer, Keys("c_custkey")),
            "events": KeyedTable(
                t.events.drop("props"), Keys("event_id", {"user_id": "customers"}, "ts")
            ),
            "orders": KeyedTable(t.orders, Keys("o_orderkey", {"o_custkey": "customers"}, "o_orderdate")),
        }
    )


@query(
    "database_span",
    """
SELECT least((SELECT min(ts) FROM events), (SELECT min(o_orderdate) FROM orders)) AS first_time,
       greatest((SELECT max(ts) FROM events), (SELECT max(o_orderdate) FROM orders)) AS last_time
""",
)
def database_span(t: Source) -> DataFrame:
    return activity(t).span()


@query(
    "database_up_to",
    """
SELECT 'customers' AS name, count(*) AS rows FROM customer
UNION ALL SELECT 'events', count(*) FROM events WHERE ts < TIMESTAMP '1999-06-01'
UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderdate < TIMESTAMP '1999-06-01'
""",
)
def database_up_to(t: Source) -> DataFrame:
    out = None
    for name, df in activity(t).up_to("1999-06-01").frames.items():
        rows = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("without_hidden_columns", "SELECT event_id, user_id, ts FROM events")
def without_hidden_columns(t: Source) -> DataFrame:
    """Key and time columns survive even when they are named."""
    return activity(t).without(["event_type", "value", "user_id"])["events"]


@query("without_hidden_in_one", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def without_hidden_in_one(t: Source) -> DataFrame:
    return activity(t).without(["c_acctbal", "c_mktsegment", "value"], only="customers")["customers"]


@query(
    "column_stats_numeric",
    """
WITH v AS (
  SELECT 'l_quantity' AS c, l_quantity AS x FROM lineitem
  UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem
  UNION ALL SELECT 'l_discount', l_discount FROM lineitem
  UNION ALL SELECT 'l_linenumber', l_linenumber FROM lineitem)
SELECT c AS column, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std,
       round(min(x), 6) AS q0, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS q50,
       round(quantile_cont(x, 0.75), 6) AS q75, round(max(x), 6) AS q100
FROM v GROUP BY c
""",
)
def column_stats_numeric(t: Source) -> DataFrame:
    stats = profile.numeric_stats(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"])
    return wide_stats(stats)


def wide_stats(stats: DataFrame, *by: str) -> DataFrame:
    names = ["q0", "q25", "q50", "q75", "q100"]
    return stats.select(
        *by,
        "column",
        "n",
        r6("mean").alias("mean"),
        r6("std").alias("std"),
        *[r6(F.col("q")[i]).alias(name) for i, name in enumerate(names)],
    )


@query(
    "column_stats_by_type",
    """
SELECT event_type, 'value' AS column, count(value) AS n, round(avg(value), 6) AS mean,
       round(stddev_pop(value), 6) AS std, round(min(value), 6) AS q0, round(quantile_cont(value, 0.25), 6) AS q25,
       round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75,
       round(max(value), 6) AS q100
FROM events GROUP BY event_type
""",
)
def column_stats_by_type(t: Source) -> DataFrame:
    return wide_stats(profile.numeric_stats(t.events, ["value"], ["event_type"]), "event_type")


@query(
    "stats_null_group",
    """
WITH e AS (SELECT nullif(event_type, 'click') AS kind, value FROM events)
SELECT kind, 'value' AS column, count(value) AS n, round(avg(value), 6) AS mean,
       round(stddev_pop(value), 6) AS std, round(min(value), 6) AS q0, round(quantile_cont(value, 0.25), 6) AS q25,
       round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75,
       round(max(value), 6) AS q100
FROM e GROUP BY kind
""",
)
def stats_null_group(t: Source) -> DataFrame:
    rows = t.events.select(F.nullif("event_type", F.lit("click")).alias("kind"), "value")
    return wide_stats(profile.numeric_stats(rows, ["value"], ["kind"]), "kind")


@query(
    "median_outlier",
    """
WITH v AS (SELECT CASE WHEN event_id = 7 THEN 1e300 ELSE value END AS x FROM events)
SELECT round(quantile_cont(x, 0.25), 6) AS q25, round(median(x), 6) AS q50, round(quantile_cont(x, 0.75), 6) AS q75 FROM v
""",
)
def median_outlier(t: Source) -> DataFrame:
    """One value far from all others, which leaves those in one cell of equal width."""
    rows = t.events.select(F.when(F.col("event_id") == 7, 1e300).otherwise(F.col("value")).alias("x"))
    q = exact_quantiles(rows, ["x"], [0.25, 0.5, 0.75])
    return q.select(*[r6(F.col("q")[i]).alias(name) for i, name in enumerate(("q25", "q50", "q75"))])


@query(
    "quantiles_nan_inf",
    """
WITH v AS (SELECT CASE WHEN event_id % 50 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 50 = 1 THEN 'Infinity'::DOUBLE
                       WHEN event_id % 50 = 2 THEN '-Infinity'::DOUBLE ELSE value END AS x FROM events),
r AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i, count(*) OVER () - 1 AS last FROM v)
SELECT max(x) FILTER (i = floor(last * 0.01)) AS low, round(max(x) FILTER (i = floor(last * 0.5)), 6) AS middle,
       max(x) FILTER (i = floor(last * 0.97)) AS high, max(x) FILTER (i = last) AS top
FROM r
""",
)
def quantiles_nan_inf(t: Source) -> DataFrame:
    """NaN is the largest value and infinities have a place, with bounds that hold for few values."""
    kind = F.col("event_id") % 50
    x = F.when(kind == 0, float("nan")).when(kind == 1, float("inf")).when(kind == 2, float("-inf")).otherwise(F.col("value"))
    rows = t.events.select(x.alias("x"))
    last = rows.agg(F.count(F.lit(1)).alias("n")).first()["n"] - 1
    at = [int(last * p) / last for p in (0.01, 0.5, 0.97, 1.0)]
    q = exact_quantiles(rows, ["x"], at, bounds=(10.0, 20.0))
    return q.select(
        F.col("q")[0].alias("low"), r6(F.col("q")[1]).alias("middle"), F.col("q")[2].alias("high"), F.col("q")[3].alias("top")
    )


@query(
    "column_stats_categorical",
    """
SELECT 'o_orderstatus' AS column, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2
UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2
""",
)
def column_stats_categorical(t: Source) -> DataFrame:
    return profile.categorical_stats(t.orders, ["o_orderstatus", "o_orderpriority"])


@query(
    "column_stats_time",
    """
WITH x AS (SELECT min(ts) AS lo, max(ts) AS hi,
                  to_timestamp(floor(quantile_cont(epoch(date_trunc('second', ts)), 0.5))) AT TIME ZONE 'UTC' AS mid FROM events)
SELECT CAST(year(lo) AS INTEGER) AS first_year, CAST(year(hi) AS INTEGER) AS last_year,
       strftime(lo, '%Y %m %d %H %M %S') || ' ' || (isodow(lo) - 1) AS oldest,
       strftime(hi, '%Y %m %d %H %M %S') || ' ' || (isodow(hi) - 1) AS newest,
       strftime(mid, '%Y %m %d %H %M %S') || ' ' || (isodow(mid) - 1) AS median
FROM x
""",
)
def column_stats_time(t: Source) -> DataFrame:
    def text(c):
        v = F.col(c)
        parts = [F.lpad((v[i] + add).cast("string"), 2, "0") for i, add in ((1, 1), (2, 1), (4, 0), (5, 0), (6, 0))]
        return F.concat_ws(" ", v[0].cast("string"), *parts, v[3].cast("string")).alias(c)

    stats = profile.time_stats(t.events, "ts")
    return stats.select("first_year", "last_year", text("oldest"), text("newest"), text("median"))


@query(
    "time_components",
    """
SELECT event_id, CAST(year(ts) AS INTEGER) AS c0, CAST(month(ts) - 1 AS INTEGER) AS c1, CAST(day(ts) - 1 AS INTEGER) AS c2,
       CAST(isodow(ts) - 1 AS INTEGER) AS c3, CAST(hour(ts) AS INTEGER) AS c4, CAST(minute(ts) AS INTEGER) AS c5,
       CAST(second(ts) AS INTEGER) AS c6 FROM events
""",
)
def time_components(t: Source) -> DataFrame:
    v = t.events.select("event_id", component_vector(F.col("ts")).alias("v"))
    return v.select("event_id", *[F.col("v")[i].alias(f"c{i}") for i in range(7)])


@query(
    "top_values",
    "SELECT p_brand, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def top_values(t: Source) -> DataFrame:
    return profile.top_values(t.part, "p_brand", 10)


@query(
    "numeric_summary",
    """
SELECT round(min(o_totalprice), 6) AS min, round(max(o_totalprice), 6) AS max,
       round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std FROM orders
""",
)
def numeric_summary(t: Source) -> DataFrame:
    s = profile.numeric_summary(t.orders, "o_totalprice")
    return s.select(
        r6("min").alias("min"), r6("max").alias("max"), F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std")
    )


@query(
    "semantic_types",
    """
WITH v AS (SELECT 'user_id' AS c, CAST(user_id AS VARCHAR) AS v FROM events
           UNION ALL SELECT 'event_type', event_type FROM events UNION ALL SELECT 'props', props FROM events),
l AS (SELECT c, count(*) AS levels, min(n) AS least FROM (SELECT c, v, count(*) AS n FROM v WHERE v IS NOT NULL GROUP BY c, v) GROUP BY c)
SELECT 'event_id' AS column, 'numerical' AS semantic_type
UNION ALL SELECT 'ts', 'timestamp' UNION ALL SELECT 'value', 'numerical'
UNION ALL SELECT c, CASE WHEN levels <= 24 AND least >= 5 THEN 'categorical' WHEN c = 'user_id' THEN 'numerical' ELSE 'text' END FROM l
""",
)
def semantic_types(t: Source) -> DataFrame:
    return profile.semantic_types(t.events, keys=["event_id"])


@query(
    "static_stats_seen_only",
    f"""
WITH c AS (SELECT c_acctbal AS x FROM customer
           WHERE c_custkey IN (SELECT user_id FROM events WHERE ts < TIMESTAMP '{VAL}'
                               UNION SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-03-01'))
SELECT 'c_acctbal' AS column, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std,
       round(min(x), 6) AS q0, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS q50,
       round(quantile_cont(x, 0.75), 6) AS q75, round(max(x), 6) AS q100 FROM c
""",
)
def static_stats_seen_only(t: Source) -> DataFrame:
    events = t.events.where(F.col("ts") < F.lit(VAL).cast("timestamp_ntz"))
    orders = t.orders.where(F.col("o_orderdate") < F.lit("1995-03-01").cast("timestamp_ntz"))
    seen = profile.seen_only(t.customer, "c_custkey", [(events, "user_id"), (orders, "o_custkey")])
    return wide_stats(profile.numeric_stats(seen, ["c_acctbal"]))


def destinations(t: Source) -> DataFrame:
    """Events with a port code that only some nations have."""
    return t.measured.select("event_id", F.concat(F.lit("NATION_"), (F.col("k") % 40 + 3).cast("string")).alias("dest"))


DEST = f"d AS (SELECT event_id, 'NATION_' || ({K} % 40 + 3) AS dest FROM events)"


@query(
    "code_match_report",
    f"""
WITH {DEST}
SELECT (SELECT count(DISTINCT n_name) FROM nation) AS known_ports,
       (SELECT count(DISTINCT dest) FROM d) AS distinct_destinations,
       (SELECT count(*) FROM (SELECT dest FROM d INTERSECT SELECT n_name FROM nation)) AS matched_ports
""",
)
def code_match_report(t: Source) -> DataFrame:
    return ports.match_report(destinations(t), "dest", t.nation, "n_name")


@query("matched_codes", f"WITH {DEST} SELECT dest AS n_name FROM d INTERSECT SELECT n_name FROM nation")
def matched_codes(t: Source) -> DataFrame:
    return ports.matched_codes(destinations(t), "dest", t.nation, "n_name")


@query(
    "known_destinations",
    f"WITH {DEST} SELECT dest, event_id FROM d WHERE dest IN (SELECT n_name FROM nation)",
)
def known_destinations(t: Source) -> DataFrame:
    return joins.known_codes(destinations(t), "dest", t.nation, "n_name")


@query(
    "unknown_destinations",
    f"WITH {DEST} SELECT dest, event_id FROM d WHERE dest NOT IN (SELECT n_name FROM nation)",
)
def unknown_destinations(t: Source) -> DataFrame:
    return joins.known_codes(destinations(t), "dest", t.nation, "n_name", known=False)


@query(
    "country_names",
    """
SELECT 'NATION_' || (s_nationkey + 5) AS country_code, s_suppkey AS port_id, n_name || ' of ' || r_name AS country_name
FROM supplier LEFT JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON n_name = 'NATION_' || (s_nationkey + 5)
""",
)
def country_names(t: Source) -> DataFrame:
    places = t.supplier.select(
        F.concat(F.lit("NATION_"), (F.col("s_nationkey") + 5).cast("string")).alias("country_code"),
        F.col("s_suppkey").alias("port_id"),
    )
    countries = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("CountryCode"), F.concat_ws(" of ", "n_name", "r_name").alias("CountryName")
    )
    return ports.with_country_names(places, countries)
