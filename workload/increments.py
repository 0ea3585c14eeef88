"""Tables kept up to date day by day, stored sketches, and sinks that are read back."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.operators import profile, quantiles, sketches
from seamark.plans import ports
from seamark.plans.ingest import DayStore
from seamark.schema import OFFSETS
from seamark.sources import results
from seamark.sources.messages import read_messages
from workload.base import Source, query
from workload.messages import DETAILS, END, MODES, POSITION, RAW, STAR, START, STATS, VESSEL, VOYAGE, harbours, raw_messages
from workload.profiles import DEST, destinations
from workload.sources import folder

DAYS = [date.fromisoformat(START[:10]) + timedelta(days=i) for i in range((date.fromisoformat(END[:10]) - date.fromisoformat(START[:10])).days)]


def kept_up(t: Source) -> DayStore:
    """A store that met every second day first, then all files again, with the other days and the late part of each day."""
    spark, path = t.events.sparkSession, folder(t.events)
    raw = raw_messages(t)
    day = F.concat_ws("-", F.substring("timestamp", 7, 4), F.substring("timestamp", 4, 2), F.substring("timestamp", 1, 2))
    late = (F.substring("timestamp", 12, 2).cast("int") >= 18).cast("int")
    raw.withColumns({"day": day, "late": late}).hint("rebalance", "day", "late").write.partitionBy("day", "late").parquet(f"{path}/files")
    store = DayStore(spark, f"{path}/store")

    def read(spark, files):
        return read_messages(spark, list(files), raw.schema)

    early = [f"{path}/files/day={d}/late=0" for d in DAYS]
    store.ingest(early[::2], read)
    store.ingest(early + [f"{path}/files/day={d}/late=1" for d in DAYS], read)
    return store


@query("build_by_days_position", f"WITH {RAW} {POSITION}")
def build_by_days_position(t: Source) -> DataFrame:
    return kept_up(t).tables(harbours(t)).position


@query("build_by_days_voyage", f"WITH {RAW} {VOYAGE}")
def build_by_days_voyage(t: Source) -> DataFrame:
    """The last days only, which are all that is read."""
    return kept_up(t).tables(harbours(t), START, END).voyage


@query(
    "build_by_days_vessel",
    f"""
WITH {RAW}, details AS ({DETAILS}), {STATS}, {MODES}, vessel AS ({VESSEL})
SELECT vessel.*, {', '.join(f'CAST(median_{c} AS INTEGER) AS median_{c}' for c in OFFSETS)}, {', '.join(f'mode_{c}' for c in OFFSETS)}
FROM vessel LEFT JOIN stats USING (mmsi) {STAR}
""",
)
def build_by_days_vessel(t: Source) -> DataFrame:
    """Ships with medians and modes from the days' counts."""
    return kept_up(t).tables(harbours(t)).vessel


@query(
    "weekly_counts_by_days",
    f"""
WITH {RAW}, pos AS ({POSITION}), vessel AS ({VESSEL})
SELECT shiptype, strftime(timestamp, '%G-%V') AS year_week, strftime(timestamp, '%V') AS week_number, count(*) AS count
FROM pos JOIN vessel USING (mmsi) WHERE shiptype IS NOT NULL GROUP BY ALL
""",
)
def weekly_counts_by_days(t: Source) -> DataFrame:
    """From the stored counts per day and ship, messages unread."""
    store = kept_up(t)
    return store.weekly_counts(store.tables(harbours(t), geometry=False).vessel)


def sketched(t: Source) -> DataFrame:
    path = folder(t.events)
    rows = t.events.select("ts", "event_type", "value", "user_id")
    sketches.write_sketches(sketches.day_sketches(rows, "ts", ["value"], ["user_id"], ["event_type"]), path)
    return t.events.sparkSession.read.parquet(path)


SHARES = [0.0, 0.25, 0.5, 0.75, 1.0]


@query(
    "quartiles_from_day_sketches",
    "SELECT event_type, count(*) AS n, unnest([0, 1, 2, 3, 4]) AS quartile, true AS within FROM events WHERE value IS NOT NULL GROUP BY event_type",
)
def quartiles_from_day_sketches(t: Source) -> DataFrame:
    """Whether the quartiles of a month, merged from the sketches of its days, are within the stated error of the exact ranks."""
    found = sketches.sketched_quantiles(sketched(t), SHARES, ["event_type"])
    off = sketches.quantile_error()
    near = [min(1.0, max(0.0, p + side * off)) for p in SHARES for side in (-1, 1)]
    exact = quantiles.exact_quantiles(t.events, ["value"], near, ["event_type"]).withColumnRenamed("q", "edges")
    checks = F.array(*[
        F.struct(F.lit(i).alias("quartile"), F.col("q")[i].between(F.col("edges")[2 * i], F.col("edges")[2 * i + 1]).alias("within")) for i in range(5)
    ])
    return found.join(exact.drop("column"), "event_type").select("event_type", "n", F.inline(checks))


@query(
    "distinct_from_day_sketches",
    "SELECT event_type, count(*) AS n, true AS within FROM events WHERE user_id IS NOT NULL GROUP BY event_type",
)
def distinct_from_day_sketches(t: Source) -> DataFrame:
    """Whether the users of a month, merged from the sketches of its days, are within the stated error of the exact count."""
    found = sketches.sketched_distinct(sketched(t), ["event_type"])
    exact = profile.distinct_per_group(t.events, "user_id", ["event_type"]).withColumnRenamed("n_distinct", "exact")
    within = F.abs(F.col("n_distinct") - F.col("exact")) <= F.ceil(sketches.distinct_error() * F.col("exact"))
    return found.join(exact, "event_type").select("event_type", "n", within.alias("within"))


SKEWED = "SELECT CASE WHEN l_orderkey % 3 = 0 THEN l_partkey % 12 ELSE l_orderkey * 10 + l_linenumber END AS k FROM lineitem"


@query("top_values_bounded", f"SELECT k, count(*) AS n FROM ({SKEWED}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_values_bounded(t: Source) -> DataFrame:
    """A dozen frequent values among nearly as many as there are rows."""
    order = F.col("l_orderkey")
    rows = t.lineitem.select(F.when(order % 3 == 0, F.col("l_partkey") % 12).otherwise(order * 10 + F.col("l_linenumber")).alias("k"))
    return sketches.top_values_bounded(rows, "k", 5)


@query("matched_codes_file", f"WITH {DEST} SELECT dest AS n_name FROM d INTERSECT SELECT n_name FROM nation")
def matched_codes_file(t: Source) -> DataFrame:
    """The port codes that occur as a destination, as the file that lists them."""
    path = folder(t.nation)
    results.write_csv(ports.matched_codes(destinations(t), "dest", t.nation, "n_name"), path)
    return t.nation.sparkSession.read.schema("n_name string").option("header", True).csv(path)


@query(
    "predictions_from_files",
    """
SELECT 'predictions' AS file, CAST(value > 40 AS INTEGER) AS class, count(*) AS n FROM events GROUP BY ALL
UNION ALL SELECT 'targets', CAST(event_type = 'purchase' AS INTEGER), count(*) FROM events GROUP BY ALL
""",
)
def predictions_from_files(t: Source) -> DataFrame:
    """Classes and targets of a test split, written and read back."""
    path, spark = folder(t.events), t.events.sparkSession
    rows = t.events.select((F.col("event_type") == "purchase").cast("int").alias("target"), (F.col("value") - 40).alias("score"))
    results.write_predictions(rows, path, "binary_classification", "target", "score")

    def classes(name: str) -> DataFrame:
        df = spark.read.schema("class int").option("header", True).csv(f"{path}/test_{name}.csv")
        return df.groupBy(F.lit(name).alias("file"), "class").agg(F.count(F.lit(1)).alias("n"))

    return classes("predictions").unionByName(classes("targets"))
