"""Sources and sinks: files, catalog tables and views written below the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.operators import sampling
from seamark.plans import runs
from seamark.schema import DOUBLE, INT, RAW_MESSAGE, struct
from seamark.session import shared_folder, write_out
from seamark.sources import buckets, lookups, messages, results, tables
from workload.base import Source, query, r6


def folder(df: DataFrame) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(df.sparkSession).rstrip('/')}/sources-{uuid.uuid4().hex}"


@query(
    "bound_parameters",
    "SELECT event_type, count(*) AS rows FROM events JOIN customer ON c_custkey = user_id "
    "WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' AND c_mktsegment = 'MACHINERY' GROUP BY 1",
)
def bound_parameters(t: Source) -> DataFrame:
    """A statement with named parameters over registered views."""
    tables.register_views({"moves": t.events, "ships": t.customer})
    text = """
        SELECT event_type, count(*) AS rows FROM moves JOIN ships ON c_custkey = user_id
        WHERE ts >= to_timestamp_ntz(:start) AND ts < to_timestamp_ntz(:end) AND c_mktsegment = :kind GROUP BY 1"""
    return tables.query(
        t.events.sparkSession, text, start="2024-01-05 00:00:00", end="2024-01-12 00:00:00", kind="MACHINERY"
    )


@query("damaged_lookup_rows", "SELECT n_name AS code, 'Region ' || n_regionkey || ', also' AS name FROM nation")
def damaged_lookup_rows(t: Source) -> DataFrame:
    """Lookup rows every third of which was quoted as a whole when written."""
    path = folder(t.nation)
    name = F.concat(F.lit("Region "), F.col("n_regionkey"), F.lit(", also"))
    quoted = F.concat(F.lit('"'), name, F.lit('"'))
    line = F.concat_ws(",", "n_name", quoted)
    whole = F.concat(F.lit('"'), F.replace(line, F.lit('"'), F.lit('""')), F.lit('"'))
    t.nation.select(F.when(F.col("n_nationkey") % 3 == 0, whole).otherwise(line)).write.text(path)
    reader = t.nation.sparkSession.read.schema("code string, name string").option("quote", '"').option("escape", '"')
    return lookups.repair_quoted_rows(reader.csv(path), "code", "name")


@query(
    "messages_from_daily_text",
    """
SELECT CAST(user_id AS INTEGER) AS mmsi, ts AS timestamp, CAST(round(value) AS INTEGER) AS to_bow
FROM (SELECT user_id, date_trunc('second', ts) AS ts, value FROM events)
""",
)
def messages_from_daily_text(t: Source) -> DataFrame:
    """Text files with a header, typed on reading, kept in a folder per day and read back by a glob."""
    path = folder(t.events)
    written = {
        "mmsi": F.col("user_id"), "timestamp": F.date_format("ts", "dd/MM/yyyy HH:mm:ss"), "to_bow": F.col("value").cast("string")
    }
    columns = [written.get(f.name, F.lit(None).cast("string")).alias(f.name) for f in RAW_MESSAGE.fields]
    t.events.select(*columns).write.option("header", True).csv(f"{path}/text")
    spark = t.events.sparkSession
    messages.write_messages(messages.typed(messages.read_daily_text(spark, f"{path}/text")), f"{path}/days")
    return messages.read_messages(spark, f"{path}/days").select("mmsi", "timestamp", "to_bow")


@query(
    "catalog_tables",
    """
SELECT c_custkey AS id, CAST(round_even(c_acctbal, 0) AS INTEGER) AS balance FROM customer
UNION ALL SELECT s_suppkey, CAST(round_even(s_acctbal, 0) AS INTEGER) FROM supplier
""",
)
def catalog_tables(t: Source) -> DataFrame:
    """Created from a query, left alone by a second creation, replaced on demand, and filled by an insert."""
    spark, name = t.customer.sparkSession, f"kept_{uuid.uuid4().hex}"
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.rint("c_acctbal").cast("int").alias("balance"))
    tables.save_catalog_table(rows.limit(0), name)
    tables.save_catalog_table(rows.limit(1), name)  # is there already: stays empty
    empty = spark.table(name).limit(1).count() == 0
    tables.save_catalog_table(rows, name, replace=empty)
    tables.insert_into(t.supplier.select("s_suppkey", F.rint("s_acctbal")), name)
    listed = tables.list_tables(spark).where(F.col("name") == name).count()
    return spark.table(name).where(F.lit(listed == 1))


def bucketed(t: Source, use) -> DataFrame:
    """``use`` on events by hub and on nations, both stored in buckets; the catalog's tables go when the result is written."""
    spark, run = t.events.sparkSession, uuid.uuid4().hex
    hub = F.when(F.col("user_id") % 3 != 0, 0).otherwise(F.col("user_id") % 5)
    facts = t.events.select("event_id", hub.cast("int").alias("hub"), "ts", "value")
    nations = t.nation.select(F.col("n_nationkey").cast("int").alias("hub"), "n_name")
    busy = buckets.busy_keys(facts, "hub", target=1000)
    stored = buckets.save_bucketed(buckets.in_parts(facts, busy, "hub", ["event_id"]), f"facts_{run}", "hub", 8, ["ts"])
    others = buckets.save_bucketed(buckets.in_all_parts(nations, busy, "hub"), f"nations_{run}", "hub", 8)
    out = write_out(use(stored, others), "bucketed")
    for name in ("facts", "nations"):
        spark.sql(f"DROP TABLE {name}_{run}")
    return out


BUCKETED_HUB = "CAST(CASE WHEN user_id % 3 <> 0 THEN 0 ELSE user_id % 5 END AS INTEGER)"


@query(
    "bucketed_join",
    f"""
SELECT e.event_id, e.hub, e.ts, e.value, n_name
FROM (SELECT event_id, {BUCKETED_HUB} AS hub, ts, value FROM events) e JOIN nation ON hub = n_nationkey""",
)
def bucketed_join(t: Source) -> DataFrame:
    """Every row of a hub with what is known of the hub; most rows have one hub."""
    return bucketed(t, lambda facts, nations: buckets.join_parts(facts, nations, "hub", ["n_name"]))


@query(
    "bucketed_first_rows",
    f"""
SELECT event_id, hub, ts, value FROM (
  SELECT *, row_number() OVER (PARTITION BY hub ORDER BY ts, event_id) AS rn
  FROM (SELECT event_id, {BUCKETED_HUB} AS hub, ts, value FROM events)) WHERE rn = 1""",
)
def bucketed_first_rows(t: Source) -> DataFrame:
    """The earliest row of each hub."""
    return bucketed(t, lambda facts, _: buckets.first_rows(facts, "hub", ["ts", "event_id"]))


@query(
    "named_table_scan",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01'",
)
def named_table_scan(t: Source) -> DataFrame:
    """A table written in ranges of its sort columns, of which two columns are read back."""
    path = folder(t.orders)
    tables.write_table(t.orders, path, "orders", sort=["o_custkey", "o_orderdate"])
    tables.write_table(t.orders.limit(0), path, "orders", mode="ignore")
    found = tables.read_table(t.orders.sparkSession, path, "orders", columns=["o_orderkey", "o_totalprice", "o_orderdate"])
    return found.where("o_orderdate >= '1995-01-01'").drop("o_orderdate")


@query(
    "series_from_files",
    """
SELECT CAST(day(ts) AS INTEGER) AS epoch, event_type AS run, round(avg(value), 6) AS loss FROM events GROUP BY ALL
""",
)
def series_from_files(t: Source) -> DataFrame:
    """A loss series per run, written as one folder per run and read by a glob; the run is the folder's name."""
    path, spark = folder(t.events), t.events.sparkSession
    series = t.events.groupBy(F.dayofmonth("ts").alias("epoch"), "event_type").agg(F.avg("value").alias("loss"))
    # The names of the five event types, which name folders.
    for (kind,) in t.events.select("event_type").distinct().collect():
        results.write_series(series.where(F.col("event_type") == kind).drop("event_type"), f"{path}/{kind}/train_loss.csv")
    return results.read_losses(spark, f"{path}/*/train_loss.csv", "train").withColumn("loss", r6("loss"))


@query(
    "parameters_from_json",
    "SELECT p_brand AS name, CAST(min(p_size) AS INTEGER) AS k, round(max(p_retailprice), 6) AS rate FROM part GROUP BY 1",
)
def parameters_from_json(t: Source) -> DataFrame:
    path = folder(t.part)
    best = t.part.groupBy(F.col("p_brand").alias("name")).agg(
        F.min("p_size").cast("int").alias("k"), F.max("p_retailprice").alias("rate")
    )
    results.write_parameters(best, path)
    found = results.read_parameters(t.part.sparkSession, path, struct(("name", best.schema["name"].dataType), ("k", INT), ("rate", DOUBLE)))
    return found.withColumn("rate", r6("rate"))


@query(
    "scalar_bound",
    "SELECT event_id FROM events WHERE value > (SELECT avg(value) FROM events WHERE event_type = 'click')",
)
def scalar_bound(t: Source) -> DataFrame:
    """A single value that reaches the driver and comes back as a bound."""
    bound = tables.scalar(t.events.where("event_type = 'click'").agg(F.avg("value")))
    return t.events.where(F.col("value") > F.lit(bound)).select("event_id")


@query("shuffled_rows", "SELECT event_id, event_type FROM events")
def shuffled_rows(t: Source) -> DataFrame:
    return sampling.shuffled(t.events.select("event_id", "event_type"))



@query(
    "run_report",
    """
WITH e AS (SELECT event_type AS run, CAST(day(ts) AS INTEGER) AS epoch, value, user_id % 3 AS part FROM events),
s AS (SELECT run, epoch, part, round(avg(value), 6) AS loss, round(min(value), 6) AS low, round(max(value), 6) AS high,
             round(avg(value) / 100, 6) AS f1 FROM e GROUP BY ALL),
w AS (SELECT run, epoch, t.loss AS train_loss, v.high AS val_roc_auc, x.loss AS test_loss, x.low AS test_average_precision, x.f1 AS test_f1
      FROM (SELECT * FROM s WHERE part = 0) t FULL JOIN (SELECT * FROM s WHERE part = 1) v USING (run, epoch)
      FULL JOIN (SELECT * FROM s WHERE part = 2) x USING (run, epoch)),
r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY val_roc_auc DESC, epoch) AS rn FROM w WHERE val_roc_auc IS NOT NULL)
SELECT run, epoch, train_loss, val_roc_auc, test_loss, test_average_precision, test_f1 FROM r WHERE rn = 1
""",
)
def run_report(t: Source) -> DataFrame:
    """The best epoch of every run from the files of all runs; a third of the users stands for each split."""
    path, spark = folder(t.events), t.events.sparkSession
    rows = t.events.groupBy("event_type", F.dayofmonth("ts").alias("epoch"), (F.col("user_id") % 3).alias("part")).agg(
        r6(F.avg("value")).alias("loss"),
        r6(F.min("value")).alias("average_precision"),
        F.lit(0.5).alias("accuracy"),
        r6(F.avg("value") / 100).alias("f1"),
        r6(F.max("value")).alias("roc_auc"),
    )
    # The names of the five event types, which name folders.
    for (run,) in t.events.select("event_type").distinct().collect():
        for part, split in enumerate(results.SPLITS):
            own = rows.where((F.col("event_type") == run) & (F.col("part") == part)).drop("event_type", "part")
            results.write_series(own.select("epoch", "loss"), f"{path}/{run}/{split}_loss.csv")
            results.write_series(own.drop("loss"), f"{path}/{run}/{split}_metrics.csv")
    return runs.run_report(spark, path).select(
        "run", "epoch", "train_loss", "val_roc_auc", "test_loss", "test_average_precision", "test_f1"
    )
