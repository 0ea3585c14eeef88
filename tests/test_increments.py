"""Stored days and sketches against one build and exact answers."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from seamark import session
from seamark.operators import profile, quantiles, sketches
from seamark.plans import build, ingest, weekly
from seamark.plans.ingest import DayStore
from seamark.schema import RAW_MESSAGE

START = datetime(2025, 4, 7)


def raw(spark, rows):
    """Raw messages of (ship, minutes, speed, bow, draught)."""
    filled = []
    for mmsi, minutes, speed, bow, draught in rows:
        at = (START + timedelta(minutes=minutes)).strftime("%d/%m/%Y %H:%M:%S")
        values = {"mmsi": mmsi, "timestamp": at, "speed": speed, "to_bow": bow, "draught": draught, "shipname": f"S{minutes % 7}", "shiptype": "Cargo"}
        filled.append(tuple(values.get(f.name) for f in RAW_MESSAGE.fields))
    return spark.createDataFrame(filled, RAW_MESSAGE)


FILES = {
    "a": [(1, 5, 3.0, "10", 2.0), (1, 5, 2.0, None, None), (2, 700, 1.0, "4", None), (None, 9, 1.0, "1", 1.0)],
    "b": [(1, 1500, 4.0, "12", None), (3, 1445, 1.0, "x", 3.0)],
    "late a": [(1, 5, 1.0, "9", 5.0), (1, 2, 9.0, "11", None), (2, 700, None, "5", 1.0)],
    "c": [(1, 4000, 1.0, None, None), (2, 4001, 1.0, "4", 2.5)],
    "a again": [(1, 5, 3.0, "10", 2.0), (2, 700, 1.0, "4", None)],
}


def listed(tables):
    return {name: sorted(map(str, getattr(tables, name).collect())) for name in ("vessel", "vessel_details", "voyage", "position")}


@pytest.mark.parametrize("order", [["a", "b", "late a", "c", "a again"], ["c", "late a", "a again", "a", "b"]])
def test_days_in_any_order_are_one_build(spark, tmp_path, order):
    ports = spark.createDataFrame([], "port_code string")
    store = DayStore(spark, str(tmp_path))

    def read(spark, names):
        return raw(spark, [r for n in names for r in FILES[n]])

    for name in order:
        assert store.ingest([name], read) == [name]
    assert store.ingest(order, read) == []
    whole = build.build_tables(raw(spark, [r for rows in FILES.values() for r in rows]), ports)
    assert listed(store.tables(ports)) == listed(whole)
    counted = store.weekly_counts(whole.vessel).collect()
    assert sorted(map(str, counted)) == sorted(map(str, weekly.weekly_counts(whole.position, whole.vessel).collect()))
    day = store.tables(ports, "2025-04-08", "2025-04-09").position
    assert {r.mmsi for r in day.collect()} == {1, 3}
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_an_ingest_rewrites_only_its_days_and_ships(spark, tmp_path):
    store = DayStore(spark, str(tmp_path))
    store.ingest(["a", "c"], lambda spark, names: raw(spark, [r for n in names for r in FILES[n]]))

    def files():
        return {os.path.join(d, f) for d, _, names in os.walk(tmp_path) for f in names if f.startswith("part-")}

    before = files()
    store.ingest(["b"], lambda spark, names: raw(spark, FILES["b"]))
    gone = before - files()
    assert not [f for f in gone if "date=" in f] and all("part=" in f for f in gone)
    assert [f for f in files() - before if "date=2025-04-08" in f]


def test_sketched_quantiles_are_within_their_error(spark):
    rows = spark.range(50_000).select(
        (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval((F.col("id") % 7).cast("int"))).alias("ts"),
        F.when(F.col("id") % 11 != 0, F.pmod(F.xxhash64("id"), F.lit(1 << 20)) ** 2).alias("x"),
        (F.col("id") % 3).alias("g"),
    )
    made = sketches.day_sketches(rows, "ts", ["x"], ["x"], ["g"])
    assert made.count() == 21
    found = sketches.sketched_quantiles(made, [0.01, 0.25, 0.5, 0.9], ["g"]).collect()
    off = sketches.quantile_error()
    for r in found:
        values = sorted(v.x for v in rows.where((F.col("g") == r.g) & F.col("x").isNotNull()).select("x").collect())
        assert r.n == len(values)
        for p, q in zip([0.01, 0.25, 0.5, 0.9], r.q):
            assert abs(sum(v <= q for v in values) / len(values) - p) <= off + 1 / len(values)
    for r in sketches.sketched_distinct(made, ["g"]).collect():
        exact = rows.where(F.col("g") == r.g).select("x").distinct().where("x IS NOT NULL").count()
        assert abs(r.n_distinct - exact) <= sketches.distinct_error() * exact
    part = sketches.sketched_quantiles(made.where("day < '2025-04-09'"), [0.0, 1.0]).first()
    span = rows.where("ts < '2025-04-09'").agg(F.min("x"), F.max("x"), F.count("x")).first()
    assert (*part.q, part.n) == tuple(span)  # the ends are exact


def test_stored_sketches_of_a_day_are_replaced_alone(spark, tmp_path):
    rows = spark.createDataFrame([(START + timedelta(days=i % 3), float(i)) for i in range(30)], "ts timestamp_ntz, x double")
    path = str(tmp_path / "s")
    sketches.write_sketches(sketches.day_sketches(rows, "ts", ["x"]), path)
    more = rows.where("ts < '2025-04-08'").union(rows.where("ts < '2025-04-08'"))
    sketches.write_sketches(sketches.day_sketches(more, "ts", ["x"]), path)
    found = spark.read.parquet(path).groupBy("day").agg(F.sum("n").alias("n")).orderBy("day").collect()
    assert [r.n for r in found] == [20, 10, 10]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_top_values_bounded(spark, seed):
    hot = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(20 * seed))
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, hot).when(F.col("id") % 100 != 1, -F.col("id")).alias("v"))
    for n, tracked in ((5, 400), (3, 10_000), (30, 40)):
        expected = [tuple(r) for r in profile.top_values(rows, "v", n).collect()]
        assert [tuple(r) for r in sketches.top_values_bounded(rows, "v", n, tracked).collect()] == expected
    assert sketches.top_values_bounded(rows.limit(0), "v", 5).count() == 0


def test_top_values_that_are_proven_move_no_other_values(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.col("id") % 8).otherwise(F.col("id")).alias("v"))
    plan = sketches.top_values_bounded(rows, "v", 4, 1000)._jdf.queryExecution().executedPlan().toString()
    assert "top-values" in plan and "HashAggregate" not in plan
    spread_out = spark.range(20_000).select(F.col("id").alias("v"))
    plan = sketches.top_values_bounded(spread_out, "v", 4, 1000)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan


@pytest.mark.parametrize("target", [10, 1000])
def test_medians_and_modes_by_key_are_those_of_all_rows(spark, target):
    """Keys above the target, key 0 here, and keys below it; every value is counted on two days."""
    made = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(40 + 30 * i)).cast("int").alias(c) for i, c in enumerate("ab")]
    rows = spark.range(400).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 17).alias("k"), *made).where("k <> 5 OR a < 0 OR b > 20")
    entries = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in "ab"]))
    counts = rows.select("k", entries, (F.rand(1) > 0.5).alias("day")).groupBy("k", "column", "value", "day").agg(F.count("*").alias("n")).drop("day")
    expected = sorted(map(tuple, quantiles.medians_and_modes(rows, ["a", "b"], "k", (0, 64)).collect()))
    assert sorted(map(tuple, quantiles.medians_and_modes_by_key(counts, ["a", "b"], "k", (0, 64), target).collect())) == expected


def test_stored_counts_of_ships_meet_in_one_shuffle(spark, tmp_path):
    store = DayStore(spark, str(tmp_path))
    store.ingest(["a"], lambda spark, names: raw(spark, FILES["a"]))
    stats = quantiles.medians_and_modes_by_key(store._open("offsets"), build.OFFSETS, "mmsi", build.OFFSET_RANGE)
    assert stats._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_an_ingest_writes_merged_days_once(spark, tmp_path, monkeypatch):
    written = []
    monkeypatch.setattr(ingest, "write_out", lambda df, name, *a: written.append(name) or session.write_out(df, name, *a))
    store = DayStore(spark, str(tmp_path))
    store.ingest(["a"], lambda spark, names: raw(spark, FILES["a"]))
    store.ingest(["late a"], lambda spark, names: raw(spark, FILES["late a"]))
    assert written == ["new-messages", "merged-ships"] * 2
    assert store._open("messages").count() == 3
