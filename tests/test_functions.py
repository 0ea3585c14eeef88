from datetime import datetime

import pytest
from pyspark.sql import functions as F

from seamark.functions import casts, labels, times
from seamark.schema import VOYAGE


def column(spark, values, kind):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def listed(df):
    return [r[0] for r in df.collect()]


def test_text_rounds_half_away_and_bad_text_is_null(spark):
    df = column(spark, ["12.7", "12.5", "2.5", "-2.5", " 7 ", "abc", None, "99999999999", "Unknown"], "string")
    assert listed(df.select(casts.to_int(df, "v"))) == [13, 13, 3, -3, 7, None, None, None, None]


def test_doubles_round_half_even(spark):
    df = column(spark, [12.5, 13.5, 0.5, 1.5, -0.5, None], "double")
    assert listed(df.select(casts.int_from_number(F.col("v")))) == [12, 14, 0, 2, 0, None]


def test_strict_and_lenient_dates(spark):
    df = column(spark, ["01/02/2025 03:04:05", "2025-02-01", "31/02/2025 00:00:00"], "string")
    lenient = df.select(casts.parse_time(F.col("v"), "dd/MM/yyyy HH:mm:ss", strict=False))
    assert listed(lenient) == [datetime(2025, 2, 1, 3, 4, 5), None, None]
    with pytest.raises(Exception):
        df.select(casts.parse_time(F.col("v"), "dd/MM/yyyy HH:mm:ss")).collect()


def test_conform_checks_not_null_and_rounds(spark):
    row = ("1_20250101000000", 1, datetime(2025, 1, 1), 7.5, "X", 1, 1, 0, 0)
    kinds = "voyage_id string, mmsi int, timestamp timestamp_ntz, draught double, destination string, month int, day int, hour int, minute int"
    good = casts.conform(spark.createDataFrame([row], kinds), VOYAGE)
    assert good.first().draught == 8
    assert [f.dataType for f in good.schema.fields] == [f.dataType for f in VOYAGE.fields]
    bad = spark.createDataFrame([(*row[:3], None, *row[4:])], kinds)
    with pytest.raises(Exception, match="draught must not be null"):
        casts.conform(bad, VOYAGE).collect()


def test_iso_weeks_cross_years(spark):
    days = [datetime(2024, 12, 30), datetime(2025, 1, 5), datetime(2027, 1, 1), datetime(2026, 12, 31)]
    df = column(spark, days, "timestamp_ntz")
    assert listed(df.select(times.iso_year_week(F.col("v")))) == ["2025-01", "2025-01", "2026-53", "2026-53"]
    assert listed(df.select(times.iso_week(F.col("v")))) == [1, 1, 53, 53]


def test_times(spark):
    ts = datetime(2025, 4, 13, 23, 59, 58, 999999)
    df = column(spark, [ts], "timestamp_ntz")
    v = F.col("v")
    assert df.select(times.to_second(v)).first()[0] == datetime(2025, 4, 13, 23, 59, 58)
    assert df.select(times.to_hour(v)).first()[0] == datetime(2025, 4, 13, 23)
    assert df.select(times.component_vector(v)).first()[0] == [2025, 3, 12, 6, 23, 59, 58]
    assert df.select(times.composite_id(F.lit(205168000), v)).first()[0] == "205168000_20250413235958"
    assert df.select(times.second_number(v)).first()[0] == 1744588798


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_hours_grow_with_time_in_any_zone(spark, zone):
    """Around a change of clocks in that zone: zone-less times must not notice it."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        stamps = [datetime(2025, 3, 9, h, m) for h in range(5) for m in (0, 30)]
        df = column(spark, stamps, "timestamp_ntz")
        hours = listed(df.orderBy("v").select(times.hour_number(F.col("v"))))
        assert hours == sorted(hours) and len(set(hours)) == 5
        assert listed(df.orderBy("v").select(times.to_second(F.col("v")))) == stamps
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_labels(spark):
    df = column(spark, ["Cargo", "Tanker", "Fishing", None], "string")
    v = F.col("v")
    assert listed(df.select(labels.grouped_ship_type(v))) == ["Cargo/Tanker", "Cargo/Tanker", "Other", "Other"]
    assert listed(df.select(labels.member_label(v))) == [1, 1, 0, 0]
    assert listed(df.select(labels.equals_label(v, "Cargo"))) == [1, 0, 0, 0]
    assert listed(df.select(labels.mapped_label(v, {"Cargo": 1, "Tanker": 0}))) == [1, 0, None, None]


def test_split_edges_are_half_open(spark):
    days = [datetime(2025, 4, 13, 23, 59, 59), datetime(2025, 4, 14), datetime(2025, 4, 17), datetime(2025, 4, 18), None]
    df = column(spark, days, "timestamp_ntz")
    assert listed(df.select(labels.split_label(F.col("v"), "2025-04-14", "2025-04-18"))) == ["train", "val", "val", "test", None]


def test_classes_and_shares(spark):
    df = spark.createDataFrame([([0.1, 0.9, 0.9], 0.0)], "v array<double>, s double")
    assert df.select(labels.class_by_argmax(F.col("v"))).first()[0] == 1
    assert df.select(labels.class_by_threshold(F.col("s"))).first()[0] == 0
    assert df.select(labels.percentage(F.lit(1), F.lit(3))).first()[0] == 33.33
    assert df.select(labels.percentage(F.lit(1), F.lit(0))).first()[0] is None
