"""Timestamps: ids, parts, ISO weeks, truncation and slices.

Everything is derived from fields of the timestamp, never by way of an instant,
so zone-less timestamps give the same answer under every session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "1970-01-01"


def composite_id(key: Column, ts: Column) -> Column:
    """``key_yyyyMMddHHmmss``; null when either part is null."""
    return F.concat(key.cast("string"), F.lit("_"), F.date_format(ts, "yyyyMMddHHmmss"))


def time_parts(ts: Column) -> dict[str, Column]:
    return {
        "month": F.month(ts),
        "day": F.dayofmonth(ts),
        "hour": F.hour(ts),
        "minute": F.minute(ts),
    }


def iso_week(ts: Column) -> Column:
    return F.weekofyear(ts)


def iso_week_text(ts: Column) -> Column:
    return F.lpad(F.weekofyear(ts).cast("string"), 2, "0")


def iso_year_week(ts: Column) -> Column:
    """``YYYY-ww`` with the ISO year, so it sorts by time across a year's end."""
    year = F.extract(F.lit("YEAROFWEEK"), ts).cast("string")
    return F.concat_ws("-", F.lpad(year, 4, "0"), iso_week_text(ts))


def to_second(ts: Column) -> Column:
    fraction = F.extract(F.lit("SECOND"), ts) - F.second(ts)
    zero = F.lit(0)
    return ts - F.make_dt_interval(zero, zero, zero, fraction)


def to_hour(ts: Column) -> Column:
    zero = F.lit(0)
    return ts - F.make_dt_interval(zero, zero, F.minute(ts), F.extract(F.lit("SECOND"), ts))


def day_number(ts: Column) -> Column:
    return F.datediff(F.to_date(ts), F.lit(EPOCH).cast("date")).cast("long")


def hour_number(ts: Column) -> Column:
    """Hours since 1970 by the clock. Grows with ``ts``: the slice for ranks by time."""
    return day_number(ts) * 24 + F.hour(ts)


def second_number(ts: Column) -> Column:
    return hour_number(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 by the clock."""
    part = F.extract(F.lit("SECOND"), ts) - F.second(ts)
    return second_number(ts) * 1_000_000 + F.round(part * 1_000_000).cast("long")


def component_vector(ts: Column) -> Column:
    """[year, month-1, day-1, weekday with Monday 0, hour, minute, second]."""
    return F.array(
        F.year(ts),
        F.month(ts) - 1,
        F.dayofmonth(ts) - 1,
        F.weekday(ts),
        F.hour(ts),
        F.minute(ts),
        F.second(ts),
    )
