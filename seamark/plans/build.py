"""From raw messages to the five related tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamark.functions.casts import add_missing, conform, not_null, timestamp
from seamark.functions.times import composite_id, time_parts
from seamark.operators.joins import update_from
from seamark.operators.quantiles import medians_and_modes
from seamark.operators.ranking import first_row
from seamark.schema import MEDIAN_COLUMNS, MODE_COLUMNS, OFFSETS, POSITION, VESSEL, VESSEL_DETAILS, VOYAGE
from seamark.session import write_out
from seamark.sources.messages import typed
from seamark.sources.tables import write_table

FACT_ORDER = ["mmsi", "timestamp"]
SHIP_FIELDS = ["imo", "callsign", "shipname", "shiptype"]
POSITION_FIELDS = ["status", "turn", "speed", "lon", "lat", "course", "heading"]
# Metres from the antenna to a side of the ship; larger values are handled, only less evenly.
OFFSET_RANGE = (0, 512)
VOYAGE_FIELDS = ["draught", "destination", "eta"]


def in_period(
    df: DataFrame, start: object = None, end: object = None, time: str = "timestamp", day: str = "date"
) -> DataFrame:
    """Half-open period; either bound may be missing.

    A column ``day`` of dates is taken for the day of ``time``, as in the folders
    of ``write_messages``, and filtered as well, so that other days' folders aren't read.
    """
    dated = dict(df.dtypes).get(day) == "date"
    if start is not None:
        df = df.where(F.col(time) >= timestamp(start))
        df = df.where(F.col(day) >= timestamp(start).cast("date")) if dated else df
    if end is not None:
        df = df.where(F.col(time) < timestamp(end))
        df = df.where(F.col(day) <= timestamp(end).cast("date")) if dated else df
    return df


def first_days(df: DataFrame, days: int, time: str = "timestamp") -> DataFrame:
    """The first ``days`` days after the earliest row, which a scalar subquery finds."""
    earliest = df.agg(F.min(time)).scalar()
    return df.where(F.col(time) < earliest + F.make_dt_interval(F.lit(days)))


def vessels(messages: DataFrame) -> DataFrame:
    """One row per ship from its first message; equal times are told apart by the ship fields."""
    rows = messages.where(F.col("mmsi").isNotNull()).select("mmsi", "timestamp", *SHIP_FIELDS)
    return conform(first_row(rows, by=["mmsi"], order=["timestamp", *SHIP_FIELDS]), VESSEL)


def vessels_of(distinct: DataFrame) -> DataFrame:
    """``vessels`` from distinct messages, whose least ship fields of a ship's first time are those of its first message."""
    first = F.min(F.struct("timestamp", "ship")).alias("first")
    return conform(distinct.groupBy("mmsi").agg(first).select("mmsi", "first.ship.*"), VESSEL)


def payloads(messages: DataFrame) -> DataFrame:
    """(mmsi, timestamp, position, details, voyage, ship) of each message; what its conditions rule out is null."""

    def payload(fields: list[str], condition: Column | None = None) -> Column:
        made = F.struct(*fields)
        return made if condition is None else F.when(condition, made)

    return messages.where(F.col("mmsi").isNotNull()).select(
        "mmsi",
        "timestamp",
        payload(POSITION_FIELDS).alias("position"),
        payload(OFFSETS, F.coalesce(*OFFSETS).isNotNull()).alias("details"),
        payload(VOYAGE_FIELDS, F.col("draught").isNotNull()).alias("voyage"),
        payload(SHIP_FIELDS).alias("ship"),
    )


def least_payloads(rows: DataFrame) -> DataFrame:
    """One row per ship and time with the least payload of each kind, combined on the map side."""
    kinds = [c for c in rows.columns if c not in FACT_ORDER]
    return rows.groupBy(*FACT_ORDER).agg(*[F.min(c).alias(c) for c in kinds])


def distinct_messages(messages: DataFrame) -> DataFrame:
    """(mmsi, timestamp, position, details, voyage, ship): one row per ship and time.

    The three fact tables each keep one message per (mmsi, timestamp) under their
    own condition. Taking the least payload of each kind in a single aggregate
    lets one shuffle, combined on the map side, serve all three, and the ships too where it is stored.
    """
    return least_payloads(payloads(messages))


def _row_id() -> Column:
    return composite_id(F.col("mmsi"), F.col("timestamp"))


def positions(distinct: DataFrame, check: bool = True) -> DataFrame:
    rows = distinct.select("mmsi", "timestamp", "position.*")
    return conform(rows, POSITION, {"position_id": _row_id()}, check)


def vessel_details(distinct: DataFrame, check: bool = True) -> DataFrame:
    rows = distinct.where(F.col("details").isNotNull()).select("mmsi", "timestamp", "details.*")
    return conform(rows, VESSEL_DETAILS, {"vessel_details_id": _row_id()}, check)


def voyages(distinct: DataFrame, check: bool = True) -> DataFrame:
    rows = distinct.where(F.col("voyage").isNotNull()).select("mmsi", "timestamp", "voyage.*")
    return conform(rows, VOYAGE, {"voyage_id": _row_id(), **time_parts(F.col("eta"))}, check)


def geometry_stats(details: DataFrame, key: str = "mmsi", columns: list[str] = OFFSETS) -> DataFrame:
    """Medians (double) and modes of the offsets per ship."""
    stats = medians_and_modes(details, columns, key, bounds=OFFSET_RANGE)
    return stats.withColumns({f"mode_{c}": F.col(f"mode_{c}").cast(details.schema[c].dataType) for c in columns})


def with_geometry(ships: DataFrame, stats: DataFrame) -> DataFrame:
    """Add the eight columns to the ships and set them where statistics exist; medians round half to even."""
    columns = [*MEDIAN_COLUMNS, *MODE_COLUMNS]
    rounded = stats.withColumns({c: F.rint(c).cast("int") for c in MEDIAN_COLUMNS})
    return update_from(add_missing(ships, {c: "int" for c in columns}), rounded, "mmsi", columns)


class Tables:
    """The five tables of a period. Each is a lazy plan, put together when first asked for."""

    NAMES = ("vessel", "vessel_details", "voyage", "position", "port")

    def __init__(
        self, messages: DataFrame, distinct: DataFrame, ports: DataFrame, geometry: bool, ranged: bool = False
    ) -> None:
        self._messages, self._distinct, self._geometry = messages, distinct, geometry
        self.port = ports
        self.ranged = ranged

    @cached_property
    def ships(self) -> DataFrame:
        """The ships without their geometry; of stored messages, from these."""
        return vessels_of(self._distinct) if self.ranged else vessels(self._messages)

    @cached_property
    def vessel(self) -> DataFrame:
        return with_geometry(self.ships, geometry_stats(self.vessel_details)) if self._geometry else self.ships

    @cached_property
    def vessel_details(self) -> DataFrame:
        return vessel_details(self._distinct, check=not self.ranged)

    @cached_property
    def voyage(self) -> DataFrame:
        return voyages(self._distinct, check=not self.ranged)

    @cached_property
    def position(self) -> DataFrame:
        return positions(self._distinct, check=not self.ranged)

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(name, getattr(self, name)) for name in self.NAMES]


def build_tables(
    raw: DataFrame,
    ports: DataFrame,
    start: object = None,
    end: object = None,
    days: int | None = None,
    geometry: bool = True,
    strict: bool = True,
    store: bool = False,
) -> Tables:
    """The five tables of a period, or of the first ``days`` days.

    With ``store`` the deduplicated messages are written to the cluster's shared
    folder once, in ranges of ship and time, and all fact tables are plain
    projections of those files, as the ships are an aggregate of them; without it every
    table stays a lazy plan over ``raw``.
    """
    messages = in_period(typed(raw, strict), start, end)
    if days is not None:
        messages = first_days(messages, days)
    distinct = distinct_messages(messages)
    if store:
        # Keys are checked here, once; readers of the files get plain columns.
        checked = {c: not_null(F.col(c), f"{c} must not be null") for c in FACT_ORDER}
        distinct = write_out(distinct.withColumns(checked), "distinct-messages", FACT_ORDER)
    return Tables(messages, distinct, ports, geometry, ranged=store)


def write_tables(tables: Tables, folder: str) -> None:
    """Overwrite all five tables; fact tables are sorted by ship and time across and inside files."""
    for name, df in tables.items():
        sort = FACT_ORDER if "timestamp" in df.columns else []
        write_table(df, folder, name, sort=sort, ranged=tables.ranged)
