"""Declared schemas, keys and the values that define the ship-type task."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

INT, LONG, DOUBLE, TEXT, TIME = (
    T.IntegerType(),
    T.LongType(),
    T.DoubleType(),
    T.StringType(),
    T.TimestampNTZType(),
)


def struct(*columns: tuple[str, T.DataType] | tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(c[0], c[1], c[2] if len(c) > 2 else True) for c in columns])


OFFSETS = ["to_bow", "to_stern", "to_port", "to_starboard"]
MEDIAN_COLUMNS = [f"median_{c}" for c in OFFSETS]
MODE_COLUMNS = [f"mode_{c}" for c in OFFSETS]

# A message as it is stored: dates are text, the offsets and imo may be text.
RAW_MESSAGE = struct(
    ("mmsi", INT),
    ("timestamp", TEXT),
    ("lat", DOUBLE),
    ("lon", DOUBLE),
    ("speed", DOUBLE),
    ("course", DOUBLE),
    ("heading", DOUBLE),
    ("turn", DOUBLE),
    ("status", TEXT),
    ("draught", DOUBLE),
    ("destination", TEXT),
    ("eta", TEXT),
    ("imo", TEXT),
    ("callsign", TEXT),
    ("shipname", TEXT),
    ("shiptype", TEXT),
    ("to_bow", TEXT),
    ("to_stern", TEXT),
    ("to_port", TEXT),
    ("to_starboard", TEXT),
)

VESSEL = struct(
    ("mmsi", INT, False),
    ("imo", INT),
    ("callsign", TEXT),
    ("shipname", TEXT),
    ("shiptype", TEXT),
)
VESSEL_DETAILS = struct(
    ("vessel_details_id", TEXT),
    ("mmsi", INT, False),
    ("timestamp", TIME, False),
    *[(c, INT) for c in OFFSETS],
)
VOYAGE = struct(
    ("voyage_id", TEXT),
    ("mmsi", INT, False),
    ("timestamp", TIME, False),
    ("draught", INT, False),
    ("destination", TEXT),
    ("month", INT),
    ("day", INT),
    ("hour", INT),
    ("minute", INT),
)
POSITION = struct(
    ("position_id", TEXT),
    ("mmsi", INT, False),
    ("timestamp", TIME, False),
    ("status", TEXT),
    ("turn", INT),
    ("speed", INT),
    ("lon", INT),
    ("lat", INT),
    ("course", INT),
    ("heading", INT),
)
PORT = struct(
    ("port_id", INT),
    ("port_code", TEXT),
    ("port_name", TEXT),
    ("country_code", TEXT),
    ("country_name", TEXT),
    ("polygon", TEXT),
)
COUNTRY = struct(("CountryCode", TEXT), ("CountryName", TEXT))
LOSS = ("epoch", INT)
METRICS = ["average_precision", "accuracy", "f1", "roc_auc"]


@dataclass(frozen=True)
class Keys:
    """Primary key, foreign keys (column to table) and time column of a table."""

    primary: str | None
    foreign: dict[str, str] = field(default_factory=dict)
    time: str | None = None


DATABASE_KEYS = {
    "vessels": Keys("mmsi"),
    "vessels_details": Keys("vessel_details_id", {"mmsi": "vessels"}, "timestamp"),
    "ports": Keys("port_code"),
    "positions": Keys("position_id", {"mmsi": "vessels"}, "timestamp"),
    "voyages": Keys("voyage_id", {"mmsi": "vessels", "destination": "ports"}, "timestamp"),
}

# Fixed values of the task: they must equal the published ones for equal results.
CARGO_OR_TANKER = ["Cargo", "Tanker"]
GROUPED_LABELS = {"Cargo/Tanker": 1, "Other": 0}
DATE_FORMAT = "dd/MM/yyyy HH:mm:ss"
