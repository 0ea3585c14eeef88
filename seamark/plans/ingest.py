"""Messages that arrive day by day: each ingest reads its own files and rewrites only the days and ships they touch.

Everything stored merges by smallest values: of the messages of one ship and time the
least payload stays, of a ship's first messages the earliest. So files may
come late, twice, or in any order, and an ingest that broke off is simply run again; the
tables are those of one build over all files.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamark.functions.casts import conform
from seamark.functions.times import iso_week_text, iso_year_week
from seamark.operators.quantiles import medians_and_modes_by_key
from seamark.plans import build, weekly
from seamark.schema import OFFSETS, VESSEL
from seamark.session import in_ranges, write_out
from seamark.sources.messages import read_daily_text, typed

#: Folders that the ships are dealt into.
SHIP_FOLDERS = 64
FIRST = ["timestamp", *build.SHIP_FIELDS]


class DayStore:
    """A folder with the merged messages by day, what is counted of each day, the ships, and a ledger of the files read."""

    SCHEMAS = {
        "ledger": "file string",
        "offsets": "mmsi int, column string, value double, n long, date date",
        "activity": "mmsi int, n long, date date",
    }

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def ingest(self, files: Sequence[str], read: Callable[[SparkSession, Sequence[str]], DataFrame] = read_daily_text, strict: bool = True) -> list[str]:
        """Read the files that the ledger doesn't name and merge them in; the files read.

        ``read(spark, files)`` gives raw messages. Those without a ship or a time are left out. The ledger is written last.
        """
        known = {r["file"] for r in self._open("ledger").collect()}  # names of files, one a day
        new = sorted(set(files) - known)
        if not new:
            return []
        raw = typed(read(self.spark, new), strict).where("mmsi IS NOT NULL AND timestamp IS NOT NULL")
        raw = write_out(raw.withColumn("date", F.to_date("timestamp")), "new-messages")
        fresh = build.payloads(raw).drop("ship")
        ships = raw.groupBy("mmsi").agg(F.min(F.struct(*FIRST)).alias("first"))
        self._merge_days(fresh, [r["date"] for r in raw.select("date").distinct().collect()])
        self._merge_ships(ships.withColumn("part", F.pmod(F.hash("mmsi"), F.lit(SHIP_FOLDERS))))
        self._write(self.spark.createDataFrame([(f,) for f in new], self.SCHEMAS["ledger"]), "ledger", "append")
        return new

    def _open(self, name: str, schema=None) -> DataFrame:
        """A stored table, empty before the first ingest."""
        path = f"{self.folder}/{name}"
        if schema is None:
            schema = self.spark.createDataFrame([], self.SCHEMAS[name]).schema if name in self.SCHEMAS else self._schema(name)
        self.spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def _schema(self, name: str):
        return self.spark.read.parquet(f"{self.folder}/{name}").schema

    def _write(self, df: DataFrame, name: str, mode: str = "overwrite", by: str | None = None) -> None:
        """Write all of ``df``, or with ``by`` the folders that it has rows for, which it may itself be read from.

        Spark puts such folders in place of the old ones when all rows are written.
        """
        writer = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.folder}/{name}")

    def _merge_days(self, fresh: DataFrame, days: list) -> None:
        """Days that are touched are merged with what is there and written anew, with their counts; no other folder is read.

        New and old messages meet in one aggregate, whose rows are written once; the counts are taken from the days' folders.
        """
        dated = [*fresh.columns, F.to_date("timestamp").alias("date")]
        schema = fresh.select(*dated).schema
        there = self._open("messages", schema).where(F.col("date").isin(days))
        merged = build.least_payloads(fresh.unionByName(there.drop("date"))).select(*dated)
        self._write(in_ranges(merged, ["date", "mmsi", "timestamp"]), "messages", by="date")
        merged = self._open("messages", schema).where(F.col("date").isin(days))
        entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"details.{c}").cast("double").alias("value")) for c in OFFSETS])
        values = merged.where("details IS NOT NULL").select("date", "mmsi", F.inline(entries)).where("value IS NOT NULL")
        counts = values.groupBy("mmsi", "column", "value", "date").agg(F.count(F.lit(1)).alias("n"))
        activity = merged.groupBy("mmsi", "date").agg(F.count(F.lit(1)).alias("n"))
        for name, df in (("offsets", counts), ("activity", activity)):
            self._open(name)
            # A day without offsets any more can't be: merging never takes a message away.
            # Days share tasks or are split over several, by their size.
            self._write(df.hint("rebalance", "date").select("mmsi", *[c for c in df.columns if c not in ("mmsi", "date")], "date"), name, by="date")

    def _merge_ships(self, ships: DataFrame) -> None:
        parts = [r["part"] for r in ships.select("part").distinct().collect()]  # SHIP_FOLDERS at most
        there = self._open("ships", ships.schema).where(F.col("part").isin(parts))
        merged = ships.unionByName(there).groupBy("mmsi", "part").agg(F.min("first").alias("first")).select(*ships.columns)
        self._write(write_out(merged, "merged-ships").repartition("part"), "ships", by="part")

    def tables(self, ports: DataFrame, start: object = None, end: object = None, geometry: bool = True) -> StoredTables:
        """The five tables; a period reads its days' folders. Ships, and their geometry, are those of all days."""
        return StoredTables(self, ports, start, end, geometry)

    def weekly_counts(self, ships: DataFrame, target: str = "shiptype") -> DataFrame:
        """``weekly.weekly_counts`` from the stored counts of each day and ship."""
        day = F.col("date").cast("timestamp_ntz")
        counted = self._open("activity").groupBy("mmsi", iso_year_week(day).alias("year_week"), iso_week_text(day).alias("week_number"))
        return weekly.per_class(counted.agg(F.sum("n").alias("_n")), ships, "mmsi", target, ["year_week", "week_number"])


class StoredTables(build.Tables):
    """The tables of a store. Medians and modes come from the days' counts of values, not from the messages."""

    def __init__(self, store: DayStore, ports: DataFrame, start: object, end: object, geometry: bool) -> None:
        messages = build.in_period(store._open("messages"), start, end)
        super().__init__(messages, messages, ports, geometry, ranged=True)
        self._store = store

    @property
    def ships(self) -> DataFrame:
        return conform(self._store._open("ships").select("mmsi", "first.*"), VESSEL)

    @property
    def vessel(self) -> DataFrame:
        if not self._geometry:
            return self.ships
        stats = medians_and_modes_by_key(self._store._open("offsets"), OFFSETS, "mmsi", build.OFFSET_RANGE)
        return build.with_geometry(self.ships, stats.withColumns({f"mode_{c}": F.col(f"mode_{c}").cast("int") for c in OFFSETS}))
