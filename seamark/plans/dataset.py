"""Keyed tables, databases and the registry users extend."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamark.functions.casts import fill_text, timestamp
from seamark.functions.labels import grouped_ship_type
from seamark.functions.times import to_second
from seamark.operators import profile
from seamark.operators.graph import dense_ids, rekey, renumber, up_to
from seamark.operators.ranking import first_row
from seamark.plans.build import Tables
from seamark.schema import DATABASE_KEYS, Keys
from seamark.session import write_out


@dataclass(frozen=True)
class KeyedTable:
    df: DataFrame
    keys: Keys


@dataclass(frozen=True)
class Database:
    """Keyed tables; ``resolved`` says that foreign keys without a parent are null, ``unique`` that primary keys of timed tables are neither null nor repeated."""

    tables: dict[str, KeyedTable]
    resolved: bool = False
    unique: bool = False

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name].df

    @property
    def frames(self) -> dict[str, DataFrame]:
        return {name: t.df for name, t in self.tables.items()}

    @property
    def times(self) -> dict[str, str | None]:
        return {name: t.keys.time for name, t in self.tables.items()}

    def with_frames(self, frames: dict[str, DataFrame]) -> Database:
        return Database({name: replace(t, df=frames[name]) for name, t in self.tables.items() if name in frames})

    def up_to(self, end: object | Column) -> Database:
        """Everything strictly before ``end``; static tables stay whole."""
        return self.with_frames(up_to(self.frames, self.times, timestamp(end)))

    def span(self) -> DataFrame:
        return profile.database_span(self.frames, self.times)

    def without(self, columns: Sequence[str], only: str | None = None) -> Database:
        """Drop columns that would give the target away, in all tables or in one. Keys and times stay."""

        def cut(name: str, t: KeyedTable) -> DataFrame:
            if only is not None and name != only:
                return t.df
            kept = {t.keys.primary, t.keys.time, *t.keys.foreign}
            return t.df.drop(*[c for c in columns if c not in kept])

        return self.with_frames({name: cut(name, t) for name, t in self.tables.items()})

    def stored(self) -> Database:
        """The same database with every table written once to the shared folder.

        Rekeying and graphs read each table several times, so they start from here.
        """
        kept = self.with_frames({name: write_out(t.df, name) for name, t in self.tables.items()})
        return replace(kept, resolved=self.resolved, unique=self.unique)

    def part(self, names: Sequence[str]) -> Database:
        """The named tables whole, with those that their foreign keys lead to; no other table is read by what follows."""
        wanted, more = set(), set(names)
        while more:
            wanted |= more
            more = {p for n in wanted for p in self.tables[n].keys.foreign.values()} - wanted
        return replace(self, tables={n: t for n, t in self.tables.items() if n in wanted})

    def rekeyed(self, timed: bool = True, store: bool = False) -> Database:
        """Keys as dense ids 0..n-1, in the order of the original keys.

        All foreign keys and the primary keys of static tables change; ``timed``
        says whether the row ids of timed tables, which nothing refers to, do too.
        With ``store`` the ids of static tables are written to the shared folder first:
        their size is then known, and small ones are broadcast to the fact tables.
        Where primary keys are ``unique``, rows of timed tables are numbered as they are sorted.
        """
        parents = {p for t in self.tables.values() for p in t.keys.foreign.values()}
        numbered = {n for n, t in self.tables.items() if timed and self.unique and n not in parents and t.keys.time is not None}
        ids = {
            name: dense_ids(t.df, t.keys.primary)
            for name, t in self.tables.items()
            if name not in numbered and (timed or name in parents or t.keys.time is None)
        }
        if store:
            small = [name for name in ids if self.tables[name].keys.time is None]
            ids.update({name: write_out(ids[name], f"ids-{name}") for name in small})
        frames = {}
        for name, t in self.tables.items():
            df = rekey(t.df, t.keys.primary, ids[name], t.keys.primary) if name in ids else t.df
            df = renumber(df, t.keys.primary) if name in numbered else df
            for column, parent in t.keys.foreign.items():
                df = rekey(df, column, ids[parent], self.tables[parent].keys.primary)
            frames[name] = df
        return replace(self.with_frames(frames), resolved=True, unique=self.unique)

    def text_filled(self, text_columns: dict[str, list[str]]) -> Database:
        return self.with_frames({n: fill_text(t.df, text_columns.get(n, [])) for n, t in self.tables.items()})

    def profiles(self) -> dict[str, DataFrame]:
        return {name: profile.null_profile(t.df) for name, t in self.tables.items()}


def ship_database(tables: Tables, unique: bool = False) -> Database:
    """The five tables with keys; ship types grouped in two, times to the second, one row per key.

    ``unique`` says that the tables already have one row per key, as freshly
    built ones with times in whole seconds do, and saves a shuffle of each.
    """
    ships = tables.ships.select(
        "mmsi", "imo", "callsign", "shipname", grouped_ship_type(F.col("shiptype")).alias("shiptype")
    )
    frames = {
        "vessels": ships,
        "vessels_details": tables.vessel_details,
        "ports": tables.port,
        "positions": tables.position,
        "voyages": tables.voyage,
    }
    keyed = {}
    for name, df in frames.items():
        keys = DATABASE_KEYS[name]
        if keys.time and not unique:
            df = df.withColumn(keys.time, to_second(F.col(keys.time)))
        if name != "ports" and not unique:
            rest = [c for c in df.columns if c != keys.primary]
            df = first_row(df, by=[keys.primary], order=rest)
        keyed[name] = KeyedTable(df, keys)
    return Database(keyed, unique=unique)


class Registry:
    """Named makers: a dataset maker returns a Database, a task maker a task table."""

    def __init__(self) -> None:
        self._makers: dict[str, Callable] = {}

    def register(self, name: str, maker: Callable) -> None:
        self._makers[name] = maker

    def get(self, name: str, *args, **kwargs):
        if name not in self._makers:
            raise KeyError(f"{name} is not registered; known: {self.names()}")
        return self._makers[name](*args, **kwargs)

    def names(self) -> list[str]:
        return sorted(self._makers)


DATASETS = Registry()
TASKS = Registry()
