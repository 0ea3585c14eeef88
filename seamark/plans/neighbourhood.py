"""Graph tables of a database and features of a seed's recent neighbourhood."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.operators.graph import latest_neighbours, neighbour_means, resolved_edges
from seamark.plans.dataset import Database
from seamark.session import write_out


def id_type(db: Database) -> str:
    """The type of all node ids: that of the keys, or text where tables have keys of several types."""
    kinds = set()
    for t in db.tables.values():
        kinds |= {dict(t.df.dtypes)[c] for c in (t.keys.primary, *t.keys.foreign)}
    return kinds.pop() if len(kinds) == 1 else "string"


def graph_nodes(db: Database) -> DataFrame:
    """(type, id, time) of a database's rows; static nodes have no time. Ids are those of the edges."""
    kind, out = id_type(db), None
    for name, t in db.tables.items():
        time = F.col(t.keys.time) if t.keys.time else F.lit(None)
        nodes = t.df.select(
            F.lit(name).alias("type"),
            F.col(t.keys.primary).cast(kind).alias("id"),
            time.cast("timestamp_ntz").alias("time"),
        )
        out = nodes if out is None else out.unionByName(nodes)
    return out


def graph_edges(db: Database) -> DataFrame:
    """(edge_type, child, parent, src, dst): one type per foreign key, and its reverse.

    A rekeyed database is read once per table: its keys are known to have a parent
    or to be null. Of any other, keys without a parent are set to null first.
    """
    kind, out = id_type(db), None
    for name, t in db.tables.items():
        if not t.keys.foreign:
            continue
        df = t.df.select(t.keys.primary, *t.keys.foreign)
        if not db.resolved:
            for column, parent in t.keys.foreign.items():
                known = db[parent].select(F.col(db.tables[parent].keys.primary).alias("_known")).distinct()
                df = df.join(known, F.col(column) == F.col("_known"), "left").drop(column).withColumnRenamed("_known", column)
        edges = resolved_edges(df, t.keys.primary, t.keys.foreign, kind).withColumn("child", F.lit(name))
        out = edges if out is None else out.unionByName(edges)
    return out.select("edge_type", "child", "parent", "src", "dst")


@dataclass(frozen=True)
class Hop:
    """One step from the rows reached so far to a timed table that shares ``key`` with them.

    ``carry`` names columns of the table that the next hop may use as its key.
    """

    name: str
    table: DataFrame
    key: str
    row_id: str
    k: int
    time: str = "timestamp"
    features: tuple[str, ...] = ()
    carry: tuple[str, ...] = ()


def expand(frontier: DataFrame, hop: Hop, seed: str, seed_time: str, store: bool = False) -> DataFrame:
    """The latest ``k`` rows of ``hop.table`` for each row of the frontier, as of the seed's time.

    The frontier is (node, seed, seed time, key); each of its rows asks by itself
    and gets at most ``k`` neighbours, so the limit holds before the next hop.
    """
    asks = frontier.select(
        F.struct(F.col(seed).alias("seed"), F.col("_node").alias("node")).alias("_ask"), seed_time, hop.key
    )
    taken = (hop.row_id, hop.time, hop.key)
    columns = [c for c in dict.fromkeys([*hop.features, *hop.carry]) if c not in taken]
    return latest_neighbours(
        asks,
        hop.table,
        hop.k,
        seed="_ask",
        key=hop.key,
        seed_time=seed_time,
        time=hop.time,
        row_id=hop.row_id,
        columns=columns,
        store=store,
    )


def neighbourhood_features(
    seeds: DataFrame, hops: Sequence[Hop], seed: str, seed_time: str, store: bool = False
) -> DataFrame:
    """(seed, seed time, n and mean features of each hop).

    The first hop starts from the seed's own key columns, each later one from the
    rows the hop before it reached. Means are over all rows a hop reached. With
    ``store`` the seeds and what each hop reached are written once to the shared
    folder, at most k rows per row of the frontier, and read from there.
    """
    if store:
        seeds = write_out(seeds, "seeds")
    frontier = seeds.withColumn("_node", F.lit(None).cast("string"))
    out = seeds.select(seed, seed_time)
    for hop in hops:
        found = expand(frontier, hop, seed, seed_time, store)
        reached = found.withColumns({seed: F.col("_ask.seed"), "_node": F.col(hop.row_id).cast("string")}).drop("_ask")
        if store:
            reached = write_out(reached, f"reached-{hop.name}")
        out = out.join(neighbour_means(reached, seed, hop.features, hop.name), seed, "left")
        frontier = reached.select(seed, seed_time, "_node", *hop.carry)
    counts = {f"n_{h.name}": F.coalesce(F.col(f"n_{h.name}"), F.lit(0).cast("long")) for h in hops}
    return out.withColumns(counts)
