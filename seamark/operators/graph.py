"""Foreign keys as a graph, and neighbours as of a point in time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamark.operators.ranking import ROWS, SLICE, TARGET, positions, time_slices
from seamark.session import write_out


def dense_ids(df: DataFrame, key: str, name: str = "node_id") -> DataFrame:
    """(key, name): 0..n-1 over the distinct keys of any type in order, nulls left out.

    Keys are written in sorted ranges between drawn keys, so keys far from all others, or
    that all begin alike, spread as well as any.
    """
    return positions(df.select(key).where(F.col(key).isNotNull()).distinct(), key, name)


def renumber(df: DataFrame, key: str) -> DataFrame:
    """``df`` with the dense ids of ``dense_ids`` in place of a key that each row has a value of its own for.

    Rows are numbered where they are sorted, so none is joined with its id.
    """
    rest = [c for c in df.columns if c != key]
    return positions(df, key, "_id", columns=rest).select(*[F.col("_id").alias(c) if c == key else F.col(c) for c in df.columns])


def rekey(df: DataFrame, column: str, ids: DataFrame, key: str, name: str = "node_id") -> DataFrame:
    """Replace a primary or foreign key by its dense id; a key without one becomes null."""
    found = ids.select(F.col(key).alias(column), F.col(name).alias("_id"))
    joined = df.join(found, column, "left")
    return joined.select(*[F.col("_id").alias(c) if c == column else F.col(c) for c in df.columns])


def foreign_key_edges(
    child: DataFrame, child_id: str, foreign: str, parent: DataFrame, parent_id: str, edge_type: str
) -> DataFrame:
    """(edge_type, src, dst) from each child row to the parent row it names."""
    known = parent.select(F.col(parent_id).alias("dst"))
    pairs = child.select(F.col(child_id).alias("src"), F.col(foreign).alias("dst")).where(F.col("dst").isNotNull())
    return pairs.join(known, "dst").select(F.lit(edge_type).alias("edge_type"), "src", "dst")


def reverse_edges(edges: DataFrame) -> DataFrame:
    return edges.select(
        F.concat(F.lit("rev_"), F.col("edge_type")).alias("edge_type"),
        F.col("dst").alias("src"),
        F.col("src").alias("dst"),
    )


def resolved_edges(child: DataFrame, child_id: str, foreign: Mapping[str, str], id_type: str) -> DataFrame:
    """(edge_type, parent, src, dst) both ways for all foreign keys of one table, in one pass over it.

    ``foreign`` maps key columns to their parents; a key is either null or the id
    of a row of its parent, as ``rekey`` leaves it, so no parent is looked up.
    """
    entries = []
    for column, parent in foreign.items():
        ends = F.col(child_id).cast(id_type), F.col(column).cast(id_type)
        for name, (src, dst) in ((f"f2p_{column}", ends), (f"rev_f2p_{column}", ends[::-1])):
            entry = F.struct(
                F.lit(name).alias("edge_type"), F.lit(parent).alias("parent"), src.alias("src"), dst.alias("dst")
            )
            entries.append(F.when(F.col(column).isNotNull(), entry))
    kept = F.filter(F.array(*entries), lambda e: e.isNotNull())
    return child.select(F.inline(kept))


def latest_neighbours(
    seeds: DataFrame,
    neighbours: DataFrame,
    k: int,
    *,
    seed: str,
    key: str,
    seed_time: str,
    time: str,
    row_id: str,
    columns: Sequence[str] = (),
    store: bool = False,
    target: int = TARGET,
) -> DataFrame:
    """The last ``k`` neighbour rows of each seed's key with ``time <= seed_time``.

    Counts per key and time slice give every neighbour a position without ordering all
    of them: they show which slices can hold one of the last ``k`` positions of
    any seed. Only rows of those slices are read on and placed, and meet the seeds in
    a join on (key, position), where each seed asks for at most ``k`` positions. No
    pair beyond the result is formed. A slice is an hour, or less where a key has more than
    ``target`` rows and seeds in one, so a hub's hour, second or instant is split; many seeds
    that ask for the same rows of a hub are a skewed join's one side, which Spark splits.

    With ``store`` the needed slices are written to the shared folder first. Their
    size is then known when the rows are read, so a small list is broadcast and
    filters the scan, where it otherwise takes a shuffle of all neighbours.

    Returns (seed, seed_time, key, hop_rank, row_id, time, columns), hop_rank 1 being the latest.
    """
    rows = neighbours.where(F.col(time).isNotNull() & F.col(key).isNotNull())
    asks = seeds.where(F.col(seed_time).isNotNull() & F.col(key).isNotNull())
    marks = rows.select(
        F.col(key).alias("_key"),
        F.col(time).alias("_time"),
        F.lit(0).alias("_kind"),
        F.col(row_id).cast("string").alias("_id"),
        F.struct(row_id, time, *columns).alias("_row"),
        F.lit(None).cast(seeds.schema[seed].dataType).alias("_seed"),
    )
    wishes = asks.select(
        F.col(key).alias("_key"),
        F.col(seed_time).alias("_time"),
        F.lit(1).alias("_kind"),
        F.col(seed).cast("string").alias("_id"),
        F.lit(None).cast(marks.schema["_row"].dataType).alias("_row"),
        F.col(seed).alias("_seed"),
    )
    both = marks.unionByName(wishes)
    sliced, counts = time_slices(both, ["_key"], "_time", ["_kind", "_id"], target, {"_asks": F.sum("_kind")})
    by_slice = Window.partitionBy("_key").orderBy(SLICE)
    here = F.col(ROWS) - F.col("_asks")
    before = F.sum(here).over(by_slice) - here
    # The count before the first slice from here on that has a seed: later seeds reach back less far.
    reached = F.min(F.when(F.col("_asks") > 0, F.col("_before"))).over(
        by_slice.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    )
    needed = (
        counts.withColumn("_before", before)
        .withColumn("_reached", reached)
        .where(F.col("_before") + here > F.col("_reached") - k)
        .select("_key", SLICE, "_before")
    )
    if store:
        needed = write_out(needed, "needed-slices")
    inside = Window.partitionBy("_key", SLICE).orderBy("_time", "_kind", "_id").rowsBetween(Window.unboundedPreceding, 0)
    at = F.col("_before") + F.sum(1 - F.col("_kind")).over(inside)
    line = write_out(sliced.join(needed, ["_key", SLICE]).withColumn("_at", at).drop(SLICE, "_before", "_id"), "line")
    # A row stands at its own position, a seed asks for k positions.
    placed = line.where("_kind = 0").select("_key", "_at", "_row")
    first = F.greatest(F.col("_at") - (k - 1), F.lit(1).cast("long"))
    asked = line.where("_kind = 1 AND _at > 0").select(
        "_key", "_seed", F.col("_time").alias("_seed_time"), F.col("_at").alias("_latest"), F.explode(F.sequence(first, "_at")).alias("_at")
    )
    return asked.join(placed, ["_key", "_at"]).select(
        F.col("_seed").alias(seed),
        F.col("_seed_time").alias(seed_time),
        F.col("_key").alias(key),
        (F.col("_latest") - F.col("_at") + 1).alias("hop_rank"),
        "_row.*",
    )


def neighbour_means(
    neighbours: DataFrame, seed: str, columns: Sequence[str], edge: str
) -> DataFrame:
    """(seed, n_edge, mean columns): average over each seed's neighbours of one edge type."""
    return neighbours.groupBy(seed).agg(
        F.count("*").alias(f"n_{edge}"),
        *[F.avg(c).alias(f"{edge}_{c}") for c in columns],
    )


def up_to(tables: Mapping[str, DataFrame], times: Mapping[str, str | None], end: Column) -> dict[str, DataFrame]:
    """A database as of a moment: timed tables cut before ``end``, static tables whole."""
    return {
        name: df.where(F.col(times[name]) < end) if times.get(name) else df for name, df in tables.items()
    }
