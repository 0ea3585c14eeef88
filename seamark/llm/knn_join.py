"""Exact search of the highest inner products by a Voronoi join."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamark.llm.common import ready, runs
from seamark.session import write_out

#: Most rows of a data block and queries of a query block, for vectors of up to 64 components: what one task holds at a time.
BLOCK_ROWS, BLOCK_QUERIES = 16384, 4096
#: Scores that are worked out at a time.
SCORES = 1 << 22
#: Sums of products below it are exact in doubles.
EXACT = float(1 << 53)


def scaled(vector: Column, scale: int = 256) -> Column:
    """Each component x as floor(scale * x); null for a vector that is null or holds a null, NaN or infinity."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: _floor(x.cast("double") * scale)))


def _floor(x: Column) -> Column:
    # floor() gives a long, which large doubles don't fit; they are whole already.
    return F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; short ones are filled up with zeros."""
    flat = np.asarray(vectors.flatten(), np.float64)
    lengths = np.asarray(vectors.value_lengths(), np.int64)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products; where doubles can't hold them, by whole numbers, kept within a long's range."""
    if queries.shape[1] * np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) < EXACT:
        return (queries @ rows.T).astype(np.int64)
    whole = queries.astype(object)
    least, most = -(1 << 63), (1 << 63) - 1
    out = np.empty((len(queries), len(rows)), np.int64)
    for j, row in enumerate(rows):
        ints = [int(x) for x in row]
        for i, q in enumerate(whole):
            out[i, j] = max(least, min(most, sum(int(a) * b for a, b in zip(q, ints, strict=True))))
    return out


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> list[np.ndarray]:
    """For each query the places of its k highest scores, ties to smaller ids, itself left out."""
    out = []
    for line, mine in zip(scores, own, strict=True):
        at = np.flatnonzero(ids != mine)
        if len(at) > k:
            floor = np.partition(line[at], len(at) - k)[len(at) - k]
            at = at[line[at] >= floor]
        out.append(at[np.lexsort((ids[at], ~line[at]))][:k])  # ~x orders like -x and can't overflow
    return out


def knn_join(vectors: DataFrame, is_query: Column, k: int = 5, id: str = "vec_id", vector: str = "vector") -> DataFrame:
    """(query_id, rank int, id long, score long): the ``k`` rows of the highest inner product with each query.

    ``vector`` holds whole numbers as doubles; a null one takes no part. Vectors of
    fewer components count as filled up with zeros. Ties go to the smaller id. Rows
    of the same id as the query are not its candidates; rows with a null id take no
    part. Of repeated rows of an id as query, the query is asked once per distinct vector.

    Pivots drawn by a hash split the space; every row joins the cell of its nearest
    pivot. Each cell is summed up by its row count and radius. For a query q and a
    cell with pivot p and radius r, all products lie within q.p +- |q| r. The lower
    ends of cells that hold k rows together bound the k-th score from below;
    cells whose upper end is under that bound can't matter (k and the rows of the query's own id, to be exact). Queries are grouped with
    those of near pivots, and cells with near ones into areas of the rows of a block. A query is sent once to each area
    it needs a cell of, with the list of these, and a cell to a query group only if one of its
    queries lists it. Blocks are solved locally and their k best merged.
    Areas and query groups are cut by a hash into blocks of bounded size, so neither a
    common vector nor a large cell lands in one task. With q queries and n rows, vectors are sent
    q n (1 / rows of a block + 1 / queries of a block) times at most.
    """
    spark = ready(vectors.sparkSession)
    kept = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("asks"))
    kept = write_out(kept.where("id IS NOT NULL AND v IS NOT NULL"), "vectors")
    count, width = kept.agg(F.count(F.lit(1)), F.greatest(F.max(F.size("v")), F.lit(1))).first()
    empty = f"query_id long, rank int, {id} long, score long"
    if not count:
        return spark.createDataFrame([], empty)
    drawn = max(1, round(math.sqrt(count) / 4))
    pivots = kept.select("v", F.xxhash64("id", "v").alias("h"), "id").orderBy("h", "id").limit(drawn)
    centres = np.zeros((drawn, width))
    for i, row in enumerate(pivots.collect()):
        centres[i, : len(row["v"])] = row["v"]
    centres = np.unique(centres, axis=0)
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches):
        pivot = shared.value
        square = (pivot**2).sum(1)
        for batch in batches:
            if not batch.num_rows:
                continue
            m = matrix(batch.column("v"), width)
            distance = square - 2 * (m @ pivot.T)
            cell = distance.argmin(1)
            radius = np.sqrt(((m - pivot[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell, pa.int32()), pa.array(radius)], [*batch.schema.names, "cell", "radius"]
            )

    placed = write_out(kept.mapInArrow(assign, "id long, v array<double>, asks boolean, cell int, radius double"), "placed")
    summary = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("radius").alias("radius")).collect()
    sizes, radii = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for row in summary:
        sizes[row["cell"]], radii[row["cell"]] = row["n"], row["radius"]
    wide = max(1, width // 64)
    # Smaller blocks for few rows, so that there are tasks for all cores.
    in_block, asking = max(1, min(BLOCK_ROWS, max(1024, count // 16)) // wide), max(1, BLOCK_QUERIES // wide)
    order = _in_line(centres)
    area, parts = _areas(order, sizes, in_block)
    askers = placed.where("asks").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()
    # So many rows of a query's own id may stand in the cells that bound its score.
    own = placed.where("asks").groupBy("id").count().agg(F.max("count")).first()[0] or 1
    group = _query_groups(order, {row["cell"]: row["n"] for row in askers}, asking)
    facts = spark.sparkContext.broadcast((sizes, radii, area, parts, group))

    def ask(batches):
        n, radius, areas, part, groups = facts.value
        pivot = shared.value
        live = np.flatnonzero(n)
        for batch in batches:
            if not batch.num_rows:
                continue
            q = matrix(batch.column("v"), width)
            middle = q @ pivot[live].T
            # Distances are rounded, so bounds are widened by far more than their error.
            slack = np.linalg.norm(q, axis=1)[:, None] * radius[live][None, :] * (1 + 1e-9) + 1e-6 * (1 + np.abs(middle))
            low, high = middle - slack, middle + slack
            by = np.argsort(-low, axis=1)
            enough = np.cumsum(n[live][by], axis=1) >= k + own
            at = np.where(enough.any(1), enough.argmax(1), len(live) - 1)
            bound = np.take_along_axis(low, np.take_along_axis(by, at[:, None], 1), 1)
            bound[~enough.any(1)] = -np.inf
            row, col = np.nonzero(high >= bound)
            cells = live[col]
            together = np.lexsort((areas[cells], row))
            row, cells = row[together], cells[together]
            edges = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(areas[cells], prepend=-1))
            row, first = row[edges], cells[edges]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(row)),
                    batch.column("v").take(pa.array(row)),
                    pa.array(groups[batch.column("cell").to_numpy()][row], pa.int32()),
                    pa.array(areas[first], pa.int32()),
                    pa.array(part[first], pa.int32()),
                    pa.ListArray.from_arrays(pa.array([*edges, len(cells)], pa.int32()), pa.array(cells, pa.int32())),
                ],
                ["id", "v", "of", "area", "parts", "cells"],
            )

    repeated = placed.where("asks").select("id", "v", "cell").distinct()
    asked = write_out(
        repeated.mapInArrow(ask, "id long, v array<double>, of int, area int, parts int, cells array<int>").withColumn(
            "block", F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30))
        ),
        "asked",
    )
    halves = F.ceil(F.count_distinct("id") / asking)
    blocks = write_out(asked.groupBy("of", "area", "parts").agg(halves.cast("int").alias("halves")), "blocks")
    needs = asked.select("of", "area", F.explode("cells").alias("cell")).distinct().join(blocks, ["of", "area"])
    asks = asked.join(blocks, ["of", "area", "parts"]).select(
        "of", "area", F.pmod("block", "halves").cast("int").alias("half"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), "id", "v",
    )
    data = placed.join(needs, "cell").select(
        "of", "area", F.explode(F.sequence(F.lit(0), F.col("halves") - 1)).alias("half"),
        F.pmod(F.xxhash64("id", "v"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("side"), "id", "v",
    )

    def solve(batches):
        for run in runs(batches, "of", "area", "half", "part"):
            run = run.combine_chunks()
            side, ids = run.column("side").to_numpy(), run.column("id").to_numpy()
            edge = int(np.searchsorted(side, 1))
            m = matrix(run.column("v").chunk(0), width)
            rows, block = ids[edge:], m[edge:]
            step = max(1, SCORES // max(1, len(rows)))
            for lo in range(0, edge, step):
                hi = min(edge, lo + step)
                scores = products(m[lo:hi], block)
                found = best(scores, rows, ids[lo:hi], k)
                asker = np.repeat(ids[lo:hi], [len(x) for x in found])
                line = np.repeat(np.arange(hi - lo), [len(x) for x in found])
                at = np.concatenate([*found, np.empty(0, np.int64)]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asker), pa.array(rows[at]), pa.array(scores[line, at])], ["query_id", "id", "score"]
                )

    keys = ["of", "area", "half", "part"]
    united = asks.unionByName(data).repartition(*keys).sortWithinPartitions(*keys, "side", "id")
    near = united.mapInArrow(solve, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias(id), "score"
    )


def _in_line(centres: np.ndarray) -> np.ndarray:
    """The cells in the order of their first principal direction."""
    middle = centres - centres.mean(0)
    direction = np.linalg.svd(middle, full_matrices=False)[2][0] if centres.shape[1] else np.zeros(0)
    return np.argsort(middle @ direction, kind="stable")


def _query_groups(order: np.ndarray, askers: dict[int, int], asking: int) -> np.ndarray:
    """A query group for each cell, cut by query count."""
    asked = np.array([askers.get(int(c), 0) for c in order], np.int64)
    group = np.empty(len(order), np.int32)
    group[order] = (np.cumsum(asked) - asked) // asking
    return group


def _areas(order: np.ndarray, sizes: np.ndarray, in_block: int) -> tuple[np.ndarray, np.ndarray]:
    """The area of each cell, and into how many blocks it is cut: cells next to each other share one of at most
    ``in_block`` rows, a larger cell is one of its own in several blocks."""
    area, parts = np.empty(len(sizes), np.int32), np.maximum(1, -(-sizes // in_block)).astype(np.int32)
    at, room = -1, 0
    for c in order:
        if sizes[c] > room or parts[c] > 1:
            at, room = at + 1, in_block
        area[c] = at
        room = 0 if parts[c] > 1 else room - sizes[c]
    return area, parts
