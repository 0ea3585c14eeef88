"""Similarity join of documents on word shingles by blocked sparse products."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.llm.common import frugal, ready, runs, spread
from seamark.llm.components import components
from seamark.llm.shingles import shingle_sets
from seamark.operators.reduction import sieve, sift
from seamark.session import write_out

#: Cells of the table of shingle frequencies, which has the same size for every corpus.
CELLS, SLICES = 1 << 20, 256
#: Common rare shingles that a linked pair must have, where its sets allow so many: so many, and one more for each ``EVERY`` of the smaller set.
SHARED, EVERY = 4, 32
#: Up to so many documents, the pairs of a shingle's documents are listed; of more, documents are at most tied to the first.
LISTED = 48
#: Of one block: shingles, and documents.
BLOCK_SHINGLES, BLOCK_DOCS = 1 << 19, 1 << 12
#: Of one row block of the product: documents, and terms of its sparse part.
ROWS, TERMS = 128, 1 << 21


def needed(size: np.ndarray, percent: int) -> np.ndarray:
    """Least number of a set's shingles that a set linked with it must share."""
    return -(-size * percent // 100)


def least_shared(size: np.ndarray) -> np.ndarray:
    """Common rare shingles that a pair must have whose smaller set has this size, where it must share so many at all.

    In proportion to the size, as long sets that have little in common share a few rare shingles by chance, in a large corpus more often.
    """
    return SHARED + size // EVERY


def cell(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(44)).astype(np.int64)


def frequencies(docs: DataFrame, width: int) -> np.ndarray:
    """How often shingles of each cell occur over all documents: ``CELLS`` numbers."""

    def count(batches):
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            sets = [np.empty(0, np.uint64), *shingle_sets(batch.column(0), width)]
            total += np.bincount(cell(np.concatenate(sets)), minlength=CELLS)
        parts = np.minimum(total, (1 << 32) - 1).astype("<u4").reshape(SLICES, -1)
        yield slices(range(SLICES), parts)

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                totals[k] = totals.get(k, 0) + np.frombuffer(part, "<u4").astype(np.int64)
        yield slices(totals, [np.minimum(t, (1 << 32) - 1).astype("<u4") for t in totals.values()])

    def slices(keys, parts):
        counts = pa.array([p.tobytes() for p in parts], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(list(keys), pa.int32()), counts], ["slice", "counts"])

    kind = "slice int, counts binary"
    parts = docs.mapInArrow(frugal(count), kind).repartition("slice").mapInArrow(frugal(add), kind).collect()
    whole = np.zeros((SLICES, CELLS // SLICES), np.uint32)
    for part in parts:
        whole[part["slice"]] = np.frombuffer(part["counts"], "<u4")
    return whole.reshape(-1)


def rare_shingles(shingles: np.ndarray, ranks: np.ndarray, percent: int) -> np.ndarray:
    """The part of a set that must hold ``least_shared`` shingles of any set linked with it (all it shares, if fewer)."""
    keep = len(shingles) - int(needed(np.int64(len(shingles)), percent)) + least_shared(len(shingles))
    if keep >= len(shingles):
        return shingles
    return shingles[np.lexsort((shingles, ranks[cell(shingles)]))[:keep]]


def summaries(docs: DataFrame, width: int, percent: int, ranks: Broadcast) -> DataFrame:
    """(doc_id, size, same, rare): set size, a hash of the whole set, its rare shingles."""

    def summarise(batches):
        for batch in batches:
            sizes, same, rare = [], [], []
            for shingles in shingle_sets(batch.column(1), width):
                sizes.append(len(shingles))
                same.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None)
                rare.append(rare_shingles(shingles, ranks.value, percent).view(np.int64))
            flat = np.concatenate([*rare, np.empty(0, np.int64)])
            edges = np.cumsum([0, *map(len, rare)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(same, pa.binary()), pa.ListArray.from_arrays(edges, flat)],
                ["doc_id", "size", "same", "rare"],
            )

    return docs.mapInArrow(frugal(summarise), "doc_id long, size long, same binary, rare array<long>")


def list_pairs(nodes: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, least) for the pairs of near sizes of the documents of one shingle, which are sorted by size; ``least`` is how many rare shingles linked ones share."""
    i, j = np.triu_indices(len(nodes), 1)
    near = needed(sizes[j], percent) <= sizes[i]
    i, j = i[near], j[near]
    return nodes[i], nodes[j], np.minimum(least_shared(sizes[i]), needed(sizes[j], percent)).astype(np.int32)


def list_ties(nodes: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): each document of one shingle, which are sorted by size, tied to the first one of its stretch of near sizes."""
    far = np.flatnonzero(needed(sizes[1:], percent) > sizes[:-1]) + 1
    start = np.zeros(len(nodes), np.int64)
    start[far] = far
    start = np.maximum.accumulate(start)
    tied = start != np.arange(len(nodes))
    return nodes[start[tied]], nodes[tied]


def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
    """(shingle, nodes, sizes) of each shingle with several documents, from rows of (shingle, node, size) sorted by them."""
    keys = nodes = sizes = np.empty(0, np.int64)

    def ended(k, n, s):
        again = (k[1:] == k[:-1]) & (n[1:] == n[:-1])  # rows repeated whole
        if again.any():
            k, n, s = (x[np.concatenate([[True], ~again])] for x in (k, n, s))
        edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]])) if len(k) else np.zeros(1, np.int64)
        return [(k[lo], n[lo:hi], s[lo:hi]) for lo, hi in zip(edge[:-1], edge[1:], strict=True) if hi - lo > 1]

    for batch in batches:
        k, n, s = (np.concatenate([old, batch.column(i).to_numpy()]) for i, old in enumerate((keys, nodes, sizes)))
        if not len(k):
            continue
        cut = int(np.searchsorted(k, k[-1]))  # the last list may go on in the next batch
        yield ended(k[:cut], n[:cut], s[:cut])
        keys, nodes, sizes = k[cut:], n[cut:], s[cut:]
    yield ended(keys, nodes, sizes)


def candidates(rare: DataFrame, percent: int) -> DataFrame:
    """(a, b): edges that connect all linked nodes, from rows of (shingle, node, size) of their rare shingles.

    Pairs of short lists are added up. Long lists give none; their rows are counted by node, and a pair may share as many
    shingles more as the one with fewer such rows has. Only where these alone could be enough for a link is a node tied
    to others in its long lists.
    """
    listed = LISTED

    def pairs(batches):
        for found in lists(batches):
            short = [list_pairs(n, s, percent) for _, n, s in found if len(n) <= listed]
            if short:
                a, b, least = map(np.concatenate, zip(*short, strict=True))
                lo, hi = np.minimum(a, b), np.maximum(a, b)
                gap = pa.nulls(len(lo), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi), pa.array(least), gap, gap], ["a", "b", "least", "shingle", "size"])
            long = [(np.full(len(n), k), n, s) for k, n, s in found if len(n) > listed]
            if long:
                k, n, s = map(np.concatenate, zip(*long, strict=True))
                gap = pa.nulls(len(k), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(n), gap, gap.cast(pa.int32()), pa.array(k), pa.array(s)], ["a", "b", "least", "shingle", "size"])

    def ties(batches):
        for found in lists(batches):
            tied = [list_ties(n, s, percent) for _, n, s in found]
            if tied:
                a, b = map(np.concatenate, zip(*tied, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def by_list(rows):
        return rows.repartition("shingle").sortWithinPartitions("shingle", "size", "node")

    found = by_list(rare).mapInArrow(frugal(pairs), "a long, b long, least int, shingle long, size long")
    # Pairs of a list of equal shingles meet again in other tasks, so what is written is not yet added up.
    found = write_out(found, "listed")
    long = found.where("b IS NULL").select("shingle", F.col("a").alias("node"), "size")
    hot = write_out(long.groupBy("node").agg(F.count(F.lit(1)).alias("hot"), F.first("size").alias("size")), "hot")
    shared = found.where("b IS NOT NULL").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.max("least").alias("least"))
    for side in ("a", "b"):
        shared = shared.join(hot.select(F.col("node").alias(side), F.col("hot").alias(f"hot_{side}")), side, "left")
    more = F.least(F.coalesce("hot_a", F.lit(0)), F.coalesce("hot_b", F.lit(0)))
    enough = shared.where(F.col("shared") + more >= F.col("least")).select("a", "b")
    # The smallest set that one may be linked with asks for the fewest shingles.
    smallest = F.ceil(F.col("size") * percent / 100)
    fewest = F.least(F.lit(SHARED) + F.floor(smallest / EVERY), smallest)
    alone = hot.where(F.col("hot") >= fewest).select("node")
    tied = by_list(long.join(alone, "node").select("shingle", "node", "size")).mapInArrow(frugal(ties), "a long, b long")
    return enough.union(tied)


def linked_pairs(sets: list[np.ndarray], percent: int, part: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, overlap) of all linked pairs of one block: sparse product of sets by shingles, row block by row block.

    Overlaps are added up per shingle; pairs below the overlap that their sizes ask
    for are no links. With ``part``, a number for each set, only pairs of sets of
    different parts are given. Each pair is given once, at most ``ROWS`` rows of the product at a time.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    count = len(sets)
    flat = np.concatenate([sets[i] for i in order])
    doc = np.repeat(np.arange(count), sizes[order])
    _, column, often = np.unique(flat, return_inverse=True, return_counts=True)
    shared = often[column] > 1
    by = np.argsort(column[shared], kind="stable")
    doc, column = doc[shared], column[shared]
    posted = doc[by]
    _, first, often = np.unique(column[by], return_index=True, return_counts=True)
    column = np.unique(column, return_inverse=True)[1]
    common = often > max(16, count // 32)
    dense_at = np.cumsum(common) - 1
    dense = np.zeros((count, int(common.sum())), np.float32)
    held = common[column]
    dense[doc[held], dense_at[column[held]]] = 1
    rest_doc, rest_column = doc[~held], column[~held]
    size = sizes[order]
    terms = np.concatenate([[0], np.cumsum(np.bincount(rest_doc, often[rest_column], minlength=count))])
    hi = 0
    while hi < count:
        lo = hi
        hi = min(lo + ROWS, max(lo + 1, int(np.searchsorted(terms, terms[lo] + TERMS, "right")) - 1))
        last = int(np.searchsorted(needed(size, percent), size[hi - 1], "right"))
        width = last - lo
        if width < 2:
            continue
        overlap = dense[lo:hi] @ dense[lo:last].T
        own = slice(*np.searchsorted(rest_doc, [lo, hi]))
        row, col = rest_doc[own] - lo, rest_column[own]
        times = often[col]
        if len(col):
            begin = np.repeat(first[col], times)
            step = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            other = posted[begin + step]
            rows = np.repeat(row, times)
            ok = (other >= lo) & (other < last)
            overlap += np.bincount(rows[ok] * width + other[ok] - lo, minlength=(hi - lo) * width).reshape(hi - lo, width)
        linked = (100 + percent) * overlap >= percent * (size[lo:hi, None] + size[None, lo:last])
        if part is not None:
            linked &= part[order[lo:hi], None] != part[None, order[lo:last]]
        i, j = np.nonzero(np.triu(linked, 1))
        yield order[lo + i], order[lo + j], overlap[i, j].astype(np.int64)


class Ties:
    """Keeps which sets of a block hang together, and gives of new links those that join what did not."""

    def __init__(self, count: int):
        self.label = np.arange(count)

    def joining(self, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, int]]:
        """Pairs of (i, j), whose equal ``i`` stand together, that connect sets not connected before."""
        if not len(i):
            return
        edges = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1], [True]]))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            a, label = int(i[lo]), self.label
            met, at = np.unique(label[j[lo:hi]], return_index=True)
            new = met != label[a]
            if new.any():
                yield from ((a, int(j[lo + k])) for k in at[new])
                label[np.isin(label, met[new])] = label[a]


class Sets(NamedTuple):
    """What the join knows before it multiplies."""

    docs: DataFrame  # (doc_id, text)
    all_docs: DataFrame  # (doc_id, size, same, rare) of every row
    usable: DataFrame  # of these, rows with an id and a set
    classes: DataFrame  # (same, class, node, copies): a set's number, the smallest id of its rows, and how many they are
    sets: DataFrame  # the usable rows of each class's node
    blocks: DataFrame  # (class, component): within a component lie all links


def _blocked(docs: DataFrame, width: int, percent: int) -> Sets:
    spark = ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranks = spark.sparkContext.broadcast(frequencies(docs.select("text"), width))
    all_docs = write_out(summaries(docs, width, percent, ranks), "summaries")
    usable = all_docs.where("doc_id IS NOT NULL AND same IS NOT NULL")
    classes = usable.groupBy("same").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    # Texts of one id may be linked with each other, so classes are told by numbers; they are read from what is written.
    classes = write_out(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    sets = usable.join(classes, "same").where("doc_id = node")
    rare = sets.select(F.explode("rare").alias("shingle"), F.col("class").alias("node"), "size")
    # Where a set must share fewer than ``least_shared`` with a linked one, all of these are in its rare part.
    enough = candidates(rare.select("shingle", "node", "size"), percent)
    blocks = write_out(components(enough).withColumnRenamed("node", "class"), "blocks")
    return Sets(docs, all_docs, usable, classes, sets, blocks)


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles long, component_id, n_links long): documents linked at ``100 * intersection >= percent * union`` of their shingle sets.

    1. The frequency of all shingles, in a table of fixed size, gives an order in
       which rare ones come first.
    2. Each document keeps the first shingles of that order; of those, linked documents share
       at least ``least_shared`` of the smaller one's size (all, where sets are too small for so many).
       Documents with equal sets go on as one.
    3. For each of these shingles its documents pair up; shared shingles are added
       up and pairs below the bound dropped. Long lists only tie, in a chain, those
       documents that could be linked by shingles of long lists alone.
    4. Components of the pairs are the blocks within which all links lie. A block's
       sets are multiplied with one another; a large one is cut by size and by a hash into
       parts of bounded size, and all pairs of parts whose sizes allow a link are multiplied.
    5. Components of the links. ``n_links`` adds up, for a row, the rows of all sets
       linked with its own and the other rows of its own set.

    No pairs of a large group are written. A document without words has size 0 and is
    its own component; a null ``doc_id`` has no component and links with nothing.
    Rows that repeat an id are one document that links wherever one of its texts does;
    ``n_links`` is each row's own, and counts other rows, also those of its id.
    """
    known = _blocked(docs, width, percent)
    links = block_links(known, width, percent)
    copies = known.usable.join(known.classes, "same").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    found = components(links.where("b IS NOT NULL").select("a", "b").union(copies.distinct()))
    across = links.where("b IS NULL").groupBy("same").agg(F.sum("links").alias("across"))
    count = F.col("copies") - 1 + F.coalesce("across", F.lit(0))
    counted = known.classes.join(across, "same", "left").select("same", count.alias("n_links")).where("n_links > 0")
    # Rows without a set would meet in one task by their null key, so they stay out of the join.
    linked = known.usable.select("doc_id", "size", "same").join(counted, "same", "left")
    alone = known.all_docs.where("doc_id IS NULL OR same IS NULL").select("doc_id", "size", F.lit(0).cast("long").alias("n_links"))
    rows = linked.select("doc_id", "size", F.coalesce("n_links", F.lit(0)).alias("n_links")).union(alone)
    own = F.coalesce(F.col("component"), F.col("doc_id"))
    return rows.join(found, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", F.col("size").alias("n_shingles"), own.alias("component_id"), "n_links"
    )


def jaccard_pairs(docs: DataFrame, width: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """The join as pairs: (set_a, set_b, overlap long, size_a long, size_b long) of every two linked sets, and (doc_id, set) of every row with a set.

    A set is named by a hash of its shingles, ``set_a`` the smaller one. Each pair of sets stands once, whatever number of rows
    have them, so rows with equal sets, which are linked too, are never multiplied out; joining the pairs with the second frame
    twice does that. The pairs are as many as the links between different sets are. Rows without an id or a set are in neither frame.
    """
    known = _blocked(docs, width, percent)
    return block_links(known, width, percent, pairs=True), known.usable.select("doc_id", F.col("same").alias("set"))


def placed(known: Sets, percent: int) -> DataFrame:
    """(node, same, size, copies, component, part, others): the members of blocks, the part each is in, and the parts whose sets it may be linked with.

    A block of up to ``BLOCK_SHINGLES`` and ``BLOCK_DOCS`` is one part. A larger one is cut into levels of sizes, so wide that
    only sets of the same or the next level can be linked, and these by a hash into parts of bounded size.
    """
    step = max(math.log(100 / percent), 0.01) * (1 + 1e-6)  # a little wider, as logarithms are rounded
    level = F.floor(F.log(F.col("size").cast("double")) / step).cast("long")
    members = known.sets.select("class", "node", "same", "size", "copies").distinct().join(known.blocks, "class")
    members = write_out(members.select("node", "same", "size", "copies", "component", level.alias("level")), "members")
    totals = members.groupBy("component", "level").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("docs"))
    large = totals.groupBy("component").agg(F.sum("total").alias("total"), F.sum("docs").alias("docs"))
    large = large.where((F.col("total") > BLOCK_SHINGLES) | (F.col("docs") > BLOCK_DOCS)).select("component")
    parts = F.greatest(F.ceil(F.col("total") / BLOCK_SHINGLES), F.ceil(F.col("docs") / BLOCK_DOCS))
    cut = write_out(totals.join(large, "component").select("component", "level", parts.cast("long").alias("parts")), "levels")
    beside = cut.select("component", F.explode(F.array(F.col("level") - 1, "level", F.col("level") + 1)).alias("level"), F.struct("level", "parts").alias("near"))
    cut = write_out(cut.join(beside.groupBy("component", "level").agg(F.collect_list("near").alias("near")), ["component", "level"]), "levels")

    def named(level, part):
        return F.shiftleft(level, 32) + part

    others = F.flatten(F.transform("near", lambda x: F.transform(F.sequence(F.lit(0).cast("long"), x["parts"] - 1), lambda k: named(x["level"], k))))
    own = named(F.col("level"), F.pmod(F.xxhash64("same"), F.col("parts")))
    whole = F.lit(0).cast("long")
    return members.join(cut, ["component", "level"], "left").select(
        "node", "same", "size", "copies", "component", F.coalesce(own, whole).alias("part"), F.coalesce(others, F.array(whole)).alias("others")
    )


def block_links(known: Sets, width: int, percent: int, pairs: bool = False) -> DataFrame:
    """The links within blocks.

    (a, b, null, null): links that connect the documents of a block, and (null, null, same, links):
    a set and the rows linked with it by one product, to be added up; with ``pairs`` all
    (set_a, set_b, overlap, size_a, size_b).
    """
    members = placed(known, percent)
    texts = sift(known.docs, sieve(members, ["node"]), ["doc_id"]).join(members, F.col("doc_id") == F.col("node"))
    texts = texts.select("node", "same", "copies", "component", "part", F.explode("others").alias("other"), "text")
    rows = texts.select(
        "component", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "same", "copies", "text"
    )

    def multiply(batches):
        for run in runs(batches, "component", "i", "j"):
            run = run.combine_chunks()
            nodes, copies, of = (run.column(c).to_numpy() for c in ("node", "copies", "part"))
            same = run.column("same").to_pylist()
            across = run.column("i")[0] != run.column("j")[0]  # links within a part are of its product with itself
            kept: dict[bytes, tuple[int, np.ndarray]] = {}
            at = 0
            for chunk in run.column("text").chunks:
                for k, shingles in enumerate(shingle_sets(chunk, width), at):
                    # A repeated id brings all its texts; each counts for the set it was listed for.
                    if same[k] == hashlib.blake2b(shingles.tobytes(), digest_size=16).digest():
                        kept[same[k]] = (k, shingles)
                at += len(chunk)
            if len(kept) < 2:
                continue
            rows, sets = zip(*kept.values(), strict=True)
            rows, names = np.array(rows), list(kept)
            found = linked_pairs(list(sets), percent, of[rows] if across else None)
            yield from listed(found, names, sets) if pairs else tied(found, names, nodes[rows], copies[rows])

    def listed(found, names, sets):
        names, sizes = np.array(names, object), np.array([len(s) for s in sets], np.int64)
        for i, j, overlap in found:
            turned = names[i] > names[j]
            i, j = np.where(turned, j, i), np.where(turned, i, j)
            columns = [pa.array(names[i], pa.binary()), pa.array(names[j], pa.binary()), pa.array(overlap), pa.array(sizes[i]), pa.array(sizes[j])]
            yield pa.RecordBatch.from_arrays(columns, ["set_a", "set_b", "overlap", "size_a", "size_b"])

    def tied(found, names, nodes, copies):
        ties, count = Ties(len(nodes)), np.zeros(len(nodes), np.int64)
        a, b = [], []
        for i, j, _ in found:
            np.add.at(count, i, copies[j])
            np.add.at(count, j, copies[i])
            for x, y in ties.joining(i, j):
                a.append(int(nodes[x]))
                b.append(int(nodes[y]))
        linked = np.flatnonzero(count)
        gap, none = [None] * len(a), [None] * len(linked)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(a + none, pa.int64()),
                pa.array(b + none, pa.int64()),
                pa.array(gap + [names[k] for k in linked], pa.binary()),
                pa.array(gap + count[linked].tolist(), pa.int64()),
            ],
            ["a", "b", "same", "links"],
        )

    kind = "set_a binary, set_b binary, overlap long, size_a long, size_b long" if pairs else "a long, b long, same binary, links long"
    return write_out(spread(rows, "component", "i", "j").mapInArrow(frugal(multiply), kind), "links")
