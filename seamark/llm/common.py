"""What several operators of this subpackage share: names, splits, worker set-up, runs of sorted rows."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, and see few texts at a time.

    A cluster on which the package is installed, or shipped with the job, doesn't need the first.
    The second sets the session's rows per Arrow batch, unless it has been set, as whole texts are far
    longer than the values its default is meant for.
    """
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{ROOT}:{known}".rstrip(":")
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "1000")
    return spark


def frugal(job: Callable) -> Callable:
    """``job``, after whose last batch the worker gives memory it has freed back to the system, as workers stay and wait between stages."""

    def run(batches):
        yield from job(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return run


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def others(df: DataFrame, *names: str) -> list[Column]:
    """The columns of ``df`` but for those called like one of ``names`` in any case, as Spark doesn't tell cases apart."""
    gone = {n.lower() for n in names}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in gone]


def held_out(doc_id: Column) -> Column:
    """Every fifth document by the checksum of its id; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys in one partition, next to each other."""
    return rows.repartition(*keys).sortWithinPartitions(*keys)


#: Buckets of a sieve: a bound on what it broadcasts, whatever the corpus.
SIEVE = 1 << 20


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SIEVE))


def within(docs: DataFrame, key: str, ids: DataFrame, id: str) -> DataFrame:
    """Rows of ``docs`` whose key is in ``ids``, and some others: those that share a bucket with one.

    Put before a join it keeps most texts that the join would drop out of its shuffle.
    At most ``SIEVE`` numbers are broadcast; with far more ids than that nearly all rows pass.
    """
    sieve = fresh(docs, "sieve")
    buckets = ids.select(_bucket(F.col(id)).alias(sieve)).distinct()
    return docs.join(F.broadcast(buckets), _bucket(F.col(key)) == F.col(sieve), "left_semi")


def without(docs: DataFrame, key: str, ids: DataFrame, id: str) -> DataFrame:
    """Rows of ``docs`` whose key, null included, is not in ``ids``; only rows that share a bucket with an id are compared and shuffled."""
    sieve, sought = fresh(docs, "sieve"), fresh(docs, "sought")
    ids = ids.select(F.col(id).alias(sought))
    buckets = ids.select(_bucket(F.col(sought)).alias(sieve)).distinct()
    clear = docs.join(F.broadcast(buckets), _bucket(F.col(key)) == F.col(sieve), "left_anti")
    return clear.unionByName(within(docs, key, ids, sought).join(ids, F.col(key).eqNullSafe(F.col(sought)), "left_anti"))


def runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal keys, from batches of rows sorted by them."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if kept:
            last = kept[-1].slice(kept[-1].num_rows - 1)
            if any(last.column(k)[0] != batch.column(k)[0] for k in keys):
                yield pa.Table.from_batches(kept)
                kept = []
        edges = [0]
        if batch.num_rows > 1:
            changed = None
            for k in keys:
                differs = pc.not_equal(batch.column(k).slice(1), batch.column(k).slice(0, batch.num_rows - 1))
                changed = differs if changed is None else pc.or_(changed, differs)
            edges += [i + 1 for i in pc.indices_nonzero(changed).to_pylist()]
        for lo, hi in zip(edges, [*edges[1:], None], strict=True):
            piece = batch.slice(lo) if hi is None else batch.slice(lo, hi - lo)
            kept.append(piece)
            if hi is not None:
                yield pa.Table.from_batches(kept)
                kept = []
    if kept:
        yield pa.Table.from_batches(kept)
