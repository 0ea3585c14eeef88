"""Session settings and the one place that decides where intermediate tables go."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

_written: ContextVar[list[str] | None] = ContextVar("written", default=None)

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def shuffle_partitions(input_bytes: int, target_bytes: int = 256 << 20) -> int:
    """Partitions a shuffle starts with; adaptive execution merges small ones afterwards.

    The upper end keeps the number of map-reduce block pairs manageable; beyond
    it partitions grow and sorts spill.
    """
    return max(200, min(100_000, -(-input_bytes // target_bytes)))


def build_session(
    name: str = "seamark", master: str | None = None, input_bytes: int | None = None, **conf: str
) -> SparkSession:
    """A session with the settings the library expects.

    ``input_bytes``, the size of the data, sets where shuffles start. ``master`` and
    anything that depends on the cluster (memory, cores, ``spark.checkpoint.dir``)
    is left to the submitter unless given.
    """
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    sized = {}
    if input_bytes is not None:
        sized["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = str(shuffle_partitions(input_bytes))
    for key, value in {**SETTINGS, **sized, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    ``spark.checkpoint.dir`` if it is set, else a folder below the session's
    warehouse, which executors share as well. On a cluster a warehouse on the
    driver's own disk isn't shared, so the setting must be given there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local") and urlsplit(warehouse).scheme in ("", "file"):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors reach: {warehouse} may be the driver's own")
    return f"{warehouse}/_intermediate"


def in_ranges(df: DataFrame, sort: Sequence[str]) -> DataFrame:
    """Spread ``df`` over ranges of the sort columns and sort inside.

    Files written from it let readers of a key skip files and row groups, and a
    key with very many rows spreads over several files when a second column
    follows it.
    """
    return df.repartitionByRange(*sort).sortWithinPartitions(*sort)


def write_out(df: DataFrame, name: str, sort: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once under the shared folder and read it back.

    Used where several results are taken from one expensive table: the work is
    done once, lineage ends at the files, and readers still prune columns.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if (written := _written.get()) is not None:
        written.append(path)
    (in_ranges(df, sort) if sort else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove what ``write_out`` writes inside the block when the block ends.

    Results must be written or collected inside: frames read from the removed files can't be used afterwards.
    """
    token = _written.set([])
    try:
        yield
    finally:
        hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
        for written in _written.get() or []:
            path = hadoop.Path(written)
            path.getFileSystem(conf).delete(path, True)
        _written.reset(token)
