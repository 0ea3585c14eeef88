"""Shuffled shards by a two-pass external shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamark.llm.common import fresh
from seamark.session import shared_folder, write_out

ROW_BYTES = 8


def row_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def running_starts(counts: DataFrame, group: int = 4096) -> DataFrame:
    """(bucket, start): the rows in all buckets before, summed in two levels so that no task sees all buckets."""
    coarse = F.floor(F.col("bucket") / group)
    tops = (
        counts.groupBy(coarse.alias("top")).agg(F.sum("rows").alias("top_rows"))
        .withColumn("before", F.sum("top_rows").over(Window.orderBy("top")) - F.col("top_rows"))
    )
    inside = Window.partitionBy("top").orderBy("bucket")
    return (
        counts.withColumn("top", coarse)
        .withColumn("inside", F.sum("rows").over(inside) - F.col("rows"))
        .join(tops, "top")
        .select("bucket", (F.col("before") + F.col("inside")).alias("start"))
    )


def spread_repeats(docs: DataFrame, name: str, most: int = 1000) -> DataFrame:
    """``docs`` with a number ``name`` that tells rows repeated whole apart where one comes more than ``most`` times.

    Such rows are told by 128 bits of hash, and replaced by as many copies of one of them; others have the number 0.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    known = [F.xxhash64(F.lit(k), *columns).alias(f"_{name}{k}") for k in (0, 1)]
    marked = docs.select(*columns, *known)
    names = [f"_{name}{k}" for k in (0, 1)]
    often = marked.groupBy(*names).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > most)
    often = write_out(often, "repeated")
    if often.isEmpty():
        return docs.withColumn(name, F.lit(0).cast("long"))
    one = marked.join(often.select(*names), names, "left_semi").groupBy(*names).agg(F.any_value(F.struct(*columns)).alias("record"))
    copies = one.join(often, names).select("record.*", F.explode(F.sequence(F.lit(1).cast("long"), F.col(name))).alias(name))
    rest = marked.join(often.select(*names), names, "left_anti").select(*columns, F.lit(0).cast("long").alias(name))
    return rest.unionByName(copies)


def write_shards(
    docs: DataFrame,
    shards: int,
    path: str | None = None,
    seed: int = 17,
    bucket_bytes: int = 16 << 20,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Write ``docs`` in random order into ``shards`` folders and read them back.

    Pass one scatters whole records into ``ceil(bytes / bucket_bytes)`` buckets by a
    seeded hash of key, text and, for rows repeated whole very often, their number. Pass two shuffles each bucket in memory (Spark's
    ``shuffle`` is Fisher-Yates) and writes it; the buckets follow one another in one
    long sequence, which is cut into ``shards`` stretches whose row counts differ by
    one at most. Returns (shard int, slot long, record struct of all columns);
    ``slot`` counts from 0 inside a shard without gaps.

    Copies of a text under many keys scatter like other rows. A null key or text is
    a value like any other and counts no text bytes; repeated rows stay repeated.
    An empty table gives no rows. A task holds one bucket, whose size doesn't depend
    on the input's; a text longer than a bucket is one record of its own.
    The order differs from run to run, so results are read from the files written:
    a task that is lost is run again and replaces all that it had written.
    """
    spark, columns = docs.sparkSession, docs.columns
    number = fresh(docs, "number")
    docs = spread_repeats(docs, number)
    total = docs.agg(F.sum(row_bytes(F.col(text))), F.count(F.lit(1))).first()
    buckets, rows = max(1, -(-(total[0] or 0) // bucket_bytes)), total[1]
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col(text), F.col(number)), F.lit(buckets))
    records = docs.select(bucket.alias("bucket"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("record"))
    starts = running_starts(docs.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("rows")))
    place = F.col("start") + F.col("at")
    shard = F.expr(f"((start + at + 1) * {shards} - 1) DIV {max(rows, 1)}")
    shuffled = (
        records.join(starts, "bucket")
        .groupBy("bucket", "start")
        .agg(F.shuffle(F.collect_list("record"), F.lit(seed)).alias("records"))
        .select("start", F.posexplode("records").alias("at", "record"))
        .select(shard.cast("int").alias("shard"), place.alias("place"), "record")
        .select("shard", F.expr(f"place - shard * {rows}L DIV {shards}").alias("slot"), "record")
    )
    path = path or f"{shared_folder(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    shuffled.write.partitionBy("shard").parquet(path)
    return spark.read.schema(shuffled.schema).parquet(path)
