"""Exact duplicates by progressive refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamark.llm.common import fresh, without
from seamark.session import write_out

SPACES = "[\\x20\\x09-\\x0D]+"


def normal_text(text: Column) -> Column:
    """The text with each run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def exact_dedup(
    docs: DataFrame, key: str = "doc_id", text: str = "text", prefix: int = 64, hash_all: bool = False
) -> DataFrame:
    """One row per document: (key, keep_id, group_size long, kept boolean, full_hash string).

    Documents are equal when their normalised texts are. They are grouped by length,
    then by a hash of their first ``prefix`` characters; the full SHA-256 is taken
    only of documents in groups of several, unless ``hash_all`` asks for every
    document's. Of equal documents the one with the smallest key stays, a null key
    only if all are null; of repeated rows one stays. A text alone in its group has
    ``group_size`` 1 and, without ``hash_all``, a null ``full_hash``.

    Two scans of the text, no shuffle of it as long as the crowded groups are small
    enough to broadcast by Spark's own limit; the hashes are counted before they
    are shuffled, so a group with a third of all rows is one row of a task.
    """
    body = normal_text(F.col(text))
    length, head = F.length(body), F.xxhash64(F.substring(body, 1, prefix))
    heads = docs.groupBy(length.alias("length"), head.alias("head")).agg(F.count(F.lit(1)).alias("n"))
    lengths = heads.groupBy("length").agg(F.sum("n").alias("in_length")).where("in_length > 1")
    crowded = write_out(
        heads.where("n > 1").join(lengths, "length", "left_semi").select("length", "head", F.lit(True).alias("crowded")),
        "crowded",
    )
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("body"), length.alias("length"), head.alias("head"))
    needed = F.lit(True) if hash_all else F.col("crowded")
    hashed = write_out(
        rows.join(crowded, ["length", "head"], "left").select(
            F.monotonically_increasing_id().alias("row"),
            "id",
            "crowded",
            F.when(needed, F.sha2(normal_text(F.col("body")).cast("binary"), 256)).alias("full_hash"),
        ),
        "hashed",
    )
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row")))
    groups = (
        hashed.where("crowded")
        .groupBy("full_hash")
        .agg(first.alias("first"), F.count(F.lit(1)).alias("size"))
        .where("size > 1")
        .select("full_hash", "size", F.col("first.id").alias("first_id"), F.col("first.row").alias("first_row"))
    )
    several = F.col("size").isNotNull()
    # Rows without a hash, most of them, are told apart by their number, as one null key would gather them.
    own = F.coalesce(F.col("full_hash"), F.col("row").cast("string"))
    return hashed.withColumn("own", own).join(groups.withColumnRenamed("full_hash", "own"), "own", "left").select(
        F.col("id").alias(key),
        F.when(several, F.col("first_id")).otherwise(F.col("id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("first_row"), F.lit(True)).alias("kept"),
        "full_hash",
    )


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns.

    Of rows that repeat both key and text one stays; rows that share a key but not
    the text are told apart by the text.
    """
    result = exact_dedup(docs, key, text)
    repeated = result.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    if not repeated:
        gone = write_out(result.where(~F.col("kept")).select(F.col(key).alias("gone_id")), "gone")
        return without(docs, key, gone, "gone_id")
    named = fresh(docs, "full_hash")
    hashed = docs.withColumn(named, F.sha2(normal_text(F.col(text)).cast("binary"), 256))
    id, hash = fresh(hashed, "id"), fresh(hashed, "hash")
    found = exact_dedup(docs, key, text, hash_all=True)
    stays = found.where("kept").select(F.col(key).alias(id), F.col("full_hash").alias(hash))
    one = hashed.join(stays, F.col(key).eqNullSafe(F.col(id)) & (F.col(named) == F.col(hash)), "left_semi")
    return one.dropDuplicates([key, named]).select(*docs.columns)
