"""The training-data pipeline: documents in a known language, without copies, without personal data, packed.

Every stage takes (spark, docs, sf_dir) and all that its predecessor kept; all but the last
return the columns of ``docs``. Texts and ids may be null or repeated, tables
empty, and further columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamark.llm import exact_dedup, jaccard_join, language_id, packing, pii
from seamark.llm.common import fresh, ready, within, without
from seamark.llm.queries import PSEUDONYM_KEY, vocabulary
from seamark.session import write_out

#: Below this cosine with every language a text is no more like one than chance makes it (two standard deviations).
LEAST_SCORE = 2 / language_id.DIMENSIONS**0.5
#: Of fewer letters, and so n-grams, the cosine is mostly noise and rejects nothing.
LEAST_LETTERS = 20


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learnt from ``lang``; those without a letter go, and those of ``LEAST_LETTERS`` or more that are like none of them.

    Where no row has a language nothing can be learnt, and all documents stay.
    """
    ready(spark)
    taught = docs.select("text", "lang", language_id.picked(F.col("doc_id")).alias("pick"))
    prototypes = language_id.learn(taught)
    if not prototypes:
        return docs
    # Found beside renamed copies, so that columns called like the findings stay what they are.
    names = {c: f"own {c}" for c in docs.columns}
    held = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    found = language_id.identify(held.withColumn("text", F.col("`own text`")), prototypes)
    few = F.length(F.regexp_replace("own text", r"[^\p{L}\p{M}]+", "")) < LEAST_LETTERS
    kept = found.where((F.col("lang_pred") != language_id.UNKNOWN) & ((F.col("score") >= LEAST_SCORE) | few))
    return kept.select(*[F.col(f"`{n}`").alias(c) for c, n in names.items()])


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal documents, the one with the smallest id."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that five-word shingles link at a similarity of 0.8 or more, the one with the smallest id.

    Rows are told apart by id and text, so rows that share an id go or stay one by one; rows that
    repeat both are one document. Rows without an id stay only where no row with one is in the group.
    """
    row, rid = F.xxhash64("doc_id", "text"), fresh(docs, "row")
    found = jaccard_join.jaccard_components(docs.select(row.alias("doc_id"), "text"), width=5, percent=80)
    groups = found.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component_id")
    linked = found.join(groups, "component_id").select(F.col("doc_id").alias("linked"), "component_id")
    linked = write_out(linked.distinct(), "linked")
    ids = docs.select(row.alias("row"), F.col("doc_id").alias("id"))
    ids = within(ids, "row", linked, "linked").join(linked, F.col("row") == F.col("linked")).select("row", "id", "component_id")
    ids = write_out(ids.distinct(), "members")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    stays = ids.groupBy("component_id").agg(first.alias("first")).select("component_id", F.col("first.row").alias("stays"))
    gone = ids.join(stays, "component_id").where("row <> stays").select(F.col("row").alias("gone_row"))
    gone = write_out(gone.distinct(), "gone")
    return without(docs.withColumn(rid, row), rid, gone, "gone_row").select(*[F.col(f"`{c}`") for c in docs.columns])


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data; ``n_chars`` follows the text where that changes."""
    before = fresh(docs, "before")
    out = pii.pseudonymise(docs.withColumn(before, F.col("text")), PSEUDONYM_KEY)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        same = F.col("text").eqNullSafe(F.col(before))
        out = out.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), capacity=4096)


STAGES = [
    ("language_id", language),
    ("exact_dedup", copies),
    ("ngram_jaccard", near_copies),
    ("pii", private),
    ("packing", packed),
]

#: No SQL for the profiles, the pseudonyms and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = write_out(stage(spark, docs, sf_dir), name)
    return docs
