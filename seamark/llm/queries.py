"""The registered queries of this subpackage, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamark.llm import (
    conversations,
    exact_dedup,
    jaccard_join,
    knn_join,
    language_id,
    nbest,
    packing,
    pii,
    quality,
    sharding,
    spelling,
    token_counts,
    toxicity,
)
from seamark.llm.common import held_out, ready, table

#: The key of the pseudonyms in the registered query and the pipeline; a deployment passes its own.
PSEUDONYM_KEY = "registered query"



def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register ``fn(spark, folder)`` under its own name, with its SQL if it has one."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = lambda spark, folder: fn(ready(spark), folder)
        if sql:
            ORACLES[fn.__name__] = sql.strip()
        return fn

    return add


@query()
def op1_shards(spark, folder):
    """All documents, shuffled into 24 shards whose row counts differ by one at most."""
    shards = sharding.write_shards(table(spark, folder, "documents"), 24)
    text = F.col("record.text")
    return shards.select(
        F.col("record.doc_id").alias("doc_id"),
        sharding.row_bytes(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query(
    r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
grams AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
           ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g
  FROM words),
sizes AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM grams),
flat AS (SELECT doc_id, hash(unnest(g)) AS h FROM grams),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM flat a JOIN flat b ON a.h = b.h AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT s.doc_id, s.n AS n_shingles, min(r.other) AS component_id,
       (SELECT count(*) FROM links l WHERE l.a = s.doc_id) AS n_links
FROM sizes s JOIN reach r USING (doc_id) GROUP BY ALL"""
)
def op2_ngram_jaccard(spark, folder):
    """Components of all documents under three-word shingles with a Jaccard similarity of 0.9 or more, and the number of links of each."""
    return jaccard_join.jaccard_components(table(spark, folder, "documents"), width=3, percent=90)


@query(
    r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""
)
def op3_exact_topk(spark, folder):
    """The five rows of the highest inner product with each row whose id is divisible by 50."""
    vectors = table(spark, folder, "embeddings").select("vec_id", knn_join.scaled(F.col("embedding")).alias("vector"))
    return knn_join.knn_join(vectors, F.col("vec_id") % 50 == 0, k=5)


@query()
def op4_token_counts(spark, folder):
    """Tokens of each line of every document, from one encoding of the whole document."""
    return token_counts.token_counts(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.tiktoken"), rule="most")


@query(
    r"""
WITH normal AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM normal WINDOW same AS (PARTITION BY t)"""
)
def op5_exact_dedup(spark, folder):
    """The document that stays for each document, with the hash of the normalised text."""
    found = exact_dedup.exact_dedup(table(spark, folder, "documents"), hash_all=True)
    return found.withColumnRenamed("full_hash", "text_sha256")


@query()
def op6_language_id(spark, folder):
    """The language of every document, by profiles learnt from those that are not held out."""
    docs = table(spark, folder, "documents").withColumn("held_out", held_out(F.col("doc_id")))
    taught = docs.where(~F.col("held_out")).select("text", "lang", language_id.picked(F.col("doc_id")).alias("pick"))
    found = language_id.identify(docs.select("doc_id", "held_out", "text"), language_id.learn(taught))
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query()
def op7_pii(spark, folder):
    """Every document's text with personal data replaced by pseudonyms, and the kinds replaced."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PSEUDONYM_KEY, kinds="kinds")


@query()
def op8_packing(spark, folder):
    """All documents packed into sequences of 4096 tokens."""
    return packing.pack(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"), capacity=4096)


@query()
def op9_nbest(spark, folder):
    """The three best segmentations of every document, their ids as checksums."""
    return nbest.nbest(table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model"), best=3, digest=True)


@query()
def op10_toxicity(spark, folder):
    """The toxicity of every document, by a machine learnt from labels that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    labels = table(spark, folder, "labels").where(~held_out(F.col("doc_id")))
    labels = labels.select("doc_id", F.col("toxic").alias("label"), language_id.picked(F.col("doc_id")).alias("pick"))
    machine = toxicity.learn(docs, labels)
    return toxicity.score(docs, machine).select("doc_id", "held_out", "score", "predicted")


@query()
def op11_quality(spark, folder):
    """The quality of every document, by trees learnt from labels that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    labels = table(spark, folder, "labels").where(~held_out(F.col("doc_id")))
    labels = labels.select("doc_id", F.col("quality").alias("label"), language_id.picked(F.col("doc_id")).alias("pick"))
    forest = quality.learn(docs, labels)
    return quality.score(docs, forest).select("doc_id", "held_out", "score", "predicted")


@query()
def op12_spelling_variants(spark, folder):
    """The near words, form and root of every word of six letters or more that all documents hold five times or more."""
    words = spelling.word_counts(table(spark, folder, "documents"), least=6, slips=199)
    return spelling.spelling_variants(words.where("n >= 5"), ratio=5)


@query()
def op13_conversation_repair(spark, folder):
    """What is wrong with every damaged conversation, and its cheapest repair."""
    return conversations.repair(conversations.damage(table(spark, folder, "conversations")))
