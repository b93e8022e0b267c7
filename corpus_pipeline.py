"""A training corpus from raw documents: five stages, each over all that the one before kept.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. All but the last return the columns of ``docs``; the
last returns the packed pieces. :func:`run` writes each stage's result as Parquet to the shared folder and reads it back.

Stages decide about rows, not about ids: a null or repeated ``doc_id`` is never why a row goes. Equal texts share their
fate in the similarity join; exact de-duplication before it leaves one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybeam.llm import exact_dedup, jaccard_join, language_id, packing, queries, secret_links
from tallybeam.llm.shared import id_or_least, small_batches, stored, text_or_empty, unused

LEAST_SCORE = 0.3  # of the language; a text whose best language is less likely has none


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter, or of which no language is likely, go."""
    small_batches(spark)
    net = language_id.fit(language_id.training_sample(docs, F.lit(True)))
    return language_id.with_language(docs, net, LEAST_SCORE)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest id."""
    return exact_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shingle similarity links, the one with the smallest id.

    The join works on texts, numbered by their hash, so that rows without an id or with a shared one stay apart. The few
    hashes that two texts share are told apart by another hash. Of documents with equal least ids the smaller number stays.
    """
    small_batches(spark)
    text = text_or_empty()
    first, second = F.xxhash64(text), F.xxhash64(F.sha2(text, 256))
    # Two of n texts share a hash with a chance of n * n / 2 ** 65, so this list has a row or two at any size.
    shared = docs.groupBy(first.alias("hash")).agg(F.min(second).alias("low"), F.max(second).alias("high")).filter("low != high")
    several = [r.hash for r in shared.select("hash").collect()]
    number = F.when(first.isin(several), second).otherwise(first) if several else first
    rows = docs.select(number.alias("doc_id"), "text")
    found = stored(jaccard_join.components(rows).select(F.col("doc_id").alias("number"), F.col("component_id").alias("component")), "components")
    # Ids of texts in groups of several. The texts themselves move once, to the list of those that go.
    linked = found.groupBy("component").agg(F.count_distinct("number").alias("n")).filter("n > 1").select("component")
    members = found.join(linked, "component", "left_semi").distinct()
    ids = docs.select(number.alias("number"), id_or_least().alias("id")).groupBy("number").agg(F.min("id").alias("id"))
    placed = members.join(ids, "number").withColumn("place", F.struct("id", "number"))
    kept = placed.groupBy("component").agg(F.min("place").alias("kept"))
    gone = stored(placed.join(kept, "component").filter("place != kept").select("number"), "near-copies")
    own = unused("number", docs)
    others = gone.select(F.col("number").alias(unused("gone", docs))).hint("merge")
    return docs.withColumn(own, number).join(others, F.col(own) == F.col(others.columns[0]), "left_anti").drop(own)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret that the scan reports replaced by a mark; a given ``n_chars`` follows the text."""
    small_batches(spark)
    clean = secret_links.redacted(docs)
    if "n_chars" not in docs.columns:
        return clean
    size = F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", size)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in sequences of at most 2048 tokens."""
    small_batches(spark)
    return packing.pack_documents(docs, queries.tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

# A trained network, shingle links and a tokenizer are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
