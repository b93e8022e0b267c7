"""Registered queries of the text operators, each over the whole ``documents`` table, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybeam.llm import (
    automaton_dedup,
    exact_dedup,
    jaccard_join,
    language_id,
    lm_scoring,
    packing,
    pieces,
    secret_links,
    sharding,
    simhash,
    suffix_dedup,
    token_alignment,
    whitening,
)
from tallybeam.llm.shared import small_batches


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer(name: str) -> str:
    """Where a vocabulary file lies on this machine; every worker has the same files."""
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(folds: int) -> Column:
    """Whether a document is held out: the fold of its id is 1."""
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds == 1


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), ~fold(5))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = language_id.fit(language_id.training_sample(docs, ~fold(3)))
    return language_id.identify(docs, net).withColumn("held_out", fold(3))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_links.find_secrets(documents(spark, sf_dir))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edited_fingerprints(documents(spark, sf_dir), queries=F.col("doc_id") % 50 == 0)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(documents(spark, sf_dir))


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digests(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(documents(spark, sf_dir))


def op10_automaton_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton_dedup.remove_repeats(documents(spark, sf_dir))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
    return token_alignment.summaries(documents(spark, sf_dir), *paths)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.even(documents(spark, sf_dir), 8)
    return found.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_lm_scoring,
        op2_language_id,
        op3_best_fit_packing,
        op4_suffix_dedup,
        op5_secret_scan,
        op6_simhash,
        op7_jaccard_join,
        op8_sentence_pieces,
        op9_exact_dedup,
        op10_automaton_dedup,
        op11_whitening,
        op12_token_alignment,
        op13_sharding,
    )
}

ORACLES = {
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}
