"""Queries of the training-data operators over the whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from objloom.llm import decontamination, jaccard, language, licenses, media, packing, quality, secrets, tokens, toxicity
from objloom.llm.common import held_out, table


def vocabulary_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.find_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs, vocabulary_file("byte_bpe_50k.json")).drop("text")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, vocabulary_file("piece_bpe_32k.model"))
    return language.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_media(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.recognise(docs).drop("text")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secrets": op1_secrets,
        "op2_tokens": op2_tokens,
        "op3_jaccard": op3_jaccard,
        "op4_language": op4_language,
        "op5_packing": op5_packing,
        "op6_media": op6_media,
        "op7_toxicity": op7_toxicity,
        "op8_decontamination": op8_decontamination,
        "op9_quality": op9_quality,
        "op10_licenses": op10_licenses,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    from objloom.llm import oracle

    return oracle.SQL
