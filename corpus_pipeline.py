"""A corpus pipeline of five operators; each stage's result is written and read again as the next one's documents.

toxicity: rejected documents go.  near_duplicates: of each class of near
copies the document of the least id stays.  decontamination: documents that
hold a window of any benchmark item go, one item being enough.  secrets: secret
spans are replaced by a mark, and n_chars follows.  packing: the remaining
documents become packed sequences.

Defined results, for every stage: a null text is kept as it is by all stages
(it saves nothing, is like no other text, holds no window and no secret) and is
packed as the end id alone; of repeated rows (equal id and text) the stage
near_duplicates keeps one, so is it with equal texts, and ties go to the least
id; an empty table gives no rows; all stages but the last return the columns of
documents, extra ones included, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from objloom.llm import decontamination, jaccard, packing, queries, secrets, toxicity
from objloom.llm.common import shared_dir, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.distinct(docs)


def contaminated_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs, length_col="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, queries.vocabulary_file("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxic_out),
    ("near_duplicates", near_duplicates_out),
    ("decontamination", contaminated_out),
    ("secrets", secrets_out),
    ("packing", packed),
]
#: Compression lengths, MinHash and tokenizers have no SQL; stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        made.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
