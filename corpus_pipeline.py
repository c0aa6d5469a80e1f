"""Corpus pipeline: stages of operators of ``redactum.llm`` over ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last
return the columns of their input, whatever they are; the last returns the
packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactum.llm import language, order_minhash, packing, repetition
from redactum.llm.common import prepare, stored, table, temp_name
from redactum.llm.queries import END_ID
from redactum.llm.tokens import default_path

#: least mean probability of the told language
LEAST_SCORE = 0.3


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that pass the repetition rules."""
    prepare(spark)
    name = temp_name(*docs.columns)
    return docs.withColumn(name, repetition.repetition(F.col("text"))).filter(F.col(f"{name}.kept")).drop(name)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents in a language that could be told, by a network trained on these documents.

    Without any labelled document, those that hold a letter stay.
    """
    prepare(spark)
    net = language.train(docs)
    if net is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    name = temp_name(*docs.columns)
    sure = (F.col(f"{name}.lang_pred") != language.UNKNOWN) & (F.col(f"{name}.score") >= LEAST_SCORE)
    return docs.withColumn(name, language.language(F.col("text"), net)).filter(sure).drop(name)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    return order_minhash.deduplicated(spark, docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences."""
    return packing.pack_documents(spark, docs, default_path("byte_bpe_50k.json"), END_ID)


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("near_dedup", near_dedup),
          ("best_fit_packing", best_fit_packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each over what the one before it has kept."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
