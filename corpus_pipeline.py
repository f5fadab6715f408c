"""Corpus pipeline: from raw documents to packed training sequences.

Stages take (spark, docs, sf_dir) and return the documents they keep, with all
columns; the last returns the packed pieces. Each stage works on everything its
predecessor kept.

* toxicity: documents that the classifier rejects go (null and empty texts stay)
* exact dedup: of equal texts the row with the largest doc_id stays
* n-gram Jaccard join: of each class of near duplicates (connected by five-word
  shingle similarity of 0.8 or more) the document with the smallest doc_id stays
* benchmark decontamination: documents with a benchmark window go
* best-fit packing: one row per piece with its sequence and offset
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from territoria.llm import chosen_path, packing, recipes, toxicity, winnow
from territoria.llm.common import table
from territoria.session import scratch_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more go; null and empty texts score as texts without any similar word and stay."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null counts as empty) the row with the largest doc_id stays; of rows equal in both, one."""
    return recipes.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the smallest doc_id stays; texts without words are a class of their own each."""
    return chosen_path.drop_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any benchmark window go; texts without words have none."""
    return winnow.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece; null and empty texts are one piece with the end id alone."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: the toxicity stage is a trained model, which SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages a Parquet table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
