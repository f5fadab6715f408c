"""Shared pieces of the operators: row identity, row filters, table cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from territoria.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from there.

    A later loss of executors rereads the written files. The session's context
    cleaner removes them when the frame is no longer used
    (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_key(column: str = "text") -> Column:
    """Second half of a row's identity, beside doc_id."""
    return F.xxhash64(text_of(column))


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, text) stands in ``kept`` (doc_id, text_key).

    ``kept`` has one row per pair. Of rows that repeat both doc_id and text one
    is returned. Null ids match null ids. Text moves once, by (doc_id, key).
    """
    names = docs.columns
    keyed = docs.withColumn("__key", text_key())
    k = kept.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__kept"))
    joined = keyed.join(k, keyed["doc_id"].eqNullSafe(k["__id"]) & (keyed["__key"] == k["__kept"]))
    first = Window.partitionBy(F.coalesce(F.col("doc_id"), F.lit(0)), F.col("doc_id").isNull(), "__key").orderBy(F.lit(0))
    return joined.withColumn("__n", F.row_number().over(first)).where("__n = 1").select(*names)
