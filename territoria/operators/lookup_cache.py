"""Lookup results kept between runs: files are added, none is rewritten.

The cache is a folder of Parquet files dealt by a hash of the key. New results
are compared with the folders of their own keys only, and what is not cached yet
is appended; so k results cost reads of their folders' keys and k written rows,
whatever the size of the cache. A cached key is never looked up again: of two
results of one key the one written first stays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import exists
from .common import cut_lineage

BUCKETS = 64


class LookupCache:
    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str = "query", buckets: int = BUCKETS):
        self.spark, self.folder, self.key, self.buckets, self.schema = spark, folder, key, buckets, schema
        self.columns = spark.createDataFrame([], schema).columns

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        if not exists(self.spark, self.folder):
            return self.spark.createDataFrame([], f"{self.schema}, bucket int")
        return self.spark.read.schema(f"{self.schema}, bucket int").parquet(self.folder)

    def read(self) -> DataFrame:
        return self._stored().select(*self.columns)

    def upsert(self, results: DataFrame, order: Sequence[str] | None = None) -> int:
        """Add the results of keys not cached yet, the first by ``order`` of each; returns their number."""
        others = [c for c in self.columns if c != self.key]
        rank = F.struct(*[F.col(c) for c in (order or others)])
        first = (results.groupBy(self.key).agg(F.min_by(F.struct(*others), rank).alias("_first"))
                 .select(self.key, "_first.*").withColumn("bucket", self._bucket()))
        first = cut_lineage(first)
        touched = [r[0] for r in first.select("bucket").distinct().collect()]  # at most ``buckets``
        known = self._stored().where(F.col("bucket").isin(touched)).select("bucket", self.key)
        new = cut_lineage(first.join(known, ["bucket", self.key], "left_anti").select(*self.columns, "bucket"))
        added = new.count()
        if added:
            new.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self.folder)
        return added
