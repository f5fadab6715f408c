"""Stage tables of one run: written once as Parquet, read with column pruning.

A run's tables lie in one folder below the shared checkpoint folder. ``close``
(or the end of a ``with`` block) removes it; what is left open is removed when
the driver's process ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path
from ..sources.files import remove


class StageStore:
    def __init__(self, spark: SparkSession, name: str = "run"):
        self.spark, self.folder = spark, scratch_path(spark, name)

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """Write ``df`` and go on from what was written."""
        path = f"{self.folder}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        remove(self.spark, self.folder)

    def __enter__(self) -> StageStore:
        return self

    def __exit__(self, *_) -> None:
        self.close()
