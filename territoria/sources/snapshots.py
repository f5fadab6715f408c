"""Result tables refreshed as a whole: a new folder first, then one switch.

A refresh writes its rows to a folder of their own below the table's base
folder and only then points the table there. A write that dies leaves the table
on the folder it had; readers see the old rows or the new ones, never a mix.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from . import io
from .files import children, remove

SNAPSHOT = "snapshot-"


def location_of(spark: SparkSession, name: str) -> str:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").collect()
    return rows[0]["data_type"] if rows else ""


def refresh(spark: SparkSession, df: DataFrame, table: str, base: str, database: str | None = None,
            keep: int = 1) -> DataFrame:
    """Replace the rows of a result table; the table then lies below ``base``,
    whatever folder it had. ``keep`` earlier snapshots stay for running readers."""
    name = io.ensure_result_table(spark, table, base, database)
    before = location_of(spark, name)
    # names sort by age: a counter one above the snapshots that are there
    there = sorted(p for p in children(spark, base) if os.path.basename(p).startswith(SNAPSHOT))
    number = 1 + int(os.path.basename(there[-1])[len(SNAPSHOT):].split("-")[0]) if there else 0
    folder = f"{base}/{SNAPSHOT}{number:012d}-{uuid.uuid4().hex[:8]}"
    io.conform(df, table).write.parquet(folder)
    spark.sql(f"ALTER TABLE {name} SET LOCATION '{folder}'")
    spark.sql(f"REFRESH TABLE {name}")
    # the folder the table had goes last, before it those of earlier or dead writes
    had = os.path.basename(before.rstrip("/"))
    old = sorted(there, key=lambda p: (os.path.basename(p) == had, p))
    for path in old[: max(0, len(old) - keep)]:
        remove(spark, path)
    return spark.table(name)
