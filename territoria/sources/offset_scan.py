"""Tabular text files whose table begins some lines below the top of each file.

The files are read as lines, in splits. Only the split that starts a file holds
its first lines, and a task reads a split's lines in order, so the lines to
skip are recognised where they are read: no numbering of all lines, no second
pass, no shuffle. What is left goes through ``from_csv`` with the schema.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SkipFirstLines:
    """Task function: lines without the first ``skip`` of every file.

    Rows are (value, file, start): the file's hash and the split's first byte.
    A file whose first split ends within the lines to skip is an error, because
    the rest of them is read by another task.
    """

    def __init__(self, skip: int):
        self.skip = skip

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seen, later = None, 0, set()
        for batch in batches:
            files, starts = batch.column("file").to_numpy(), batch.column("start").to_numpy()
            keep = np.ones(len(files), dtype=bool)
            changes = np.flatnonzero(np.diff(files, prepend=files[:1] - 1) | np.diff(starts, prepend=starts[:1]))
            for first, end in zip(changes.tolist(), [*changes[1:].tolist(), len(files)]):
                if (files[first], starts[first]) != current:
                    self._closed(current, seen)
                    current, seen = (files[first], starts[first]), 0
                if starts[first] == 0 and seen < self.skip:
                    here = min(end, first + self.skip - seen)
                    keep[first:here] = False
                    seen += here - first
                elif starts[first] > 0:
                    later.add(files[first])
            yield pa.RecordBatch.from_arrays([batch.column("value").filter(pa.array(keep))], names=["value"])
        self._closed(current, seen)

    def _closed(self, current, seen: int) -> None:
        if current is not None and current[1] == 0 and 0 < seen < self.skip:
            raise ValueError(f"a file's first split holds {seen} of the {self.skip} lines to skip; "
                             "the file is shorter, or spark.sql.files.maxPartitionBytes is too small")


def scan_with_offset(spark: SparkSession, path: str, schema: T.StructType | str, skip: int = 5,
                     header: bool = True, options: dict[str, str] | None = None) -> DataFrame:
    """Table with ``skip`` lines (and then the header line) above its rows in every file.

    Blank lines are left out; a line that does not fit the schema fails the
    job. Quoted fields cannot hold line ends, as files are read in splits.
    """
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema  # noqa: SLF001 - public DDL format
    lines = spark.read.text(path).select("value", F.xxhash64("_metadata.file_path").alias("file"),
                                         F.col("_metadata.file_block_start").alias("start"))
    rows = lines.mapInArrow(SkipFirstLines(skip + int(header)), "value string").where("trim(value) != ''")
    parsed = F.from_csv("value", F.lit(kind.simpleString()[len("struct<"):-1].replace(":", " ")),
                        {"mode": "FAILFAST", **(options or {})})
    return rows.select(parsed.alias("row")).select("row.*")


class PutAbove:
    """Task function: the given lines before a task's first line."""

    def __init__(self, lines: list[str]):
        self.lines = lines

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for batch in batches:
            if batch.num_rows and not begun:
                begun = True
                yield pa.RecordBatch.from_arrays([pa.array(self.lines, pa.string())], names=["value"])
            yield batch


def write_with_offset(df: DataFrame, path: str, above: list[str], header: bool = True) -> None:
    """CSV files that each begin with the lines ``above`` and the header."""
    lines = [*above, *([",".join(df.columns)] if header else [])]
    rows = df.select(F.to_csv(F.struct(*df.columns)).alias("value"))
    rows.mapInArrow(PutAbove(lines), "value string").write.mode("overwrite").text(path)
