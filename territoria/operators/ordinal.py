"""Skew-safe ordinals: row numbers within a key (or globally) without putting
a whole key - or the whole table - into one task.

A plain ``row_number() over (partition by key order by ...)`` sends every row
of a key to one task; a key holding a third of the table then stalls the job,
and a global ``row_number`` (no key) uses a single partition. Here the rows
are range-partitioned on (key, order) instead, so a hot key is spread over
many consecutive partitions. Each partition numbers its own slice, the per
(key, partition) counts (at most #keys + #partitions rows) are turned into
offsets with a small window, and the offsets are joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage


def ordinal_within_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                       out: str = "rn", num_partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 1-based position of each row inside its key, following
    ``order`` (which must be a total order inside a key, e.g. ending with a
    unique id). ``keys`` may be empty for a global numbering."""
    keys, order = list(keys), list(order)
    by = [F.col(k).asc_nulls_first() for k in keys] + order
    ranged = df.repartitionByRange(num_partitions, *by) if num_partitions else df.repartitionByRange(*by)
    # a slice is sorted, so a row's id counts up within it and a key's rows are
    # consecutive; the numbered slices are written once (reliable checkpoint),
    # because both the counts and the join must read the same slices
    local = cut_lineage(ranged.sortWithinPartitions(*by).withColumn("_tt_id", F.monotonically_increasing_id()))
    local = local.withColumn("_tt_pid", F.shiftright("_tt_id", 33))
    counts = local.groupBy(*keys, "_tt_pid").agg(F.count(F.lit(1)).alias("_tt_cnt"), F.min("_tt_id").alias("_tt_first"))
    if not keys:
        # a row per slice: their offsets stand in the plan, no join
        offset, listed = 0, []
        for r in sorted(counts.collect()):
            listed.append((r["_tt_pid"], offset - r["_tt_first"] + 1))
            offset += r["_tt_cnt"]
        table = F.create_map(*[F.lit(x).cast("long") for pair in listed for x in pair]) if listed else None
        number = F.col("_tt_id") + (table[F.col("_tt_pid")] if listed else F.lit(0))
        return local.withColumn(out, number).drop("_tt_pid", "_tt_id")
    before = Window.partitionBy(*keys).orderBy("_tt_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias("_tt_k_" + k) for k in keys], F.col("_tt_pid").alias("_tt_k_pid"),
                            (F.coalesce(F.sum("_tt_cnt").over(before), F.lit(0)) - F.col("_tt_first") + 1).alias("_tt_off"))
    cond = local["_tt_pid"] == offsets["_tt_k_pid"]
    for k in keys:
        cond = cond & local[k].eqNullSafe(offsets["_tt_k_" + k])
    return (local.join(offsets, cond).withColumn(out, F.col("_tt_id") + F.col("_tt_off"))
            .drop("_tt_pid", "_tt_id", "_tt_off", "_tt_k_pid", *["_tt_k_" + k for k in keys]))


def previous_in_key(df: DataFrame, key: str, order: str, value: str, out: str,
                    num_partitions: int | None = None) -> DataFrame:
    """Add ``out`` = the value of the key's previous row by ``order`` (NULL for the first).

    A slice of the range-partitioned rows takes it from its own sorted rows; the
    first row a key has in a slice takes the last value of the slice before. A
    key with very many rows spans slices, so no task holds it whole.
    """
    by = [F.col(key).asc_nulls_first(), F.col(order).asc_nulls_first()]
    ranged = df.repartitionByRange(num_partitions, *by) if num_partitions else df.repartitionByRange(*by)
    local = cut_lineage(ranged.sortWithinPartitions(*by).withColumn("_pv_id", F.monotonically_increasing_id()))
    local = local.withColumn("_pv_slice", F.shiftright("_pv_id", 33))
    here = Window.partitionBy("_pv_slice", key).orderBy("_pv_id")
    ends = local.groupBy("_pv_slice", key).agg(F.max_by(F.struct(value), "_pv_id").alias("_pv_last"))
    before = F.lag("_pv_last").over(Window.partitionBy(key).orderBy("_pv_slice"))  # a row per slice and key
    carried = ends.select(F.col("_pv_slice").alias("_pv_to"), F.col(key).alias("_pv_key"), before.alias("_pv_carry"))
    rows = local.withColumn("_pv_own", F.lag(F.struct(value)).over(here))
    on = (rows["_pv_slice"] == carried["_pv_to"]) & rows[key].eqNullSafe(carried["_pv_key"])
    return (rows.join(carried, on, "left").withColumn(out, F.coalesce("_pv_own", "_pv_carry").getField(value))
            .drop("_pv_id", "_pv_slice", "_pv_own", "_pv_to", "_pv_key", "_pv_carry"))


def dense_rank_desc(df: DataFrame, score: str, out: str, decimals: int | None = None) -> DataFrame:
    """Dense rank of ``score`` descending (1 = highest), as int.

    Raw scores are ranked; with ``decimals`` they are rounded first, so that
    ties do not depend on summation order. Distinct scores are numbered with the distributed
    ordinal and joined back; no global window over the input.
    """
    key = "_tt_score"
    scored = df.withColumn(key, F.col(score) if decimals is None else F.round(F.col(score), decimals))
    distinct = scored.select(key).distinct()
    ranked = ordinal_within_key(distinct, [], [F.col(key).desc_nulls_last()], out="_tt_rank")
    ranked = ranked.withColumnRenamed(key, "_tt_score_r")
    joined = scored.join(ranked, scored[key].eqNullSafe(ranked["_tt_score_r"]), "left")
    return joined.withColumn(out, F.col("_tt_rank").cast("int")).drop(key, "_tt_score_r", "_tt_rank")
