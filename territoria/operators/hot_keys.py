"""Equi-join whose big side may hold very many rows of one key.

The keys with most rows are counted first. A key above ``rows_per_part`` rows is
dealt over as many parts as its rows need, and the other side's rows of that
key are repeated once per part; all other keys join as they are. At most one
key per shuffle partition is looked at: any further key holds a smaller share
than a partition does. Rows without a key match nothing and are spread too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_PART = 100_000
#: parts of one key for each shuffle partition, at most
SPREAD = 16


def hot_keys(df: DataFrame, key: str, rows_per_part: int = ROWS_PER_PART) -> dict:
    """{key: number of parts} of the keys that need more than one part."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    top = (df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
           .where(F.col("n") > rows_per_part).orderBy(F.col("n").desc()).limit(width).collect())
    return {r[key]: min(-(-r["n"] // rows_per_part), SPREAD * width) for r in top}


def hot_key_join(big: DataFrame, small: DataFrame, big_key: str, small_key: str, how: str = "left",
                 rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """``big`` joined with ``small`` on big_key = small_key (inner or left)."""
    if how not in ("left", "inner"):
        raise ValueError(f"'{how}' is neither left nor inner")
    parts = hot_keys(big, big_key, rows_per_part)
    if not parts:
        return big.join(small, big[big_key] == small[small_key], how)
    spark = big.sparkSession
    kind = big.schema[big_key].dataType.simpleString()
    # a row per shuffle partition at most
    listed = F.broadcast(spark.createDataFrame(list(parts.items()), f"_hk_key {kind}, _hk_parts long"))
    names = [F.col(c) for c in big.columns]
    mixed = F.xxhash64(F.spark_partition_id(), *names)
    dealt = (big.join(listed, big[big_key] == listed["_hk_key"], "left")
             .withColumn("_hk_part", F.pmod(mixed, F.coalesce("_hk_parts", F.lit(1).cast("long")))).drop("_hk_key", "_hk_parts"))
    repeated = (small.join(listed, small[small_key] == listed["_hk_key"], "left")
                .withColumn("_hk_other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_hk_parts", F.lit(1).cast("long")) - 1)))
                .drop("_hk_key", "_hk_parts"))
    on = (dealt[big_key] == repeated[small_key]) & (dealt["_hk_part"] == repeated["_hk_other"])
    return dealt.join(repeated, on, how).drop("_hk_part", "_hk_other")
