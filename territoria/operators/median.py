"""Exact medians and most frequent values of many columns at once.

All columns are read in one pass and reduced to rows (column, value, count),
with partial counts in every task; these are written once. The middle of every
column is then narrowed down together: approximate percentiles of the distinct
values that are left part them into ranges, the counts of the ranges say which
of them hold the middle, and so on until a few thousand values are left, which
the driver reads. A round is one job for all columns, so the number of jobs
does not grow with them, and no task holds all values of a column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import coerce_numeric
from .common import cut_lineage

#: ranges of a round, distinct values of a column that the driver reads
RANGES, READ = 64, 4096


def value_counts(df: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    """(column, v, n): distinct non-null values of every column and their rows; ``kind`` is double or string."""
    def value(c):
        return coerce_numeric(F.col(c)) if kind == "double" else F.col(c).cast("string")

    one = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), value(c).alias("v")) for c in columns])).alias("x")
    return df.select(one).select("x.*").where("v is not null").groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))


def exact_medians(df: DataFrame, columns: Sequence[str], ranges: int = RANGES, read: int = READ) -> dict[str, float | None]:
    """Median of the non-null values of every column (mean of the two middle ones if even)."""
    out = dict.fromkeys(columns)
    if not columns:
        return out
    spark = df.sparkSession
    counts = cut_lineage(value_counts(df, columns, "double"))
    # per column: rows before the range, ranks of the middle, the range's ends, its distinct values
    state = {r["column"]: {"before": 0, "ranks": ((r["n"] - 1) // 2, r["n"] // 2), "low": r["low"], "high": r["high"], "values": r["d"]}
             for r in counts.groupBy("column").agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"),
                                                   F.count(F.lit(1)).alias("d")).collect()}
    while True:
        # one row per column
        bounds = F.broadcast(spark.createDataFrame(
            [(c, float(s["low"]), float(s["high"])) for c, s in state.items()], "column string, low double, high double"))
        left = counts.join(bounds, "column").where("v >= low and v <= high").drop("low", "high")
        wide = [c for c, s in state.items() if s["values"] > read]
        if not wide:
            break
        marks = left.where(F.col("column").isin(wide)).groupBy("column").agg(
            F.percentile_approx("v", [i / ranges for i in range(1, ranges)], 10_000).alias("marks"))
        slot = F.size(F.filter("marks", lambda m: m < F.col("v")))
        sums = (left.join(F.broadcast(marks), "column").groupBy("column", slot.alias("slot"))
                .agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("d")).collect())
        for c in wide:
            s, before, hit = state[c], state[c]["before"], []
            for r in sorted((r for r in sums if r["column"] == c), key=lambda r: r["slot"]):
                if before <= s["ranks"][1] and s["ranks"][0] < before + r["n"]:
                    hit.append((before, r))
                before += r["n"]
            s.update(before=hit[0][0], low=hit[0][1]["low"], high=hit[-1][1]["high"], values=sum(r["d"] for _, r in hit))
    rest = sorted((r["column"], r["v"], r["n"]) for r in left.collect()) if state else []
    for c, s in state.items():
        before, found = s["before"], []
        for _, v, n in (r for r in rest if r[0] == c):
            found += [v for rank in s["ranks"] if before <= rank < before + n]
            before += n
        out[c] = sum(found) / 2
    return out


def exact_median(df: DataFrame, column: str) -> float | None:
    return exact_medians(df, [column])[column]


def most_frequents(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Most frequent non-null value of every column, the smallest of equally frequent ones."""
    out = dict.fromkeys(columns)
    if columns:
        top = value_counts(df, columns, "string").groupBy("column").agg(
            F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("v"))
        out.update({r["column"]: r["v"] for r in top.collect()})
    return out


def most_frequent(df: DataFrame, column: str) -> str | None:
    return most_frequents(df, [column])[column]
