"""Panel building blocks: the (time, key...) aggregate, latest row per series,
snapshots, distinct values and profiling aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import exact_avg, exact_sum


def panel_aggregate(df: DataFrame, keys: Sequence[str] = ("anio", "departamento", "tipo_vehiculo"),
                    sum_cols: Sequence[str] = ("cantidad_ev",),
                    mean_cols: Sequence[str] = ("kwh_promedio", "potencia_carga", "consumo_wh_km")) -> DataFrame:
    """Group by the panel key (NULL keys form their own group); sum the
    counts (all-missing -> 0) and take plain unweighted means of the specs.
    Partial aggregation runs map-side, so a hot key costs one row per task
    before the shuffle; sums are exact, so they do not depend on its order.
    """
    aggs = [F.coalesce(exact_sum(F.col(c)), F.lit(0.0)).alias(c) for c in sum_cols]
    aggs += [exact_avg(F.col(c)).alias(c) for c in mean_cols]
    return df.groupBy(*keys).agg(*aggs)


def latest_per_series(df: DataFrame, series: Sequence[str], time_col: str = "anio") -> DataFrame:
    """Last row of every series by time (``groupby.tail(1)`` after a sort).

    ``max_by`` over a struct is an aggregate with a map-side partial, so no
    per-series sort and no skew on a hot series. Rows with equal time inside
    a series must not occur (panel key is unique).
    """
    others = [c for c in df.columns if c not in series]
    packed = F.max_by(F.struct(*others), F.col(time_col)).alias("_last")
    return df.groupBy(*series).agg(packed).select(*series, *[F.col("_last." + c).alias(c) for c in others])


def latest_snapshot(df: DataFrame, time_col: str = "anio") -> DataFrame:
    """Rows whose time equals the global maximum (a scalar subquery)."""
    top = df.select(F.max(time_col)).scalar()
    return df.filter(F.col(time_col) == top)


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    """Distinct non-null values, sorted ascending."""
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)


def drop_incomplete(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Drop rows with a NULL (or NaN) in any required column."""
    return df.dropna(subset=list(subset))


def null_profile(df: DataFrame, top: int | None = 20) -> DataFrame:
    """Null count per column in one pass, most nulls first (ties by name).

    One aggregate row (``count_if`` per column) is unpivoted to
    (column_name, null_count); the work is a single partial-aggregated scan.
    """
    counts = df.select([F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = counts.unpivot([], df.columns, "column_name", "null_count")
    out = long.orderBy(F.col("null_count").desc(), F.col("column_name").asc())
    return out.limit(top) if top else out


def group_sum_preview(df: DataFrame, keys: Sequence[str], value: str, n: int = 20,
                      alias: str | None = None) -> DataFrame:
    """Sum per group ordered by key (not by the sum), first ``n`` groups
    (TakeOrderedAndProject, no global sort of the groups)."""
    out = df.groupBy(*keys).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(alias or value))
    return out.orderBy(*[F.col(k).asc_nulls_first() for k in keys]).limit(n)
