"""Yearly totals per territory and change against the previous available
period (not the previous calendar period)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import exact_sum, safe_div
from .ordinal import previous_in_key


def yearly_totals(energy: DataFrame, time_col: str = "anio", key: str = "departamento") -> DataFrame:
    """Per (time, territory): historic count, modelled count, consumption and
    demand sums (NULL territory kept as a group)."""
    s = lambda c, a=None: F.coalesce(exact_sum(F.col(c)), F.lit(0.0)).alias(a or c)
    return energy.groupBy(time_col, key).agg(
        s("cantidad_ev", "cantidad_ev_historica"), s("cantidad_ev_modelada"),
        s("consumo_energetico"), s("demanda_futura"))


def period_change(df: DataFrame, key: str, time_col: str, value: str,
                  diff_out: str = "aumento_demanda", pct_out: str = "aumento_demanda_pct") -> DataFrame:
    """``value - previous value`` and ``(value - prev) / prev`` inside each key
    ordered by time; the first row, a NULL key, division by zero, inf and NaN
    all give 0.

    The previous value is handed on between slices of the sorted rows, so a
    key with very many periods is no single task.
    """
    rows = previous_in_key(df, key, time_col, value, "_previous")
    prev = F.col("_previous")
    diff = F.coalesce(F.col(value) - prev, F.lit(0.0))
    pct = safe_div(F.col(value) - prev, prev, 0.0)
    nokey = F.col(key).isNull()
    return (rows.withColumn(diff_out, F.when(nokey, F.lit(0.0)).otherwise(diff))
            .withColumn(pct_out, F.when(nokey, F.lit(0.0)).otherwise(pct)).drop("_previous"))


def yearly_department_demand(energy: DataFrame) -> DataFrame:
    """A4 + W2 + W3: yearly department totals with the change columns,
    ordered by (department, year)."""
    yearly = yearly_totals(energy)
    return period_change(yearly, "departamento", "anio", "demanda_futura") \
        .orderBy(F.col("departamento").asc_nulls_first(), "anio")
