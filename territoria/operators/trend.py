"""Per-series linear trend: fit, lookup-predict, horizon fan-out, forecast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import official_round

SERIES = ("departamento", "tipo_vehiculo")
TREND_METHOD = "proyeccion_tendencial_grupo"


def fit_group_trend(df: DataFrame, series: Sequence[str] = SERIES, time_col: str = "anio",
                    value: str = "cantidad_ev", origin: float = 2000.0) -> DataFrame:
    """Least-squares line value ~ time per series (degree-1 fit).

    Values are first summed per (series, time). Series with fewer than two
    distinct times get slope 0 and intercept = the value at the last time;
    series without a valid time get 0/0. The line comes from the power sums
    (n, sum x, sum y, sum xy, sum xx) of times measured from ``origin``:
    algebraic aggregates combined map-side, so a hot series never lands whole
    in one task, and exact for integer data of any realistic size, so the
    order of partial sums does not show. Times that are NULL stay out of the sums.
    """
    series = list(series)
    yearly = df.groupBy(*series, time_col).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("_y"))
    t = F.col(time_col).cast("double") - origin
    y = F.when(t.isNotNull(), F.col("_y"))
    sums = yearly.groupBy(*series).agg(
        F.count(t).alias("n_years"), F.sum(t).alias("_sx"), F.sum(y).alias("_sy"),
        F.sum(t * y).alias("_sxy"), F.sum(t * t).alias("_sxx"), F.max_by(y, t).alias("_last"))
    n, sx, sy, sxy, sxx = (F.col(c).cast("double") for c in ("n_years", "_sx", "_sy", "_sxy", "_sxx"))
    line = F.col("n_years") >= 2
    fitted = sums.withColumn("slope", F.when(line, (n * sxy - sx * sy) / (n * sxx - sx * sx)).otherwise(F.lit(0.0)))
    level = (sy - F.col("slope") * sx) / n - F.col("slope") * origin
    return fitted.select(*series, "slope", F.when(line, level).otherwise(F.coalesce("_last", F.lit(0.0))).alias("intercept"),
                         "n_years")


def predict_group_trend(target: DataFrame, trend: DataFrame, series: Sequence[str] = SERIES,
                        time_col: str = "anio", out: str = "cantidad_ev_pred_tendencia") -> DataFrame:
    """Left lookup of the series' line; prediction clipped at 0; a series
    without a fitted line predicts 0.0 (NULL keys match NULL keys)."""
    series = list(series)
    tr = trend.select(*[F.col(c).alias("_tr_" + c) for c in series], "slope", "intercept")
    cond = F.lit(True)
    for c in series:
        cond = cond & target[c].eqNullSafe(tr["_tr_" + c])
    pred = F.col("intercept") + F.col("slope") * F.col(time_col).cast("double")
    return (target.join(tr, cond, "left")
            .withColumn(out, F.coalesce(F.greatest(pred, F.lit(0.0)), F.lit(0.0)))
            .drop("slope", "intercept", *["_tr_" + c for c in series]))


def horizon_fanout(df: DataFrame, horizons: Sequence[int], series: Sequence[str] = SERIES,
                   time_col: str = "anio", latest: DataFrame | None = None) -> DataFrame:
    """Latest row of every series x each horizon; the new time is the
    *global* base year (max time) + horizon. A generator (explode of a
    literal array) instead of a join: no shuffle beyond the latest-row agg."""
    from .panel import latest_per_series

    base_year = df.select(F.max(time_col)).scalar()
    last = latest if latest is not None else latest_per_series(df, series, time_col)
    h = F.explode(F.array(*[F.lit(int(x)) for x in horizons])).alias("horizonte_anios")
    return (last.select("*", h)
            .withColumn("anio_base", base_year.cast("int"))
            .withColumn(time_col, (F.col("anio_base") + F.col("horizonte_anios")).cast("int")))


def future_forecast(history: DataFrame, horizons: Sequence[int], series: Sequence[str] = SERIES,
                    time_col: str = "anio", value: str = "cantidad_ev",
                    model_a: Column | None = None, model_b: Column | None = None) -> DataFrame:
    """Forecast frame for future horizons: trend fitted on all history;
    the official value is the clipped trend rounded half-to-even, whatever
    model won the backtest. Forest columns are NULL unless given."""
    fut = horizon_fanout(history, horizons, series, time_col)
    trend = fit_group_trend(history, series, time_col, value)
    fut = predict_group_trend(fut, trend, series, time_col)
    none = F.lit(None).cast("double")
    return fut.select(
        F.col(time_col).cast("int").alias(time_col), *series,
        none.alias(value),
        "kwh_promedio", "potencia_carga", "consumo_wh_km",
        F.col("anio_base").cast("int"), F.col("horizonte_anios").cast("int"),
        F.lit("forecast_futuro").alias("tipo_prediccion"),
        (model_a if model_a is not None else none).alias("cantidad_ev_pred_modelo_a"),
        (model_b if model_b is not None else none).alias("cantidad_ev_pred_modelo_b"),
        F.col("cantidad_ev_pred_tendencia"),
        official_round(F.col("cantidad_ev_pred_tendencia")).cast("double").alias("cantidad_ev_pred"),
        F.lit(TREND_METHOD).alias("modelo_seleccionado"),
        none.alias("error_absoluto"))
