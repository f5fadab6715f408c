"""Temporal backtest: split, error metrics, model selection, backtest frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordinal import ordinal_within_key
from .trend import SERIES, TREND_METHOD, fit_group_trend, predict_group_trend

# --- fixed values (model names of the reference) ---------------------------
MODEL_A = "modelo_temporal_puro"
MODEL_B = "modelo_hibrido_energetico"
MODEL_TREND = TREND_METHOD
MODEL_PRIORITY = {MODEL_A: 0, MODEL_B: 1, MODEL_TREND: 2}
# ---------------------------------------------------------------------------


def cutoff_year(df: DataFrame, time_col: str = "anio") -> Column:
    """Second-largest distinct time if there are more than two, else the
    smallest; both cases equal ``max(t) where t < max(t)``. NULL when fewer
    than two distinct times exist. Returned as a scalar-subquery column."""
    top = df.select(F.max(time_col)).scalar()
    return df.where(F.col(time_col) < top).select(F.max(time_col)).scalar()


def check_splittable(df: DataFrame, time_col: str = "anio") -> int:
    """Eager validation (one tiny aggregate): raise like the reference when
    fewer than two distinct times exist; return the cutoff."""
    row = df.select(F.max(time_col).alias("mx")).first()
    if row is None or row["mx"] is None:
        raise ValueError("at least two distinct years are needed for a temporal split")
    cut = df.where(F.col(time_col) < row["mx"]).select(F.max(time_col)).first()[0]
    if cut is None:
        raise ValueError("at least two distinct years are needed for a temporal split")
    return int(cut)


def split_temporal(df: DataFrame, time_col: str = "anio") -> tuple[DataFrame, DataFrame]:
    cut = cutoff_year(df, time_col)
    return df.where(F.col(time_col) <= cut), df.where(F.col(time_col) > cut)


def label_split(df: DataFrame, time_col: str = "anio", out: str = "particion") -> DataFrame:
    cut = cutoff_year(df, time_col)
    return df.withColumn("cutoff_year", cut.cast("int")).withColumn(
        out, F.when(F.col(time_col) <= cut, F.lit("train")).when(F.col(time_col) > cut, F.lit("test")))


def positional_holdout(df: DataFrame, order: Sequence[Column], out: str = "particion",
                       test_fraction_div: int = 5) -> DataFrame:
    """Sort by ``order`` (a total order), the last max(1, n // 5) rows are
    test. Numbering is the distributed ordinal, not a global window."""
    numbered = ordinal_within_key(df, [], list(order), out="_pos")
    n = df.select(F.count(F.lit(1))).scalar()
    n_test = F.greatest(F.lit(1), F.floor(n / test_fraction_div))
    return numbered.withColumn(out, F.when(F.col("_pos") > n - n_test, "test").otherwise("train")) \
        .withColumnRenamed("_pos", "posicion")


def error_metrics(df: DataFrame, actual: str, pred: str, group: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, R^2 (1 - SSE/SST around the mean of the actuals). When
    SST = 0, R^2 is 1 for a perfect fit else 0 (scikit-learn's finite rule).
    One aggregate pass; partial aggregates make it skew-proof."""
    e = F.col(actual) - F.col(pred)
    y = F.col(actual)
    agg = df.groupBy(*group).agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.sum(e * e).alias("_sse"),
        (F.var_pop(y) * F.count(y)).alias("_sst"),
        F.count(F.lit(1)).alias("n"))
    r2 = (F.when(F.col("_sst") > 0, 1 - F.col("_sse") / F.col("_sst"))
           .when(F.col("_sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return agg.withColumn("r2", r2).drop("_sse", "_sst")


def select_model(metrics: DataFrame, model_col: str = "model", rmse_col: str = "rmse",
                 priority: dict[str, int] | None = None) -> DataFrame:
    """A if rmse_A <= rmse_B else B; the trend only if strictly smaller than
    that winner == the minimum of (rmse, priority A < B < trend)."""
    priority = priority or MODEL_PRIORITY
    prio = F.create_map(*[F.lit(x) for kv in priority.items() for x in kv])
    ranked = metrics.withColumn("_prio", F.coalesce(prio[F.col(model_col)], F.lit(99)))
    best = ranked.agg(F.min_by(F.struct(*[F.col(c) for c in metrics.columns]),
                               F.struct(F.col(rmse_col), F.col("_prio"))).alias("_b"))
    return best.select("_b.*")


def trend_backtest(panel: DataFrame, series: Sequence[str] = SERIES, time_col: str = "anio",
                   value: str = "cantidad_ev", model_a: str | None = None,
                   model_b: str | None = None) -> DataFrame:
    """Test rows (time > cutoff) with the trend fitted on the train rows.

    ``model_a``/``model_b`` name prediction columns already on ``panel``
    (e.g. forest output); without them only the trend competes and is the
    selected prediction.
    """
    train, test = split_temporal(panel, time_col)
    trend = fit_group_trend(train, series, time_col, value)
    out = predict_group_trend(test, trend, series, time_col)
    none = F.lit(None).cast("double")
    out = (out.withColumn("tipo_prediccion", F.lit("backtest"))
           .withColumn("anio_base", F.lit(None).cast("int"))
           .withColumn("horizonte_anios", F.lit(None).cast("int"))
           .withColumn("cantidad_ev_pred_modelo_a", F.col(model_a) if model_a else none)
           .withColumn("cantidad_ev_pred_modelo_b", F.col(model_b) if model_b else none))
    return out


def finish_backtest(frame: DataFrame, selected: Column, selected_name: Column,
                    value: str = "cantidad_ev") -> DataFrame:
    """Add the selected prediction, its model name and the absolute error;
    fixed column order of the predictions table."""
    return frame.select(
        F.col("anio").cast("int").alias("anio"), "departamento", "tipo_vehiculo", value,
        "kwh_promedio", "potencia_carga", "consumo_wh_km", "tipo_prediccion",
        "anio_base", "horizonte_anios", "cantidad_ev_pred_modelo_a", "cantidad_ev_pred_modelo_b",
        "cantidad_ev_pred_tendencia", selected.alias("cantidad_ev_pred"),
        selected_name.alias("modelo_seleccionado"),
        F.abs(F.col(value) - selected).alias("error_absoluto"))
