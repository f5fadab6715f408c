"""Stage 2: forecast overlay, history + future union, energy and power demand,
simultaneity scenario fan-out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .median import exact_medians

# --- fixed values: column names and order ---------------------------------
PANEL_KEY = ("anio", "departamento", "tipo_vehiculo")
SCENARIO_BASE_COLUMNS = [
    "anio", "anio_base", "horizonte_anios", "departamento", "tipo_vehiculo", "cantidad_ev",
    "cantidad_ev_modelada", "fuente_cantidad_ev", "kwh_promedio", "potencia_carga",
    "consumo_wh_km", "consumo_energetico", "consumo_energetico_kwh",
]
ENERGY_COLUMNS = [
    "anio", "departamento", "tipo_vehiculo", "cantidad_ev", "kwh_promedio", "potencia_carga",
    "consumo_wh_km", "anio_base", "horizonte_anios", "cantidad_ev_pred", "cantidad_ev_modelada",
    "fuente_cantidad_ev", "simultaneidad", "consumo_energetico", "demanda_futura",
    "consumo_energetico_kwh", "demanda_futura_kw",
]
FUTURE_COLUMNS = ["anio", "departamento", "tipo_vehiculo", "kwh_promedio", "potencia_carga",
                  "consumo_wh_km", "cantidad_ev_pred", "anio_base", "horizonte_anios"]
# ---------------------------------------------------------------------------


def distinct_predictions(predictions: DataFrame, keys: Sequence[str] = PANEL_KEY,
                         pred: str = "cantidad_ev_pred") -> DataFrame:
    return predictions.select(*keys, pred).distinct()


def one_prediction(predictions: DataFrame, keys: Sequence[str], pred: str) -> DataFrame:
    """One row per key; a key with two different predictions is an error, as it would repeat panel rows."""
    many = (F.count(pred) > 0) & ((F.count(pred) < F.count(F.lit(1))) | (F.min(pred) != F.max(pred)))
    fault = F.raise_error(F.concat(F.lit("two predictions for "), F.to_json(F.struct(*keys))))
    return predictions.groupBy(*keys).agg(F.when(many, fault.cast("double")).otherwise(F.min(pred)).alias(pred))


def forecast_overlay(panel: DataFrame, predictions: DataFrame | None,
                     keys: Sequence[str] = PANEL_KEY, pred: str = "cantidad_ev_pred",
                     actual: str = "cantidad_ev") -> DataFrame:
    """Left join of the predictions on the panel key (one per key); the modelled
    count is the prediction where present, else the actual; source label
    ``forecast_baseline`` / ``historico``. NULL keys match NULL keys."""
    out = (panel.withColumn("anio_base", F.lit(None).cast("int"))
           .withColumn("horizonte_anios", F.lit(None).cast("int")))
    if predictions is None:
        return (out.withColumn(pred, F.lit(None).cast("double"))
                .withColumn("cantidad_ev_modelada", F.col(actual))
                .withColumn("fuente_cantidad_ev", F.lit("historico")))
    keys = list(keys)
    p = one_prediction(predictions, keys, pred).select(
        *[F.col(k).alias("_p_" + k) for k in keys], F.col(pred))
    cond = F.lit(True)
    for k in keys:
        cond = cond & out[k].eqNullSafe(p["_p_" + k])
    joined = out.join(p, cond, "left").drop(*["_p_" + k for k in keys])
    return (joined.withColumn("cantidad_ev_modelada", F.coalesce(F.col(pred), F.col(actual)))
            .withColumn("fuente_cantidad_ev",
                        F.when(F.col(pred).isNotNull(), "forecast_baseline").otherwise("historico")))


def future_rows(forecast: DataFrame) -> DataFrame:
    return (forecast.select(*FUTURE_COLUMNS).distinct()
            .withColumn("cantidad_ev", F.lit(0.0))
            .withColumn("cantidad_ev_modelada", F.col("cantidad_ev_pred"))
            .withColumn("fuente_cantidad_ev", F.lit("forecast_futuro")))


def history_future_union(history: DataFrame, forecast: DataFrame | None) -> DataFrame:
    """Append future rows by column name; absent columns become NULL."""
    if forecast is None:
        return history
    return history.unionByName(future_rows(forecast), allowMissingColumns=True)


def energy_demand(df: DataFrame, simultaneity: float) -> DataFrame:
    """consumption = count x kWh; demand = count x power x simultaneity;
    missing kWh / power count as 0; duplicated unit-named columns."""
    return (df.withColumn("simultaneidad", F.lit(float(simultaneity)))
            .withColumn("kwh_promedio", F.coalesce(F.col("kwh_promedio"), F.lit(0.0)))
            .withColumn("potencia_carga", F.coalesce(F.col("potencia_carga"), F.lit(0.0)))
            .withColumn("consumo_energetico", F.col("cantidad_ev_modelada") * F.col("kwh_promedio"))
            .withColumn("demanda_futura", F.col("cantidad_ev_modelada") * F.col("potencia_carga")
                        * F.col("simultaneidad"))
            .withColumn("consumo_energetico_kwh", F.col("consumo_energetico"))
            .withColumn("demanda_futura_kw", F.col("demanda_futura")))


def build_energy_table(panel: DataFrame, predictions: DataFrame | None, forecast: DataFrame | None,
                       simultaneity: float) -> DataFrame:
    overlay = forecast_overlay(panel, predictions)
    return energy_demand(history_future_union(overlay, forecast), simultaneity).select(*ENERGY_COLUMNS)


def scenario_fanout(energy: DataFrame, scenarios: dict[str, float]) -> DataFrame:
    """Every energy row once per scenario with demand recomputed. The
    scenario list is a literal array exploded in place (a generator), so no
    join and no shuffle; rows = energy rows x scenarios."""
    if not scenarios:
        return energy.select(*SCENARIO_BASE_COLUMNS).limit(0)
    sc = F.explode(F.array(*[F.struct(F.lit(k).alias("n"), F.lit(float(v)).alias("f"))
                             for k, v in scenarios.items()])).alias("_sc")
    out = energy.select(*SCENARIO_BASE_COLUMNS, sc)
    return (out.withColumn("escenario_simultaneidad", F.col("_sc.n"))
            .withColumn("simultaneidad", F.col("_sc.f"))
            .withColumn("demanda_futura", F.col("cantidad_ev_modelada") * F.col("potencia_carga")
                        * F.col("simultaneidad"))
            .withColumn("demanda_futura_kw", F.col("demanda_futura"))
            .drop("_sc"))


def holdout_energy(predictions: DataFrame, measures: DataFrame, simultaneity: float, pred: str = "cantidad_ev_pred") -> DataFrame:
    """Energy and power demand of held-out predictions: missing kWh and power
    take the median of ``measures``; the columns are carried by the rows."""
    medians = exact_medians(measures, ["kwh_promedio", "potencia_carga"])
    filled = predictions.withColumns({c: F.coalesce(c, F.lit(m).cast("double")) for c, m in medians.items()})
    return (filled.withColumn("simultaneidad", F.lit(float(simultaneity)))
            .withColumn("consumo_energetico", F.col(pred) * F.col("kwh_promedio"))
            .withColumn("demanda_futura", F.col(pred) * F.col("potencia_carga") * F.col("simultaneidad")))
