"""The flow's output stage: result tables with their alias names, the point
layer and the run's JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..params import FlowParams
from ..sources import io
from .flow import FlowResult, model_comparison, model_input, run_summary

# --- fixed values: table and alias names; the optional tables are skipped when empty
ALIASES = {
    "panel": ["etapa1_temporal", "temporal_model_input"],
    "predictions": ["etapa1_temporal_predicciones"],
    "forecast": ["forecast_ev"],
    "energy": ["etapa2_energetico", "demanda_energetica"],
    "scenarios": ["demanda_energetica_escenarios"],
    "priority": ["etapa3_gis", "priorizacion_territorial"],
    "validation": ["validacion_etapa3"],
}
OPTIONAL = {"demanda_energetica_escenarios", "validacion_etapa3"}
POINTS = "priorizacion_territorial.geojson"
SUMMARY, COMPARISON, IMPORTANCE = ("etapa1_baseline_metrics.json", "etapa1_model_comparison.json",
                                   "etapa1_baseline_feature_summary.csv")
# ---------------------------------------------------------------------------


def save_table(df: DataFrame, table: str, folder: str) -> None:
    """One overwrite job per format: Parquet in the table's schema, and CSV."""
    shaped = io.conform(df, table)
    shaped.write.mode("overwrite").parquet(f"{folder}/{table}")
    shaped.write.mode("overwrite").option("header", True).csv(f"{folder}/{table}.csv")


def save_outputs(spark: SparkSession, result: FlowResult, folder: str, params: FlowParams | None = None) -> list[str]:
    """Write every output of a run below ``folder`` (a path any store of the
    session can hold); returns the names written."""
    params, done = params or FlowParams(), []
    for part, tables in ALIASES.items():
        df = getattr(result, part)
        if tables[0] in OPTIONAL and df.isEmpty():
            continue
        for table in tables:
            save_table(df, table, folder)
            done.append(table)
    points = io.geojson_point_features(result.priority)
    if not points.isEmpty():
        io.write_geojson_lines(points, f"{folder}/{POINTS}")
        done.append(POINTS)
    if result.backtest is not None:
        tested = result.backtest
        summary = run_summary(model_input(result.panel), result.forecast, tested.metrics, tested.selected, params.horizons)
        summary.write.mode("overwrite").json(f"{folder}/{SUMMARY}")
        model_comparison(tested.metrics, tested.selected).write.mode("overwrite").json(f"{folder}/{COMPARISON}")
        tested.importance().write.mode("overwrite").option("header", True).csv(f"{folder}/{IMPORTANCE}")
        done += [SUMMARY, COMPARISON, IMPORTANCE]
    return done
