"""The composite flow: panel -> backtest + forecast -> energy -> scenarios ->
department ranking -> validation.

The panel, the energy table and the department ranking are stage tables: each
is written once as Parquet and read with column pruning by all that follows;
with forests the backtest frame too, because the model choice reads it. The
tables lie in the run's store, which the caller may close. All else is lazy.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import backtest as bt
from ..operators import forest as fr
from ..operators import trend as tr
from ..operators.common import attach_one_row, cut_lineage
from ..operators.energy import build_energy_table, scenario_fanout
from ..operators.panel import drop_incomplete, panel_aggregate
from ..operators.priority import build_priority_table, build_validation_table
from ..params import FlowParams
from .store import StageStore

PANEL_REQUIRED = ["anio", "departamento", "tipo_vehiculo", "cantidad_ev"]
PREDICTION_OF = {bt.MODEL_A: "cantidad_ev_pred_modelo_a", bt.MODEL_B: "cantidad_ev_pred_modelo_b",
                 bt.MODEL_TREND: "cantidad_ev_pred_tendencia"}
FEATURES_OF = {bt.MODEL_A: fr.FEATURES_A, bt.MODEL_B: fr.FEATURES_B, bt.MODEL_TREND: fr.FEATURES_A}


@dataclass
class Backtest:
    """Predictions of every competing model on the test years and the winner."""

    frame: DataFrame
    metrics: DataFrame
    selected: str
    models: dict[str, fr.ForestModel] = field(default_factory=dict)

    def predictions(self) -> DataFrame:
        return bt.finish_backtest(self.frame, F.col(PREDICTION_OF[self.selected]), F.lit(self.selected))

    def importance(self) -> DataFrame:
        """Feature importance of the winner; empty when the trend won."""
        spark = self.frame.sparkSession
        if self.selected not in self.models:
            return spark.createDataFrame([], "feature string, importance double")
        return self.models[self.selected].feature_importance(spark)


@dataclass
class FlowResult:
    panel: DataFrame
    predictions: DataFrame
    forecast: DataFrame
    energy: DataFrame
    scenarios: DataFrame
    priority: DataFrame
    validation: DataFrame
    backtest: Backtest | None = None


def model_input(panel: DataFrame) -> DataFrame:
    """Stage-1 input: panel rows with a complete key and count, year as int."""
    return drop_incomplete(panel, PANEL_REQUIRED).withColumn("anio", F.col("anio").cast("int"))


def stage1_trend(panel: DataFrame, horizons) -> tuple[DataFrame, DataFrame]:
    """Backtest predictions (trend only) and the future forecast."""
    data = model_input(panel)
    predictions = Backtest(bt.trend_backtest(data), None, bt.MODEL_TREND).predictions()
    return predictions, tr.future_forecast(data, horizons)


def backtest(data: DataFrame, num_trees: int = 300) -> Backtest:
    """Fit both forests and the trend on the train years, compare them on the
    test years and choose the smallest RMSE (A before B before the trend)."""
    bt.check_splittable(data)
    train, _ = bt.split_temporal(data)
    train = cut_lineage(train)
    # two independent Spark ML fits: their many small stages overlap
    with ThreadPoolExecutor(max_workers=2) as pool:
        jobs = {m: pool.submit(fr.fit_forest, train, FEATURES_OF[m], "cantidad_ev", num_trees)
                for m in (bt.MODEL_A, bt.MODEL_B)}
        models = {m: job.result() for m, job in jobs.items()}
    scored = data
    for name, model in models.items():
        scored = model.predict(scored, PREDICTION_OF[name])
    frame = cut_lineage(bt.trend_backtest(scored, model_a=PREDICTION_OF[bt.MODEL_A], model_b=PREDICTION_OF[bt.MODEL_B]))
    metrics = None
    for name, column in PREDICTION_OF.items():
        one = bt.error_metrics(frame, "cantidad_ev", column).select(F.lit(name).alias("model"), "mae", "rmse", "r2", "n")
        metrics = one if metrics is None else metrics.unionByName(one)
    return Backtest(frame, metrics, bt.select_model(metrics).first()["model"], models)


def forecast(data: DataFrame, horizons: Sequence[int], models: dict[str, fr.ForestModel] | None = None) -> DataFrame:
    """The future forecast; with models their clipped predictions beside the trend."""
    out = tr.future_forecast(data, horizons)
    order = out.columns
    for name, model in (models or {}).items():
        column = PREDICTION_OF[name]
        out = model.predict(out.drop(column), column).withColumn(column, F.greatest(F.col(column), F.lit(0.0)))
    return out.select(*order)


def run_flow(registrations: DataFrame, assets: DataFrame, params: FlowParams | None = None,
             with_forests: bool = True, num_trees: int = 300, store: StageStore | None = None) -> FlowResult:
    """Run the flow. ``with_forests=False`` lets only the trend compete (no
    model is fitted); the official forecast is the trend either way. A panel
    of fewer than two years is an error, as it has no train and test years.
    Closing ``store`` removes what the returned frames read."""
    params, store = params or FlowParams(), store or StageStore(registrations.sparkSession, "flow")
    panel = store.put("panel", panel_aggregate(registrations))
    data = model_input(panel)
    if with_forests:
        tested = backtest(data, num_trees)
        predictions, future = tested.predictions(), forecast(data, params.horizons, tested.models)
    else:
        bt.check_splittable(data)
        tested = None
        predictions, future = stage1_trend(panel, params.horizons)
    energy = store.put("energy", build_energy_table(panel, predictions, future, params.simultaneity))
    weights = params.effective_weights()
    # a stored table has no order of its own
    priority = store.put("priority", build_priority_table(energy, assets, weights, params.scenario_label)).orderBy(
        "ranking_prioridad", F.col("departamento").asc_nulls_first())
    return FlowResult(panel, predictions, future, energy, scenario_fanout(energy, params.scenarios), priority,
                      build_validation_table(priority, weights), tested)


def run_summary(data: DataFrame, future: DataFrame, metrics: DataFrame, selected: str,
                horizons: Sequence[int]) -> DataFrame:
    """One row: sizes, years, horizons, the chosen model with its features and errors."""
    cutoff = bt.cutoff_year(data)
    test_years = F.sort_array(F.collect_set(F.when(F.col("anio") > cutoff, F.col("anio").cast("int"))))
    counts = data.agg(F.count_if(F.col("anio") <= cutoff).alias("train_rows"),
                      F.count_if(F.col("anio") > cutoff).alias("test_rows"),
                      cutoff.cast("int").alias("cutoff_year"), F.max("anio").cast("int").alias("base_year"),
                      test_years.alias("test_years"))
    years = future.agg(F.sort_array(F.collect_set(F.col("anio").cast("int"))).alias("forecast_years"))
    chosen = metrics.where(F.col("model") == selected).select("mae", "rmse", "r2")
    out = attach_one_row(attach_one_row(counts, years), chosen)
    return out.select(
        "train_rows", "test_rows", "cutoff_year", "base_year", "test_years",
        F.array(*[F.lit(int(h)) for h in horizons]).alias("forecast_horizons_anios"), "forecast_years",
        F.lit(selected).alias("selected_model"), F.lit(bt.MODEL_TREND).alias("future_forecast_method"),
        F.array(*[F.lit(x) for x in FEATURES_OF[selected]]).alias("selected_features"), "mae", "rmse", "r2")


def model_comparison(metrics: DataFrame, selected: str) -> DataFrame:
    """One row with a struct of errors per model, the winner and the forecast method."""
    entry = F.struct("mae", "rmse", "r2")
    return metrics.agg(*[F.first(F.when(F.col("model") == m, entry), True).alias(m) for m in PREDICTION_OF],
                       F.lit(selected).alias("selected_model"), F.lit(bt.MODEL_TREND).alias("future_forecast_method"))
