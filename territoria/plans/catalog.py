"""Registered queries: every operator applied to the driver's test tables
(whole tables; roles mapped as documented in README), plus the equivalent
DuckDB SQL for the oracle check.

Doubles are rounded to 6 places on both sides where the summation order can
differ between engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import backtest as bt
from ..operators import energy as en
from ..operators import panel as pn
from ..operators import priority as pr
from ..operators import trend as tr
from ..operators.common import cut_lineage
from ..params import DEFAULT_HORIZONS, DEFAULT_SCENARIOS, FlowParams
from ..sources import tables as tb
from . import sqltext as S
from .flow import model_input, run_flow, stage1_trend
from .store import StageStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# Columns whose magnitude needs fewer decimals for an engine-independent value
# (about 10 significant digits survive any summation order).
DIGITS = {"consumo_energetico": 2, "consumo_energetico_kwh": 2, "demanda_futura": 4,
          "demanda_futura_kw": 4, "intercept": 4, "cantidad_ev_historica": 4,
          "aumento_demanda": 3}


def r6(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles half-up on their shortest decimal form, so that two
    engines whose sums differ in the last bit still print the same value. Three
    more places are settled first: a sum that is a half but for its last bit is a half."""
    def settled(c):
        n = DIGITS.get(c, digits)
        return F.round(F.round(F.col(c), n + 3), n)

    return df.select(*[settled(f.name).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def sql_r6(body: str, cols: list[str], digits: int = 6) -> str:
    rep = ", ".join(f"CAST(round(round(CAST(CAST({c} AS VARCHAR) AS DECIMAL(38, 12)), {DIGITS.get(c, digits) + 3}), "
                    f"{DIGITS.get(c, digits)}) AS DOUBLE) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({body}) _q"


def _panel(spark, d):
    # the small panel is written once to the shared checkpoint folder; every
    # later stage reads it instead of re-running the registrations join
    return cut_lineage(pn.panel_aggregate(tb.registrations(spark, d)))


def _data(spark, d):
    return model_input(_panel(spark, d))


def _preds(spark, d):
    return stage1_trend(_panel(spark, d), DEFAULT_HORIZONS)[0]


def _forecast(spark, d):
    return stage1_trend(_panel(spark, d), DEFAULT_HORIZONS)[1]


def _energy(spark, d, sim=0.3):
    store = StageStore(spark, "energy")
    panel = store.put("panel", pn.panel_aggregate(tb.registrations(spark, d)))
    preds, fc = stage1_trend(panel, DEFAULT_HORIZONS)
    return store.put("energy", en.build_energy_table(panel, preds, fc, sim))


def _flow(spark, d):
    # the trend alone competes: forests have no SQL equivalent (forest_backtest has them)
    return run_flow(tb.registrations(spark, d), tb.assets(spark, d), FlowParams(), with_forests=False)


PANEL_D = ["cantidad_ev", "kwh_promedio", "potencia_carga", "consumo_wh_km"]
PRED_D = ["cantidad_ev", "kwh_promedio", "potencia_carga", "consumo_wh_km", "cantidad_ev_pred_modelo_a",
          "cantidad_ev_pred_modelo_b", "cantidad_ev_pred_tendencia", "cantidad_ev_pred", "error_absoluto"]
ENERGY_D = ["cantidad_ev", "kwh_promedio", "potencia_carga", "consumo_wh_km", "cantidad_ev_pred",
            "cantidad_ev_modelada", "simultaneidad", "consumo_energetico", "demanda_futura",
            "consumo_energetico_kwh", "demanda_futura_kw"]
GIS_D = ["cantidad_ev", "cantidad_ev_modelada", "consumo_energetico", "demanda_futura",
         "total_activos_hidraulicos", "capacidad_hidraulica_total", "latitud_hidraulica_promedio",
         "longitud_hidraulica_promedio", "latitud", "longitud", "criterio_demanda",
         "criterio_crecimiento_ev", "criterio_soporte_hidraulico", "criterio_cobertura_hidraulica",
         "criterio_brecha_soporte_hidraulico", "criterio_brecha_cobertura_hidraulica",
         "indice_prioridad_territorial"]

BASE = (S.REGISTRATIONS, S.PANEL)
STAGE1 = (S.REGISTRATIONS, S.PANEL, S.DATA, S.BACKTEST, S.future())
ENERGY = STAGE1 + (S.energy(),)
FLOW = ENERGY + (S.ASSETS, S.PRIORITY)


# ---------------------------------------------------------------- stage 1 --
@register("temporal_panel", sql_r6(S.with_(*BASE) + " SELECT * FROM panel", PANEL_D))
def q_temporal_panel(spark, d):
    return r6(_panel(spark, d))


@register("group_trend", sql_r6(S.with_(*BASE, S.DATA, S.trend_fit("tr", "data"))
                                + " SELECT departamento, tipo_vehiculo, slope, intercept, n_years FROM tr",
                                ["slope", "intercept"]))
def q_group_trend(spark, d):
    return r6(tr.fit_group_trend(_data(spark, d)), 6)


@register("trend_backtest", sql_r6(S.with_(*STAGE1) + " SELECT * FROM predictions", PRED_D))
def q_trend_backtest(spark, d):
    return r6(_preds(spark, d))


@register("future_forecast", sql_r6(S.with_(*STAGE1) + " SELECT * FROM forecast", PRED_D))
def q_future_forecast(spark, d):
    return r6(_forecast(spark, d))


@register("energy_demand", sql_r6(S.with_(*ENERGY) + " SELECT * FROM energy", ENERGY_D))
def q_energy_demand(spark, d):
    return r6(_energy(spark, d))


@register("priority_flow", sql_r6(S.with_(*FLOW) + " SELECT * FROM gis", GIS_D))
def q_priority_flow(spark, d):
    return r6(_flow(spark, d).priority)


# ------------------------------------------------------- stage 1 details --
@register("master_projection", S.with_(S.REGISTRATIONS) + f"""
SELECT o.o_orderstatus AS estado, strftime(o.o_orderdate, '%Y-%m-%d') AS fecha_registro,
       CAST(year(o.o_orderdate) AS DOUBLE) AS anio, {S.standardize('p.p_type')} AS tipo_vehiculo,
       {S.norm_dept('n.n_name')} AS departamento, coalesce(l.l_quantity, 0.0) AS cantidad_ev,
       l.l_extendedprice AS kwh_promedio, CAST(p.p_size AS DOUBLE) AS consumo_wh_km,
       p.p_retailprice AS potencia_carga
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN part p ON l.l_partkey = p.p_partkey""")
def q_master_projection(spark, d):
    return tb.load_master(tb.registrations_raw(spark, d))


@register("coerce_numeric", """
SELECT event_id, json_extract_string(props, '$.k') AS k_texto,
       CASE WHEN isnan(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) THEN NULL
            ELSE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k_numero,
       CASE WHEN isnan(TRY_CAST(event_type AS DOUBLE)) THEN NULL ELSE TRY_CAST(event_type AS DOUBLE) END
         AS tipo_numero
FROM events""")
def q_coerce_numeric(spark, d):
    from ..functions.numeric import coerce_numeric
    ev = tb.read_table(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    return ev.select("event_id", k.alias("k_texto"), coerce_numeric(k).alias("k_numero"),
                     coerce_numeric(F.col("event_type")).alias("tipo_numero"))


@register("drop_incomplete_rows", """
SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL""")
def q_drop_incomplete_rows(spark, d):
    docs = tb.read_table(spark, d, "documents").select("doc_id", "lang")
    j = docs.join(tb.read_table(spark, d, "labels"), "doc_id", "left")
    return pn.drop_incomplete(j, ["quality", "toxic"])


@register("latest_snapshot", sql_r6(S.with_(*BASE) + " SELECT * FROM panel WHERE anio = (SELECT max(anio) FROM panel)",
                                    PANEL_D))
def q_latest_snapshot(spark, d):
    return r6(pn.latest_snapshot(_panel(spark, d)))


@register("distinct_years", S.with_(*BASE) + " SELECT DISTINCT anio FROM panel WHERE anio IS NOT NULL")
def q_distinct_years(spark, d):
    return pn.distinct_sorted(_panel(spark, d), "anio")


@register("latest_per_series", sql_r6(S.with_(*BASE, S.DATA) + """
 SELECT departamento, tipo_vehiculo, max(anio) AS anio, max_by(cantidad_ev, anio) AS cantidad_ev,
        max_by(kwh_promedio, anio) AS kwh_promedio, max_by(potencia_carga, anio) AS potencia_carga,
        max_by(consumo_wh_km, anio) AS consumo_wh_km
 FROM data GROUP BY departamento, tipo_vehiculo""", PANEL_D))
def q_latest_per_series(spark, d):
    return r6(pn.latest_per_series(_data(spark, d), ["departamento", "tipo_vehiculo"]))


@register("temporal_split", sql_r6(S.with_(*BASE, S.DATA) + """
 SELECT *, CAST((SELECT cutoff FROM cut) AS INTEGER) AS cutoff_year,
        CASE WHEN anio <= (SELECT cutoff FROM cut) THEN 'train'
             WHEN anio > (SELECT cutoff FROM cut) THEN 'test' END AS particion FROM data""", PANEL_D))
def q_temporal_split(spark, d):
    return r6(bt.label_split(_data(spark, d)))


@register("horizon_fanout", sql_r6(S.with_(*BASE, S.DATA, S.future()) + " SELECT * FROM fan", PANEL_D))
def q_horizon_fanout(spark, d):
    return r6(tr.horizon_fanout(_data(spark, d), DEFAULT_HORIZONS))


BT_METRICS_SQL = """
 SELECT 'proyeccion_tendencial_grupo' AS model,
        avg(abs(cantidad_ev - cantidad_ev_pred)) AS mae,
        sqrt(avg((cantidad_ev - cantidad_ev_pred) * (cantidad_ev - cantidad_ev_pred))) AS rmse,
        count(*) AS n,
        CASE WHEN var_pop(cantidad_ev) * count(cantidad_ev) > 0
             THEN 1 - sum((cantidad_ev - cantidad_ev_pred) * (cantidad_ev - cantidad_ev_pred))
                      / (var_pop(cantidad_ev) * count(cantidad_ev))
             WHEN sum((cantidad_ev - cantidad_ev_pred) * (cantidad_ev - cantidad_ev_pred)) = 0 THEN 1.0
             ELSE 0.0 END AS r2
 FROM predictions"""


def _trend_metrics(preds):
    return bt.error_metrics(preds, "cantidad_ev", "cantidad_ev_pred").select(
        F.lit(bt.MODEL_TREND).alias("model"), "mae", "rmse", "n", "r2")


@register("backtest_metrics", sql_r6(S.with_(*STAGE1) + BT_METRICS_SQL, ["mae", "rmse", "r2"]))
def q_backtest_metrics(spark, d):
    return r6(_trend_metrics(_preds(spark, d)))


@register("backtest_run_summary", sql_r6(S.with_(*STAGE1) + """,
m AS (""" + BT_METRICS_SQL + """)
 SELECT (SELECT count(*) FROM train) AS train_rows, (SELECT count(*) FROM test) AS test_rows,
        CAST((SELECT cutoff FROM cut) AS INTEGER) AS cutoff_year,
        CAST((SELECT max(anio) FROM data) AS INTEGER) AS base_year,
        (SELECT list_sort(list(DISTINCT CAST(anio AS INTEGER))) FROM test) AS test_years,
        [5, 10, 15, 20, 30] AS forecast_horizons_anios,
        (SELECT list_sort(list(DISTINCT CAST(anio AS INTEGER))) FROM forecast) AS forecast_years,
        m.model AS selected_model, 'proyeccion_tendencial_grupo' AS future_forecast_method,
        ['anio', 'departamento', 'tipo_vehiculo'] AS selected_features,
        m.mae, m.rmse, m.r2 FROM m""", ["mae", "rmse", "r2"]))
def q_backtest_run_summary(spark, d):
    # one panel for the sizes, the errors and the forecast: the records are joined once
    panel = _panel(spark, d)
    preds, future = stage1_trend(panel, DEFAULT_HORIZONS)
    metrics = _trend_metrics(preds)
    chosen = bt.select_model(metrics).first()["model"]
    return r6(fl.run_summary(model_input(panel), future, metrics, chosen, DEFAULT_HORIZONS))


@register("positional_holdout", sql_r6(S.with_(*BASE, S.DATA) + """
 SELECT *, row_number() OVER (ORDER BY anio, departamento, tipo_vehiculo) AS posicion,
        CASE WHEN row_number() OVER (ORDER BY anio, departamento, tipo_vehiculo)
                  > (SELECT count(*) FROM data) - greatest(1, (SELECT count(*) FROM data) // 5)
             THEN 'test' ELSE 'train' END AS particion
 FROM data""", PANEL_D))
def q_positional_holdout(spark, d):
    return r6(bt.positional_holdout(_data(spark, d), [F.col("anio"), F.col("departamento"),
                                                      F.col("tipo_vehiculo")]))


@register("imputation_stats", sql_r6(S.with_(*BASE, S.DATA) + """
 SELECT median(CAST(anio AS DOUBLE)) AS median_anio, median(kwh_promedio) AS median_kwh_promedio,
        median(potencia_carga) AS median_potencia_carga, median(consumo_wh_km) AS median_consumo_wh_km,
        (SELECT departamento FROM train WHERE departamento IS NOT NULL GROUP BY departamento
           ORDER BY count(*) DESC, departamento LIMIT 1) AS mode_departamento,
        (SELECT tipo_vehiculo FROM train WHERE tipo_vehiculo IS NOT NULL GROUP BY tipo_vehiculo
           ORDER BY count(*) DESC, tipo_vehiculo LIMIT 1) AS mode_tipo_vehiculo
 FROM train""", ["median_anio", "median_kwh_promedio", "median_potencia_carga", "median_consumo_wh_km"]))
def q_imputation_stats(spark, d):
    from ..operators.forest import imputation_stats
    train, _ = bt.split_temporal(_data(spark, d))
    return r6(imputation_stats(train, ["anio", "kwh_promedio", "potencia_carga", "consumo_wh_km"],
                               ["departamento", "tipo_vehiculo"]))


@register("group_trend_sparse", sql_r6(S.with_(S.REGISTRATIONS, """
cpanel AS (SELECT anio, CAST(o_custkey AS VARCHAR) AS departamento, tipo_vehiculo,
                  coalesce(sum(cantidad_ev), 0.0) AS cantidad_ev FROM reg GROUP BY ALL)""",
                                           S.trend_fit("tr", "cpanel"))
                                   + " SELECT departamento, tipo_vehiculo, slope, intercept, n_years FROM tr",
                                   ["slope", "intercept"]))
def q_group_trend_sparse(spark, d):
    reg = tb.registrations(spark, d).withColumn("departamento", F.col("o_custkey").cast("string"))
    cpanel = reg.groupBy("anio", "departamento", "tipo_vehiculo").agg(
        F.coalesce(F.sum("cantidad_ev"), F.lit(0.0)).alias("cantidad_ev"))
    return r6(tr.fit_group_trend(cpanel))


# ------------------------------------------------------------- stage 2 ---
@register("forecast_overlay", sql_r6(S.with_(*ENERGY) + " SELECT * FROM overlay",
                                     PANEL_D + ["cantidad_ev_pred", "cantidad_ev_modelada"]))
def q_forecast_overlay(spark, d):
    panel = _panel(spark, d)
    preds, _ = stage1_trend(panel, DEFAULT_HORIZONS)
    return r6(en.forecast_overlay(panel, preds))


@register("history_future_union", sql_r6(S.with_(*ENERGY) + " SELECT * FROM unioned",
                                         PANEL_D + ["cantidad_ev_pred", "cantidad_ev_modelada"]))
def q_history_future_union(spark, d):
    panel = _panel(spark, d)
    preds, fc = stage1_trend(panel, DEFAULT_HORIZONS)
    return r6(en.history_future_union(en.forecast_overlay(panel, preds), fc))


@register("distinct_predictions", sql_r6(S.with_(*STAGE1) + """
 SELECT DISTINCT anio, departamento, tipo_vehiculo, cantidad_ev_pred FROM predictions""", ["cantidad_ev_pred"]))
def q_distinct_predictions(spark, d):
    return r6(en.distinct_predictions(_preds(spark, d)))


SCEN_COLS = en.SCENARIO_BASE_COLUMNS + ["escenario_simultaneidad", "simultaneidad", "demanda_futura",
                                        "demanda_futura_kw"]


@register("scenario_fanout", sql_r6(S.with_(*ENERGY) + f"""
 SELECT {", ".join(c for c in en.SCENARIO_BASE_COLUMNS)}, s.n AS escenario_simultaneidad, s.f AS simultaneidad,
        cantidad_ev_modelada * potencia_carga * s.f AS demanda_futura,
        cantidad_ev_modelada * potencia_carga * s.f AS demanda_futura_kw
 FROM energy CROSS JOIN (VALUES {", ".join(f"('{k}', {v})" for k, v in DEFAULT_SCENARIOS.items())}) s(n, f)""",
                                    [c for c in ENERGY_D if c in SCEN_COLS]))
def q_scenario_fanout(spark, d):
    return r6(en.scenario_fanout(_energy(spark, d), DEFAULT_SCENARIOS))


# ------------------------------------------------------------- stage 3 ---
SNAP_D = ["cantidad_ev", "cantidad_ev_modelada", "consumo_energetico", "demanda_futura"]
COV_D = ["total_activos_hidraulicos", "capacidad_hidraulica_total", "latitud_hidraulica_promedio",
         "longitud_hidraulica_promedio"]
CRIT = ["criterio_demanda", "criterio_crecimiento_ev", "criterio_soporte_hidraulico",
        "criterio_cobertura_hidraulica", "criterio_brecha_soporte_hidraulico",
        "criterio_brecha_cobertura_hidraulica"]


@register("department_snapshot", sql_r6(S.with_(*FLOW) + " SELECT * FROM snap", SNAP_D))
def q_department_snapshot(spark, d):
    return r6(pr.department_snapshot(_energy(spark, d)))


@register("asset_coverage", sql_r6(S.with_(S.ASSETS, *FLOW[-1:]).replace(
    "WITH ", "WITH ", 1).split("snap AS")[0].rstrip().rstrip(",") + """,
coverage AS (
  SELECT departamento, CAST(count(nombre_activo) AS DOUBLE) AS total_activos_hidraulicos,
         coalesce(""" + S.esum("capacidad_hidraulica") + """, 0.0) AS capacidad_hidraulica_total,
         """ + S.eavg("latitud") + """ AS latitud_hidraulica_promedio,
         """ + S.eavg("longitud") + """ AS longitud_hidraulica_promedio
  FROM assets GROUP BY departamento)
 SELECT * FROM coverage""", COV_D))
def q_asset_coverage(spark, d):
    return r6(pr.asset_coverage(tb.assets(spark, d)))


@register("demand_asset_join", sql_r6(S.with_(*FLOW) + " SELECT * FROM joined", SNAP_D + COV_D + ["latitud", "longitud"]))
def q_demand_asset_join(spark, d):
    return r6(pr.demand_asset_join(pr.department_snapshot(_energy(spark, d)), pr.asset_coverage(tb.assets(spark, d))))


def _criteria(spark, d):
    j = pr.demand_asset_join(pr.department_snapshot(_energy(spark, d)), pr.asset_coverage(tb.assets(spark, d)))
    return pr.add_criteria(j)


@register("min_max_scale", sql_r6(S.with_(*FLOW) + " SELECT departamento, " + ", ".join(CRIT) + " FROM crit2", CRIT))
def q_min_max_scale(spark, d):
    return r6(_criteria(spark, d).select("departamento", *CRIT))


@register("weighted_priority_index", sql_r6(S.with_(*FLOW) + " SELECT departamento, indice_prioridad_territorial FROM idx",
                                            ["indice_prioridad_territorial"]))
def q_weighted_priority_index(spark, d):
    return r6(_criteria(spark, d).select("departamento", pr.weighted_index().alias("indice_prioridad_territorial")))


@register("dense_priority_rank", sql_r6(S.with_(*FLOW) + """
 SELECT departamento, indice_prioridad_territorial, ranking_prioridad FROM gis""", ["indice_prioridad_territorial"]))
def q_dense_priority_rank(spark, d):
    return r6(_flow(spark, d).priority.select("departamento", "indice_prioridad_territorial", "ranking_prioridad"))


@register("priority_category", S.with_(*FLOW) + " SELECT departamento, categoria_prioridad FROM gis")
def q_priority_category(spark, d):
    return _flow(spark, d).priority.select("departamento", "categoria_prioridad")


@register("priority_observation", S.with_(*FLOW) + " SELECT departamento, observacion_prioridad FROM gis")
def q_priority_observation(spark, d):
    return _flow(spark, d).priority.select("departamento", "observacion_prioridad")


VALID_SQL = f"""
 SELECT departamento, anio_escenario, escenario_energetico_base, ranking_prioridad, categoria_prioridad,
        indice_prioridad_territorial, demanda_futura, consumo_energetico, cantidad_ev_modelada,
        capacidad_hidraulica_total, total_activos_hidraulicos, {", ".join(CRIT)},
        {S.W['demanda']} AS peso_demanda, {S.W['crecimiento_ev']} AS peso_crecimiento_ev,
        {S.W['soporte_hidraulico']} AS peso_brecha_soporte_hidraulico,
        {S.W['cobertura_hidraulica']} AS peso_brecha_cobertura_hidraulica,
        coalesce(capacidad_hidraulica_total, 0.0) = 0 AS sin_soporte_hidraulico,
        coalesce(total_activos_hidraulicos, 0.0) = 0 AS sin_cobertura_hidraulica,
        (indice_prioridad_territorial <= 0.33 OR criterio_demanda >= 0.10 OR criterio_crecimiento_ev >= 0.10)
          AS consistencia_territorial_ok,
        observacion_prioridad
 FROM gis"""


@register("priority_validation", sql_r6(S.with_(*FLOW) + VALID_SQL,
                                        ["indice_prioridad_territorial", "demanda_futura", "consumo_energetico",
                                         "cantidad_ev_modelada", "capacidad_hidraulica_total",
                                         "total_activos_hidraulicos", "peso_demanda", "peso_crecimiento_ev",
                                         "peso_brecha_soporte_hidraulico", "peso_brecha_cobertura_hidraulica"] + CRIT))
def q_priority_validation(spark, d):
    return r6(_flow(spark, d).validation)


# ----------------------------------------------------- change, map data ---
from ..operators import change as ch  # noqa: E402
from ..operators import mapdata as md  # noqa: E402
from ..operators.lookup_cache import LookupCache  # noqa: E402
from ..sources import io as io_  # noqa: E402
from ..sources import offset_scan  # noqa: E402
from ..sources import snapshots as sn  # noqa: E402
from ..sources import roles as rl  # noqa: E402
from ..session import scratch_path  # noqa: E402

YEARLY_D = ["cantidad_ev_historica", "cantidad_ev_modelada", "consumo_energetico", "demanda_futura",
            "aumento_demanda", "aumento_demanda_pct"]
MAPS = FLOW + (S.YEARLY,)


def _yearly(spark, d):
    return ch.yearly_department_demand(_energy(spark, d))


@register("yearly_department_demand", sql_r6(S.with_(*MAPS) + " SELECT * FROM chg", YEARLY_D))
def q_yearly_department_demand(spark, d):
    return r6(_yearly(spark, d))


EVENTS_DAILY = """
WITH daily AS (SELECT event_type, CAST(ts AS DATE) AS dia, coalesce(sum(value), 0.0) AS valor_total
               FROM events GROUP BY event_type, CAST(ts AS DATE))
SELECT *, CASE WHEN event_type IS NULL THEN 0.0 ELSE coalesce(valor_total - lag(valor_total) OVER w, 0.0) END
            AS aumento_valor,
          CASE WHEN event_type IS NULL THEN 0.0 ELSE coalesce((valor_total - lag(valor_total) OVER w)
            / nullif(lag(valor_total) OVER w, 0), 0.0) END AS aumento_valor_pct
FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY dia)"""


def _events_change(spark, d):
    ev = tb.read_table(spark, d, "events")
    daily = ev.groupBy("event_type", F.to_date("ts").alias("dia")).agg(
        F.coalesce(F.sum("value"), F.lit(0.0)).alias("valor_total"))
    return ch.period_change(daily, "event_type", "dia", "valor_total", "aumento_valor", "aumento_valor_pct")


@register("period_change", sql_r6("SELECT event_type, dia, valor_total, aumento_valor FROM (" + EVENTS_DAILY + ")",
                                  ["valor_total", "aumento_valor"]))
def q_period_change(spark, d):
    return r6(_events_change(spark, d).select("event_type", "dia", "valor_total", "aumento_valor"))


@register("period_change_pct", sql_r6("SELECT event_type, dia, valor_total, aumento_valor_pct FROM ("
                                      + EVENTS_DAILY + ")", ["valor_total", "aumento_valor_pct"]))
def q_period_change_pct(spark, d):
    return r6(_events_change(spark, d).select("event_type", "dia", "valor_total", "aumento_valor_pct"))


def _points(spark, d):
    fl = _flow(spark, d)
    return md.demand_points(fl.energy, fl.priority)


POINTS_SQL = """,
pts AS (
  SELECT e.*, g.latitud, g.longitud, g.categoria_prioridad, g.ranking_prioridad
  FROM energy e LEFT JOIN gis g ON e.departamento IS NOT DISTINCT FROM g.departamento
  WHERE e.anio = (SELECT max(anio) FROM energy) AND g.latitud IS NOT NULL AND g.longitud IS NOT NULL
)"""


@register("demand_points", sql_r6(S.with_(*FLOW) + POINTS_SQL + " SELECT * FROM pts",
                                  ENERGY_D + ["latitud", "longitud"]))
def q_demand_points(spark, d):
    return r6(_points(spark, d))


@register("heat_points", sql_r6(S.with_(*FLOW) + POINTS_SQL + """
 SELECT departamento, tipo_vehiculo, latitud, longitud, coalesce(demanda_futura, 0.0) AS peso FROM pts""",
                                ["latitud", "longitud", "peso"]))
def q_heat_points(spark, d):
    return r6(md.heat_points(_points(spark, d)))


@register("pressure_radius", sql_r6(S.with_(*FLOW) + POINTS_SQL + f"""
 SELECT departamento, tipo_vehiculo, latitud, longitud,
        greatest(coalesce(demanda_futura, 0.0) * 2.0, 5000.0) AS radio_m,
        '<b>' || coalesce(departamento, 'N/A') || '</b><br>Demanda futura: ' || {S.fixed('demanda_futura', 2)}
        || '<br>Consumo energetico: ' || {S.fixed('consumo_energetico', 2)} AS popup FROM pts""",
                                    ["latitud", "longitud", "radio_m"]))
def q_pressure_radius(spark, d):
    return r6(md.pressure_circles(_points(spark, d)))


def _boundary_features(n):
    """Rows of nation with a GeoJSON feature: a small square around its synthetic centre."""
    lat, lon = tb.synthetic_lat(F.col("n_nationkey")), tb.synthetic_lon(F.col("n_nationkey"))
    ring = F.array(*[F.array(lon + dx, lat + dy) for dx, dy in
                     [(-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5), (-0.5, -0.5)]])
    feat = F.to_json(F.struct(F.lit("Feature").alias("type"),
                              F.struct(F.lower("n_name").alias("shapeName")).alias("properties"),
                              F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
                              .alias("geometry")))
    return n.select("n_regionkey", feat.alias("feature"))


def _boundaries(spark, d):
    """Department shapes, written as GeoJSON (one feature per line) to the
    shared scratch folder and read back by the source."""
    path = scratch_path(spark, "boundaries")
    io_.write_geojson_lines(_boundary_features(tb.read_table(spark, d, "nation")).select("feature"), path)
    return io_.read_boundaries(spark, path)


BOUND_SQL = f""",
bnd AS (SELECT lower(n_name) AS shapeName, {S.norm_dept('lower(n_name)')} AS departamento FROM nation),
bm AS (SELECT b.shapeName, b.departamento, g.* EXCLUDE (departamento)
       FROM bnd b LEFT JOIN gis g ON b.departamento IS NOT DISTINCT FROM g.departamento)"""


@register("boundary_metrics", sql_r6(S.with_(*FLOW) + BOUND_SQL + " SELECT * FROM bm", GIS_D))
def q_boundary_metrics(spark, d):
    return r6(md.boundary_metrics(_boundaries(spark, d), _flow(spark, d).priority).drop("geometry"))


def _boundary_sql() -> str:
    lat, lon = S.synthetic_lat("n_nationkey"), S.synthetic_lon("n_nationkey")
    ring = ", ".join(f"[{lon} + ({dx}), {lat} + ({dy})]"
                     for dx, dy in [(-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5), (-0.5, -0.5)])
    return (f"SELECT lower(n_name) AS shapeName, {S.norm_dept('lower(n_name)')} AS departamento, "
            f"CAST(to_json({{'coordinates': [[{ring}]], 'type': 'Polygon'}}) AS VARCHAR) AS geometry FROM nation")


@register("boundary_features", _boundary_sql())
def q_boundary_features(spark, d):
    return _boundaries(spark, d)


CHORO_COLS = ["shapeName", "departamento", "demanda_futura", "demanda_futura_display", "consumo_energetico_display",
              "cantidad_ev_modelada_display", "indice_prioridad_display"]


@register("choropleth_frame", sql_r6(S.with_(*FLOW) + BOUND_SQL + f"""
 SELECT shapeName, departamento, demanda_futura,
        {S.format_metric('demanda_futura', 'kW', 2)} AS demanda_futura_display,
        {S.format_metric('consumo_energetico', 'kWh', 2)} AS consumo_energetico_display,
        {S.format_metric('cantidad_ev_modelada', 'vehiculos', 0)} AS cantidad_ev_modelada_display,
        {S.format_metric('indice_prioridad_territorial', 'indice', 3)} AS indice_prioridad_display
 FROM bm""", ["demanda_futura"]))
def q_choropleth_frame(spark, d):
    merged = md.boundary_metrics(_boundaries(spark, d), _flow(spark, d).priority)
    out = md.choropleth_frame(merged, "demanda_futura", "kW")
    return r6(out.select(*CHORO_COLS))


@register("format_metric", S.with_(*FLOW) + f"""
 SELECT departamento, {S.format_metric('demanda_futura', 'kW', 2)} AS demanda_texto,
        {S.format_metric('consumo_energetico', 'kWh', 2)} AS consumo_texto,
        {S.format_metric('cantidad_ev_modelada', 'vehiculos', 0)} AS vehiculos_texto,
        {S.format_metric('indice_prioridad_territorial', 'indice', 3)} AS indice_texto,
        {S.format_metric('capacidad_hidraulica_total', '', 2)} AS capacidad_texto
 FROM gis""")
def q_format_metric(spark, d):
    from ..functions.text import format_metric as fm
    g = _flow(spark, d).priority
    return g.select("departamento", fm(F.col("demanda_futura"), "kW", 2).alias("demanda_texto"),
                    fm(F.col("consumo_energetico"), "kWh", 2).alias("consumo_texto"),
                    fm(F.col("cantidad_ev_modelada"), "vehiculos", 0).alias("vehiculos_texto"),
                    fm(F.col("indice_prioridad_territorial"), "indice", 3).alias("indice_texto"),
                    fm(F.col("capacidad_hidraulica_total"), "", 2).alias("capacidad_texto"))


@register("display_label", f"""
SELECT n_nationkey, {S.display_label(S.norm_dept('n_name'))} AS etiqueta FROM nation
UNION ALL
SELECT 1000 + r_regionkey, {S.display_label('r_name')} FROM region""")
def q_display_label(spark, d):
    from ..functions.text import display_label, normalize_territory
    n = tb.read_table(spark, d, "nation").select(
        "n_nationkey", display_label(normalize_territory(F.col("n_name"))).alias("etiqueta"))
    r = tb.read_table(spark, d, "region").select(
        (F.col("r_regionkey") + 1000).alias("n_nationkey"), display_label(F.col("r_name")).alias("etiqueta"))
    return n.unionByName(r)


@register("category_color", S.with_(*FLOW) + f"""
 SELECT departamento, categoria_prioridad, {S.category_color('categoria_prioridad')} AS color FROM gis""")
def q_category_color(spark, d):
    from ..functions.text import category_color
    g = _flow(spark, d).priority
    return g.select("departamento", "categoria_prioridad", category_color(F.col("categoria_prioridad")).alias("color"))


PRIORITY_POPUP_SQL = (f"'<b>' || coalesce(departamento, 'None') || '</b><br>Indice: ' || "
                      f"{S.fixed('indice_prioridad_territorial', 3)} || '<br>Ranking: ' || "
                      f"coalesce(CAST(ranking_prioridad AS VARCHAR), '0') || '<br>Categoria: ' || "
                      f"coalesce(categoria_prioridad, 'N/A') || '<br>Demanda futura: ' || {S.fixed('demanda_futura', 2)}")


@register("priority_markers", sql_r6(S.with_(*FLOW) + f"""
 SELECT departamento, latitud, longitud, ranking_prioridad, categoria_prioridad,
        {S.category_color('categoria_prioridad')} AS color, {PRIORITY_POPUP_SQL} AS popup
 FROM gis WHERE latitud IS NOT NULL AND longitud IS NOT NULL""", ["latitud", "longitud"]))
def q_priority_markers(spark, d):
    return r6(md.priority_markers(_flow(spark, d).priority))


@register("popup_text", S.with_(*FLOW) + f" SELECT departamento, {PRIORITY_POPUP_SQL} AS popup FROM gis")
def q_popup_text(spark, d):
    return _flow(spark, d).priority.select("departamento", md.priority_popup().alias("popup"))


@register("asset_markers", sql_r6(S.with_(S.ASSETS) + """
 SELECT id_activo, nombre_activo, departamento, latitud, longitud,
        '<b>' || coalesce(nombre_activo, 'Activo hidraulico') || '</b><br>Departamento: ' ||
        coalesce(departamento, 'N/A') || '<br>Municipio: ' || coalesce(municipio, 'N/A') ||
        '<br>Capacidad hidraulica: ' || coalesce(CAST(capacidad_hidraulica AS VARCHAR), '0') AS popup
 FROM assets WHERE latitud IS NOT NULL AND longitud IS NOT NULL""", ["latitud", "longitud"]))
def q_asset_markers(spark, d):
    return r6(md.asset_markers(tb.assets(spark, d)))


PAYLOAD_SQL = f""",
flat AS (
  SELECT departamento, CAST(anio AS INTEGER) AS anio,
         {S.rnd('coalesce(demanda_futura, 0.0)', 2)} AS demanda_futura,
         {S.rnd('coalesce(consumo_energetico, 0.0)', 2)} AS consumo_energetico,
         {S.rnd('coalesce(cantidad_ev_modelada, 0.0)', 2)} AS cantidad_ev_modelada,
         {S.rnd('coalesce(cantidad_ev_historica, 0.0)', 2)} AS cantidad_ev_historica,
         {S.rnd('coalesce(aumento_demanda, 0.0)', 2)} AS aumento_demanda,
         {S.rnd('coalesce(aumento_demanda_pct, 0.0) * 100', 2)} AS aumento_demanda_pct
  FROM chg
)"""


@register("yearly_payload_flat", S.with_(*MAPS) + PAYLOAD_SQL + " SELECT * FROM flat")
def q_yearly_payload_flat(spark, d):
    return md.payload_flat(_yearly(spark, d))


@register("yearly_payload")
def q_yearly_payload(spark, d):
    return md.payload_nested(md.payload_flat(_yearly(spark, d)))


DOMAIN_SQL = """,
dom AS (
  SELECT CASE WHEN mn = mx THEN least(0.0, mn) ELSE mn END AS dominio_min,
         CASE WHEN mn = mx THEN greatest(1.0, mx) ELSE mx END AS dominio_max,
         0.0 AS escala_min, greatest(1.0, mx) AS escala_max
  FROM (SELECT coalesce(min(coalesce(demanda_futura, 0.0)), 0.0) AS mn,
               coalesce(max(coalesce(demanda_futura, 0.0)), 0.0) AS mx FROM chg)
)"""


@register("metric_domain", sql_r6(S.with_(*MAPS) + DOMAIN_SQL + " SELECT * FROM dom",
                                  ["dominio_min", "dominio_max", "escala_min", "escala_max"]))
def q_metric_domain(spark, d):
    return r6(md.metric_domain(_yearly(spark, d), "demanda_futura"))


@register("projected_years", S.with_(*MAPS) + """
 SELECT DISTINCT CAST(anio AS INTEGER) AS anio,
        (SELECT coalesce(max(CASE WHEN cantidad_ev_historica > 0 THEN anio END), min(anio)) FROM chg)
          AS ultimo_anio_historico,
        anio > (SELECT coalesce(max(CASE WHEN cantidad_ev_historica > 0 THEN anio END), min(anio)) FROM chg)
          AS proyectado
 FROM chg WHERE anio IS NOT NULL""")
def q_projected_years(spark, d):
    return md.projected_years(_yearly(spark, d))


@register("color_bin", sql_r6(S.with_(*MAPS) + DOMAIN_SQL + f"""
 SELECT c.departamento, c.anio, c.demanda_futura,
        CASE WHEN c.demanda_futura IS NULL THEN NULL
             WHEN d.dominio_max <= d.dominio_min THEN 8
             ELSE CAST(least(floor(greatest(least((c.demanda_futura - d.dominio_min)
                  / (d.dominio_max - d.dominio_min), 1.0), 0.0) * 8 + 0.5), 8) AS INTEGER) END AS bin_color,
        coalesce(list_extract({S.PALETTE_SQL},
          CASE WHEN c.demanda_futura IS NULL THEN NULL
             WHEN d.dominio_max <= d.dominio_min THEN 8
             ELSE CAST(least(floor(greatest(least((c.demanda_futura - d.dominio_min)
                  / (d.dominio_max - d.dominio_min), 1.0), 0.0) * 8 + 0.5), 8) AS INTEGER) END + 1), '#d9d9d9')
          AS color
 FROM chg c, dom d WHERE c.anio = (SELECT max(anio) FROM chg)""", ["demanda_futura"]))
def q_color_bin(spark, d):
    y = _yearly(spark, d)
    last = pn.latest_snapshot(y, "anio").select("departamento", "anio", "demanda_futura")
    return r6(md.color_bins(last, "demanda_futura", md.metric_domain(y, "demanda_futura")))


@register("clean_horizons", S.with_(*BASE, S.DATA) + """,
offs AS (SELECT departamento, tipo_vehiculo,
                list_sort(list_distinct(list_filter(list(CAST(anio - (SELECT min(anio) FROM data) AS INTEGER)),
                                                    lambda x: x > 0))) AS h
         FROM data GROUP BY departamento, tipo_vehiculo)
 SELECT departamento, tipo_vehiculo, array_to_string(CASE WHEN len(h) > 0 THEN h ELSE [5, 10, 15, 20, 30] END, ',')
        AS horizontes FROM offs""")
def q_clean_horizons(spark, d):
    out = md.observed_horizons(_data(spark, d), ["departamento", "tipo_vehiculo"])
    return out.select("departamento", "tipo_vehiculo", F.array_join("horizontes", ",").alias("horizontes"))


# ------------------------------------------------------------ text, places --
from ..functions import text as tx  # noqa: E402
from ..operators import places as pl  # noqa: E402


@register("normalize_territory", f"SELECT doc_id, {S.norm_dept('text')} AS departamento FROM documents")
def q_normalize_territory(spark, d):
    docs = tb.read_table(spark, d, "documents")
    return docs.select("doc_id", tx.normalize_territory(F.col("text")).alias("departamento"))


@register("standardize_text", f"SELECT doc_id, {S.standardize('text')} AS texto FROM documents")
def q_standardize_text(spark, d):
    docs = tb.read_table(spark, d, "documents")
    return docs.select("doc_id", tx.standardize_text(F.col("text")).alias("texto"))


@register("fold_accents", f"SELECT doc_id, {S.fold('text')} AS clave FROM documents")
def q_fold_accents(spark, d):
    docs = tb.read_table(spark, d, "documents")
    return docs.select("doc_id", tx.fold_accents(F.col("text")).alias("clave"))


def _lookup_rows(spark, d):
    cg = rl.customers_geo(spark, d)
    return cg, pl.lookup_queries(F.col("nombre"), F.col("municipio"), F.col("departamento"), F.col("subarea"))


QS_SQL = S.lookup_queries("nombre", "municipio", "departamento", "subarea")


@register("build_lookup_queries", S.with_(S.CUSTOMERS_GEO) + f"""
 SELECT c_custkey, array_to_string({QS_SQL}, ' | ') AS consultas, CAST(len({QS_SQL}) AS INTEGER) AS n_consultas
 FROM cgeo""")
def q_build_lookup_queries(spark, d):
    cg, qs = _lookup_rows(spark, d)
    return cg.select("c_custkey", F.array_join(qs, " | ").alias("consultas"), F.size(qs).alias("n_consultas"))


WATERFALL_SQL = S.with_(S.CUSTOMERS_GEO, S.ASSETS, S.GAZETTEER) + f""",
need AS (SELECT c_custkey, {QS_SQL} AS qs FROM cgeo WHERE latitud IS NULL OR longitud IS NULL),
ex AS (SELECT c_custkey, qs[i] AS q, i AS pos FROM need, range(1, len(qs) + 1) r(i)),
hits AS (
  SELECT ex.c_custkey, arg_min(struct_pack(q := g.query, lat := g.latitud, lon := g.longitud,
                                           src := g.display_name), ex.pos) AS h
  FROM ex JOIN gazetteer g ON ex.q = g.query
  WHERE g.latitud IS NOT NULL AND g.longitud IS NOT NULL GROUP BY ex.c_custkey
)
 SELECT c.c_custkey, coalesce(c.latitud, h.h.lat) AS latitud, coalesce(c.longitud, h.h.lon) AS longitud,
        h.h.q AS geocoding_query, h.h.src AS geocoding_source
 FROM cgeo c LEFT JOIN hits h ON c.c_custkey = h.c_custkey"""


@register("waterfall_lookup", WATERFALL_SQL)
def q_waterfall_lookup(spark, d):
    cg, qs = _lookup_rows(spark, d)
    out = pl.waterfall_lookup(cg, rl.gazetteer(spark, d), "c_custkey", qs)
    return out.select("c_custkey", "latitud", "longitud", "geocoding_query", "geocoding_source")


@register("lookup_dry_run", S.with_(S.CUSTOMERS_GEO) + f"""
 SELECT c_custkey, latitud, longitud,
        CASE WHEN latitud IS NULL OR longitud IS NULL THEN ({QS_SQL})[1] END AS geocoding_query,
        CASE WHEN latitud IS NULL OR longitud IS NULL THEN 'dry_run' END AS geocoding_source
 FROM cgeo""")
def q_lookup_dry_run(spark, d):
    cg, qs = _lookup_rows(spark, d)
    out = pl.waterfall_lookup(cg, rl.gazetteer(spark, d), "c_custkey", qs, dry_run=True)
    return out.select("c_custkey", "latitud", "longitud", "geocoding_query", "geocoding_source")


@register("lookup_cache_upsert", S.with_(S.CUSTOMERS_GEO, S.ASSETS, S.GAZETTEER) + f""",
cache AS (SELECT query, latitud, longitud, CASE WHEN latitud IS NOT NULL THEN query END AS display_name
          FROM gaz_reg UNION ALL
          SELECT query, latitud, longitud, CASE WHEN latitud IS NOT NULL THEN query END FROM gaz_dep),
res AS (SELECT query, latitud, longitud, query AS display_name FROM gaz_seg
        UNION ALL
        SELECT departamento || ', Colombia', {S.rnd(S.eavg('latitud'), 4)}, {S.rnd(S.eavg('longitud'), 4)},
               departamento || ', Colombia'
        FROM cgeo WHERE latitud IS NOT NULL GROUP BY departamento)
 SELECT * FROM cache
 UNION ALL
 SELECT * FROM (SELECT DISTINCT ON (query) * FROM res WHERE query NOT IN (SELECT query FROM cache)
                ORDER BY query)""")
def q_lookup_cache_upsert(spark, d):
    cache, new = _lookups(spark, d)
    return pl.cache_upsert(cache, new)


@register("lookup_cache_files", ORACLE["lookup_cache_upsert"])
def q_lookup_cache_files(spark, d):
    """The same in a kept cache: what was cached, then the new results added to its files."""
    cached, new = _lookups(spark, d)
    cache = LookupCache(spark, scratch_path(spark, "cache"), "query string, latitud double, longitud double, display_name string")
    cache.upsert(cached.select(*cache.columns))
    cache.upsert(new.select(*cache.columns))
    return cache.read()


def _lookups(spark, d):
    cache = rl.gazetteer(spark, d, include_segments=False)
    seg = rl.gazetteer(spark, d).join(cache.select("query"), "query", "left_anti")
    cg = rl.customers_geo(spark, d).where(F.col("latitud").isNotNull())
    from ..functions.numeric import exact_avg
    dep = cg.groupBy("departamento").agg(F.round(exact_avg(F.col("latitud")), 4).alias("latitud"),
                                         F.round(exact_avg(F.col("longitud")), 4).alias("longitud"))
    dep = dep.select(F.concat("departamento", F.lit(", Colombia")).alias("query"), "latitud", "longitud") \
        .withColumn("display_name", F.col("query"))
    return cache, seg.unionByName(dep)


COMPLETED_SQL = f"""
cat AS (SELECT upper(source) AS municipio,
               {S.rnd(S.eavg(S.synthetic_lat('doc_id')), 4)} AS latitud,
               {S.rnd(S.eavg(S.synthetic_lon('doc_id')), 4)} AS longitud
        FROM documents GROUP BY upper(source)),
ovr AS (SELECT l.doc_id AS id, ' ' || d.source || ' ' AS municipio,
               CASE WHEN l.quality = 1 THEN {S.synthetic_lat('l.doc_id')} END AS latitud,
               CASE WHEN l.quality = 1 AND l.toxic = 0 THEN {S.synthetic_lon('l.doc_id')} END AS longitud
        FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id),
completed AS (
  SELECT CAST(o.id AS BIGINT) AS id, {S.strip('o.municipio')} AS municipio,
         coalesce(o.latitud, c.latitud) AS latitud, coalesce(o.longitud, c.longitud) AS longitud,
         '{pl.PRECISION_OVERRIDE}' AS precision_ubicacion, '{pl.DETAIL_OVERRIDE}' AS detalle_ubicacion
  FROM ovr o LEFT JOIN cat c ON {S.fold('o.municipio')} = {S.fold('c.municipio')}
  WHERE o.id IS NOT NULL AND {S.strip('o.municipio')} IS NOT NULL AND {S.strip('o.municipio')} <> ''
)"""


def _completed(spark, d):
    return pl.complete_overrides(rl.raw_overrides(spark, d), rl.municipality_catalogue(spark, d))


@register("catalog_completion", sql_r6("WITH " + COMPLETED_SQL + " SELECT * FROM completed", ["latitud", "longitud"]))
def q_catalog_completion(spark, d):
    return r6(_completed(spark, d))


@register("override_join", sql_r6("WITH " + COMPLETED_SQL + f""",
base AS (SELECT doc_id AS id, upper(lang) AS departamento,
                {S.rnd(S.synthetic_lat('doc_id') + ' / 2', 4)} AS latitud,
                {S.rnd(S.synthetic_lon('doc_id') + ' / 2', 4)} AS longitud FROM documents)
 SELECT b.id, b.departamento,
        CASE WHEN h THEN o.municipio ELSE '{pl.NO_MUNICIPALITY}' END AS municipio,
        CASE WHEN h THEN o.latitud ELSE b.latitud END AS latitud,
        CASE WHEN h THEN o.longitud ELSE b.longitud END AS longitud,
        CASE WHEN h THEN o.precision_ubicacion ELSE '{pl.PRECISION_APPROX}' END AS precision_ubicacion,
        CASE WHEN h THEN o.detalle_ubicacion ELSE '{pl.DETAIL_APPROX}' END AS detalle_ubicacion
 FROM (SELECT b.*, o.id AS oid, coalesce(o.municipio IS NOT NULL AND o.latitud IS NOT NULL
                                         AND o.longitud IS NOT NULL, false) AS h
       FROM base b LEFT JOIN completed o ON b.id = o.id) b
 LEFT JOIN completed o ON b.oid = o.id""", ["latitud", "longitud"]))
def q_override_join(spark, d):
    out = pl.apply_overrides(rl.plants(spark, d), _completed(spark, d))
    return r6(out.select("id", "departamento", "municipio", "latitud", "longitud", "precision_ubicacion",
                         "detalle_ubicacion"))


@register("nearest_reference_lookup", S.with_(S.EMB_REF) + """,
ex AS (SELECT q.vec_id, r.v FROM qpts q JOIN ref r ON round_even(q.qx, 4) = r.rx AND round_even(q.qy, 4) = r.ry),
nr AS (
  SELECT q.vec_id, arg_min(r.v, struct_pack(d := (q.qx - r.rx) * (q.qx - r.rx) + (q.qy - r.ry) * (q.qy - r.ry),
                                            o := r.o)) AS v
  FROM qpts q, ref r WHERE q.vec_id NOT IN (SELECT vec_id FROM ex) AND q.qx IS NOT NULL AND q.qy IS NOT NULL
  GROUP BY q.vec_id
)
 SELECT q.vec_id, coalesce(CAST(coalesce(ex.v, nr.v) AS VARCHAR), 'UNKNOWN') AS valor,
        CASE WHEN ex.vec_id IS NOT NULL THEN 'exacta' WHEN nr.vec_id IS NOT NULL THEN 'cercana'
             ELSE 'sin_coordenadas' END AS metodo
 FROM qpts q LEFT JOIN ex ON q.vec_id = ex.vec_id LEFT JOIN nr ON q.vec_id = nr.vec_id""")
def q_nearest_reference_lookup(spark, d):
    out = pl.nearest_lookup(rl.embedding_queries(spark, d), rl.embedding_reference(spark, d),
                            "vec_id", "x", "y", "x", "y", "valor", "orden")
    return out.select("vec_id", "valor", "metodo")


ASSIGN_SQL = f"""
dem AS (SELECT c.c_custkey, c.c_name, {S.fold('n.n_name')} AS clave,
               row_number() OVER (PARTITION BY {S.fold('n.n_name')} ORDER BY c.c_custkey) AS posicion
        FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey),
cand AS (SELECT s.s_suppkey, s.s_name, {S.fold('n.n_name')} AS clave,
                row_number() OVER (PARTITION BY {S.fold('n.n_name')} ORDER BY s.s_suppkey) AS posicion
         FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey),
asg AS (SELECT d.c_custkey, d.c_name, d.clave, d.posicion, c.s_suppkey, c.s_name, c.s_suppkey IS NOT NULL AS asignado
        FROM dem d LEFT JOIN cand c ON d.clave IS NOT DISTINCT FROM c.clave AND d.posicion = c.posicion)"""


def _assignment(spark, d):
    dem = rl.customers_by_nation(spark, d).withColumn("clave", tx.fold_accents(F.col("n_name"))).drop("n_name")
    cand = rl.suppliers_by_nation(spark, d).withColumn("clave", tx.fold_accents(F.col("n_name"))).drop("n_name")
    return pl.positional_assignment(dem, cand, ["clave"], [F.col("c_custkey")], [F.col("s_suppkey")])


@register("positional_assignment", "WITH " + ASSIGN_SQL + " SELECT * FROM asg")
def q_positional_assignment(spark, d):
    return _assignment(spark, d).select("c_custkey", "c_name", "clave", "posicion", "s_suppkey", "s_name", "asignado")


@register("unassigned_rows", "WITH " + ASSIGN_SQL + " SELECT c_custkey, clave, posicion FROM asg WHERE NOT asignado")
def q_unassigned_rows(spark, d):
    return _assignment(spark, d).where(~F.col("asignado")).select("c_custkey", "clave", "posicion")


@register("assignment_summary", "WITH " + ASSIGN_SQL + """
 SELECT count(*) AS total, count_if(asignado) AS asignados, count_if(NOT asignado) AS sin_asignar FROM asg""")
def q_assignment_summary(spark, d):
    return pl.assignment_summary(_assignment(spark, d))


NULL_COLS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]


@register("null_profile", "WITH j AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l "
                          "ON d.doc_id = l.doc_id), c AS (" + " UNION ALL ".join(
                              f"SELECT '{c}' AS column_name, count_if({c} IS NULL) AS null_count FROM j"
                              for c in NULL_COLS) + ") SELECT * FROM c ORDER BY null_count DESC, column_name LIMIT 20")
def q_null_profile(spark, d):
    docs = tb.read_table(spark, d, "documents")
    j = docs.join(tb.read_table(spark, d, "labels"), "doc_id", "left").select(*NULL_COLS)
    return pn.null_profile(j, 20)


@register("group_sum_preview", S.with_(S.REGISTRATIONS) + """
 SELECT departamento, tipo_vehiculo, coalesce(sum(cantidad_ev), 0.0) AS cantidad_ev FROM reg
 GROUP BY departamento, tipo_vehiculo ORDER BY departamento NULLS FIRST, tipo_vehiculo NULLS FIRST LIMIT 20""")
def q_group_sum_preview(spark, d):
    return pn.group_sum_preview(tb.registrations(spark, d), ["departamento", "tipo_vehiculo"], "cantidad_ev")


# ------------------------------------------------------------ sources, sinks --
MESSY_HEADERS = {"c_custkey": " Código Cliente ", "c_name": "Nombre  del Cliente", "c_nationkey": "NACIÓN-Clave",
                 "c_acctbal": "Saldo (COP)", "c_mktsegment": "Segmento de Mercado"}


@register("normalize_headers", """
SELECT c_custkey AS codigo_cliente, c_name AS nombre_del_cliente, c_nationkey AS nacion_clave,
       c_acctbal AS saldo_cop, c_mktsegment AS segmento_de_mercado FROM customer""")
def q_normalize_headers(spark, d):
    c = tb.read_table(spark, d, "customer")
    messy = c.select(*[F.col(k).alias(v) for k, v in MESSY_HEADERS.items()])
    return io_.normalize_headers(messy)


RAW_SQL = S.with_(S.REGISTRATIONS).split("reg AS")[0] + """raw AS (
  SELECT o.o_orderstatus AS estado, strftime(o.o_orderdate, '%Y-%m-%d') AS fecha_registro,
         CAST(year(o.o_orderdate) AS INTEGER) AS anio_registro, p.p_type AS clase, n.n_name AS departamento,
         l.l_quantity AS cantidad, l.l_extendedprice AS capacidad_kwh, p.p_size AS consumo_wh_km,
         p.p_retailprice AS potencia_carga_dc_kw
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN part p ON l.l_partkey = p.p_partkey)"""

ALIASES = {"capacidad_kwh": "kwh_promedio", "potencia_carga_dc_kw": "potencia_carga", "clase": "clase"}
REQUIRED = {"combustible": "string", "marca_ev_colombia": "string", "autonomia_km": "double", "cantidad": "double"}


@register("alias_and_require_columns", RAW_SQL + """
 SELECT *, capacidad_kwh AS kwh_promedio, potencia_carga_dc_kw AS potencia_carga,
        CAST(NULL AS VARCHAR) AS combustible, CAST(NULL AS VARCHAR) AS marca_ev_colombia,
        CAST(NULL AS DOUBLE) AS autonomia_km FROM raw""")
def q_alias_and_require_columns(spark, d):
    return io_.alias_and_require(tb.registrations_raw(spark, d), ALIASES, REQUIRED)


PREFERRED = ["departamento", "anio_registro", "clase", "cantidad", "departamento", "no_existe"]


@register("order_columns", RAW_SQL + """
 SELECT departamento, anio_registro, clase, cantidad, estado, fecha_registro, capacidad_kwh, consumo_wh_km,
        potencia_carga_dc_kw FROM raw""")
def q_order_columns(spark, d):
    return io_.order_columns(tb.registrations_raw(spark, d), PREFERRED)


@register("scan_registrations", RAW_SQL + " SELECT * FROM raw")
def q_scan_registrations(spark, d):
    raw = tb.registrations_raw(spark, d)
    path = scratch_path(spark, "registrations_csv")
    raw.write.mode("overwrite").option("header", True).csv(path)
    return io_.scan_csv(spark, path, raw.schema)


@register("scan_with_offset", RAW_SQL + " SELECT * FROM raw")
def q_scan_with_offset(spark, d):
    """Files whose table begins below five lines of other text, as the source workbook has them."""
    raw = tb.registrations_raw(spark, d)
    path = scratch_path(spark, "registrations_offset")
    offset_scan.write_with_offset(raw, path, ["Informe de registros", "", "Corte: anual;;", "a,b", "\"sin tabla\""])
    return offset_scan.scan_with_offset(spark, path, raw.schema, skip=5)


@register("optional_source_fallback", "SELECT * FROM lineitem")
def q_optional_source_fallback(spark, d):
    import os
    return tb.table_if_exists(spark, "vehiculos_ev_no_registrada", os.path.join(d, "lineitem.parquet"))


@register("sink_overwrite_roundtrip", sql_r6(S.with_(*BASE) + " SELECT * FROM panel", PANEL_D))
def q_sink_overwrite_roundtrip(spark, d):
    return r6(io_.overwrite_roundtrip(spark, _panel(spark, d), scratch_path(spark, "panel_parquet")))


@register("refresh_result_table", sql_r6(S.with_(*BASE) + " SELECT * FROM panel", PANEL_D))
def q_refresh_result_table(spark, d):
    # ensures database and table (CREATE ... IF NOT EXISTS), then a new folder and one switch
    return r6(sn.refresh(spark, _panel(spark, d), "etapa1_temporal", scratch_path(spark, "etapa1_temporal"), "territoria_resultados"))


@register("sink_csv_roundtrip", sql_r6(S.with_(*BASE) + " SELECT * FROM panel", PANEL_D))
def q_sink_csv_roundtrip(spark, d):
    return r6(io_.csv_roundtrip(spark, _panel(spark, d), scratch_path(spark, "panel_csv")))


@register("geojson_point_features")
def q_geojson_point_features(spark, d):
    return io_.geojson_point_features(_flow(spark, d).priority)


@register("streaming_daily_panel", """
SELECT CAST(ts AS DATE) AS dia, event_type, coalesce(sum(value), 0.0) AS valor_total, count(*) AS eventos
FROM events GROUP BY CAST(ts AS DATE), event_type""")
def q_streaming_daily_panel(spark, d):
    from ..streaming.panel_stream import daily_event_panel_stream
    base = scratch_path(spark, "stream")
    out = daily_event_panel_stream(spark, d, "events.parquet", base + "/out", base + "/ckpt")
    return r6(out)


@register("yearly_payload_entries", S.with_(*MAPS) + PAYLOAD_SQL + " SELECT * FROM flat")
def q_yearly_payload_entries(spark, d):
    """The nested payload taken apart again: its keys and values hold every flat row."""
    nested = q_yearly_payload(spark, d)
    return nested.select("departamento", F.explode("metricas_por_anio").alias("anio", "m")).select(
        "departamento", F.col("anio").cast("int").alias("anio"), "m.*")


@register("geojson_features", sql_r6(S.with_(*FLOW) + """
 SELECT departamento, longitud AS x, latitud AS y, ranking_prioridad FROM gis
 WHERE latitud IS NOT NULL AND longitud IS NOT NULL""", ["x", "y"]))
def q_geojson_features(spark, d):
    """Written features read back: geometry and two properties."""
    path = scratch_path(spark, "points")
    io_.write_geojson_lines(io_.geojson_point_features(_flow(spark, d).priority), path)
    f = spark.read.schema("properties struct<departamento: string, ranking_prioridad: int>, "
                          "geometry struct<type: string, coordinates: array<double>>").json(path)
    return r6(f.select("properties.departamento", F.col("geometry.coordinates")[0].alias("x"),
                       F.col("geometry.coordinates")[1].alias("y"), "properties.ranking_prioridad"))


@register("boundary_collection", _boundary_sql())
def q_boundary_collection(spark, d):
    """Boundaries from one FeatureCollection document per region."""
    n = tb.read_table(spark, d, "nation")
    path = scratch_path(spark, "collections")
    docs = _boundary_features(n).groupBy("n_regionkey").agg(F.concat(
        F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("feature"), ","), F.lit("]}")).alias("value"))
    docs.write.partitionBy("n_regionkey").text(path)  # one document per file
    return io_.read_boundaries(spark, path, collection=True)


@register("light_headers", """
SELECT c_custkey AS "código_cliente", c_name AS "nombre__del_cliente", c_nationkey AS "nación-clave",
       c_acctbal AS "saldo_(cop)", c_mktsegment AS segmento_de_mercado FROM customer""")
def q_light_headers(spark, d):
    c = tb.read_table(spark, d, "customer")
    return io_.normalize_headers(c.select(*[F.col(k).alias(v) for k, v in MESSY_HEADERS.items()]), mode="light")


@register("required_scan", "SELECT c_custkey, c_name FROM customer")
def q_required_scan(spark, d):
    return tb.table_if_exists(spark, "sin_catalogo_customer", f"{d}/customer.parquet", required=True).select("c_custkey", "c_name")


@register("resolved_simultaneity", """
SELECT o_orderkey, CAST(CASE WHEN o_totalprice < 1000 THEN 0.9 WHEN lower(split_part(o_orderpriority, '-', 2)) = 'high' THEN 0.5
       WHEN lower(split_part(o_orderpriority, '-', 2)) = 'medium' THEN 0.25 ELSE 0.3 END AS DOUBLE) AS simultaneidad FROM orders""")
def q_resolved_simultaneity(spark, d):
    o = tb.read_table(spark, d, "orders")
    p = FlowParams(scenarios={"high": 0.5, "medium": 0.25})
    name = F.lower(F.get(F.split("o_orderpriority", "-"), F.lit(1)))
    return o.select("o_orderkey", p.simultaneity_of(name, F.when(F.col("o_totalprice") < 1000, 0.9)).alias("simultaneidad"))


@register("resolved_weights", """
SELECT s_suppkey, round(0.7 * s_acctbal + 0.3 * s_nationkey + 0.05 * s_suppkey, 6) AS indice FROM supplier""")
def q_resolved_weights(spark, d):
    s = tb.read_table(spark, d, "supplier")
    p = FlowParams.configured({"weights": {"demanda": "0.7", "otro": 9}})
    index = p.weighted({"demanda": F.col("s_acctbal"), "crecimiento_ev": F.col("s_nationkey"),
                        "cobertura_hidraulica": F.col("s_suppkey")})
    return s.select("s_suppkey", F.round(index, 6).alias("indice"))


@register("waterfall_lookup_limit", "SELECT q.* FROM (" + WATERFALL_SQL + """) q
 JOIN (SELECT c_custkey, c_acctbal < 0 AND row_number() OVER (PARTITION BY c_acctbal < 0 ORDER BY c_custkey) <= 50 AS tried,
              c_acctbal < 0 AS lacking FROM customer) c ON q.c_custkey = c.c_custkey WHERE tried OR NOT lacking""")
def q_waterfall_lookup_limit(spark, d):
    """At most 50 rows are looked up (the feature's own limit); those beyond it are left out here."""
    cg, qs = _lookup_rows(spark, d)
    out = pl.waterfall_lookup(cg, rl.gazetteer(spark, d), "c_custkey", qs, limit=50)
    lacking = tb.read_table(spark, d, "customer").where("c_acctbal < 0").select("c_custkey")
    beyond = lacking.join(lacking.orderBy("c_custkey").limit(50), "c_custkey", "left_anti")
    return out.join(beyond, "c_custkey", "left_anti").select("c_custkey", "latitud", "longitud", "geocoding_query", "geocoding_source")


def _result_roundtrip(spark, d, part, table):
    df = getattr(_flow(spark, d), part)
    return r6(sn.refresh(spark, df, table, scratch_path(spark, table), "territoria_resultados"))


@register("result_scenarios", ORACLE["scenario_fanout"])
def q_result_scenarios(spark, d):
    return _result_roundtrip(spark, d, "scenarios", "demanda_energetica_escenarios")


@register("result_ranking", ORACLE["priority_flow"])
def q_result_ranking(spark, d):
    return _result_roundtrip(spark, d, "priority", "priorizacion_territorial")


@register("result_validation", ORACLE["priority_validation"])
def q_result_validation(spark, d):
    return _result_roundtrip(spark, d, "validation", "validacion_etapa3")


@register("saved_output_tables", """
SELECT unnest(['demanda_energetica', 'demanda_energetica_escenarios', 'etapa1_temporal',
               'etapa1_temporal_predicciones', 'etapa2_energetico', 'etapa3_gis', 'forecast_ev',
               'priorizacion_territorial', 'temporal_model_input', 'validacion_etapa3']) AS tabla""")
def q_saved_output_tables(spark, d):
    """The output stage writes all tables; their names as read back from what was written."""
    from .outputs import save_outputs
    folder = scratch_path(spark, "outputs")
    save_outputs(spark, _flow(spark, d), folder)
    read = None
    for table in io_.RESULT_SCHEMAS:
        one = spark.read.parquet(f"{folder}/{table}").limit(1).select(F.lit(table).alias("tabla"))
        read = one if read is None else read.unionByName(one)
    return read


# ------------------------------------------------------------------ forests --
from ..operators import forest as fr  # noqa: E402
from ..operators.median import exact_medians  # noqa: E402
from . import flow as fl  # noqa: E402


def _forest_backtest(spark, d):
    return fl.backtest(_data(spark, d))


@register("forest_backtest")
def q_forest_backtest(spark, d):
    return _forest_backtest(spark, d).predictions()


@register("model_selection")
def q_model_selection(spark, d):
    tested = _forest_backtest(spark, d)
    return tested.metrics.where(F.col("model") == tested.selected)


@register("feature_importance")
def q_feature_importance(spark, d):
    return _forest_backtest(spark, d).importance()


@register("forecast_with_forests")
def q_forecast_with_forests(spark, d):
    data = _data(spark, d)
    return fl.forecast(data, DEFAULT_HORIZONS, fl.backtest(data).models)


@register("given_model_selection", """
SELECT * FROM (
  SELECT event_type AS model, sqrt(avg(value * value)) AS rmse, count(*) AS n FROM events GROUP BY event_type) q
ORDER BY round(rmse, 6), model LIMIT 1""".replace("SELECT * FROM (", "SELECT model, round(rmse, 6) AS rmse, n FROM ("))
def q_given_model_selection(spark, d):
    ev = tb.read_table(spark, d, "events")
    metrics = ev.groupBy(F.col("event_type").alias("model")).agg(
        F.round(F.sqrt(F.avg(F.col("value") * F.col("value"))), 6).alias("rmse"), F.count(F.lit(1)).alias("n"))
    names = sorted(r[0] for r in metrics.select("model").collect())
    return bt.select_model(metrics, priority={m: i for i, m in enumerate(names)})


def _holdout(spark, d):
    reg = tb.registrations(spark, d)
    rows = reg.select("anio", "departamento", "tipo_vehiculo", "cantidad_ev", "kwh_promedio", "potencia_carga",
                      "l_orderkey", "l_linenumber").dropna(subset=["anio", "departamento", "tipo_vehiculo",
                                                                    "cantidad_ev"])
    split = cut_lineage(bt.positional_holdout(rows, [F.col("anio"), F.col("l_orderkey"), F.col("l_linenumber")]))
    train, test = split.where(F.col("particion") == "train"), split.where(F.col("particion") == "test")
    model = fr.fit_forest(train, fr.FEATURES_A, "cantidad_ev", num_trees=200)
    return cut_lineage(model.predict(test, "cantidad_ev_pred")), reg


@register("holdout_forest")
def q_holdout_forest(spark, d):
    pred, _ = _holdout(spark, d)
    mae = bt.error_metrics(pred, "cantidad_ev", "cantidad_ev_pred").select("mae")
    from ..operators.common import attach_one_row
    return attach_one_row(pred.select("anio", "departamento", "tipo_vehiculo", "cantidad_ev", "cantidad_ev_pred",
                                      "l_orderkey", "l_linenumber"), mae)


@register("holdout_energy")
def q_holdout_energy(spark, d):
    pred, reg = _holdout(spark, d)
    return en.holdout_energy(pred, reg, 0.3)


@register("given_holdout_energy", sql_r6("""
WITH reg AS (SELECT l_orderkey, l_linenumber, l_quantity * 1.25 AS pred, l_extendedprice AS kwh, p_retailprice AS kw
             FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
             JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey),
given AS (SELECT l_orderkey, l_linenumber, pred AS cantidad_ev_pred,
                 CASE WHEN l_linenumber % 3 > 0 THEN kwh ELSE (SELECT median(kwh) FROM reg) END AS kwh_promedio,
                 CASE WHEN l_linenumber % 2 > 0 THEN kw ELSE (SELECT median(kw) FROM reg) END AS potencia_carga,
                 CAST(0.3 AS DOUBLE) AS simultaneidad FROM reg)
SELECT *, cantidad_ev_pred * kwh_promedio AS consumo_energetico,
       cantidad_ev_pred * potencia_carga * simultaneidad AS demanda_futura FROM given""",
    ["cantidad_ev_pred", "kwh_promedio", "potencia_carga", "simultaneidad", "consumo_energetico", "demanda_futura"]))
def q_given_holdout_energy(spark, d):
    """The hold-out flow's energy step on given predictions, with measures missing in places."""
    reg = tb.registrations(spark, d)
    n = F.col("l_linenumber")
    pred = reg.select("l_orderkey", "l_linenumber", (F.col("cantidad_ev") * 1.25).alias("cantidad_ev_pred"),
                      F.when(n % 3 > 0, F.col("kwh_promedio")).alias("kwh_promedio"),
                      F.when(n % 2 > 0, F.col("potencia_carga")).alias("potencia_carga"))
    return r6(en.holdout_energy(pred, reg, 0.3))


@register("column_medians", """
SELECT unnest(['l_discount', 'l_extendedprice', 'l_quantity', 'l_tax']) AS columna,
       unnest([median(l_discount), median(l_extendedprice), median(l_quantity), median(l_tax)]) AS mediana FROM lineitem""")
def q_column_medians(spark, d):
    """All columns' medians together."""
    medians = exact_medians(tb.read_table(spark, d, "lineitem"), ["l_discount", "l_extendedprice", "l_quantity", "l_tax"])
    return spark.createDataFrame(list(medians.items()), "columna string, mediana double")


@register("cleaned_horizons", sql_r6(S.with_(*BASE, S.DATA, S.future((3, 7))) + " SELECT * FROM fan", PANEL_D))
def q_cleaned_horizons(spark, d):
    """Horizons as given (text, repeated, zero, negative) through the parameter rule, applied to every series."""
    return r6(tr.horizon_fanout(_data(spark, d), FlowParams(horizons=("7", 3, 7, 0, -2)).horizons))


@register("initial_year_values", sql_r6(S.with_(*MAPS) + """
 SELECT CAST(anio AS INTEGER) AS anio_inicial, departamento, coalesce(demanda_futura, 0.0) AS valor
 FROM chg WHERE anio = (SELECT max(anio) FROM chg)""", ["valor"]))
def q_initial_year_values(spark, d):
    return r6(md.initial_year_values(_yearly(spark, d), "demanda_futura"))


OVERRIDE_SQL = sql_r6("WITH " + COMPLETED_SQL + f""",
base AS (SELECT doc_id AS id, upper(lang) AS departamento,
                {S.rnd(S.synthetic_lat('doc_id') + ' / 2', 4)} AS latitud,
                {S.rnd(S.synthetic_lon('doc_id') + ' / 2', 4)} AS longitud FROM documents)
 SELECT b.id, b.departamento,
        CASE WHEN h THEN o.municipio ELSE '{pl.NO_MUNICIPALITY}' END AS municipio,
        CASE WHEN h THEN o.latitud ELSE b.latitud END AS latitud,
        CASE WHEN h THEN o.longitud ELSE b.longitud END AS longitud,
        CASE WHEN h THEN o.precision_ubicacion ELSE '{pl.PRECISION_APPROX}' END AS precision_ubicacion,
        CASE WHEN h THEN o.detalle_ubicacion ELSE '{pl.DETAIL_APPROX}' END AS detalle_ubicacion
 FROM (SELECT b.*, o.id AS oid, coalesce(o.municipio IS NOT NULL AND o.latitud IS NOT NULL
                                         AND o.longitud IS NOT NULL, false) AS h
       FROM base b LEFT JOIN completed o ON b.id = o.id) b
 LEFT JOIN completed o ON b.oid = o.id""", ["latitud", "longitud"])


@register("generation_markers", sql_r6("WITH ov AS (" + OVERRIDE_SQL + f""")
 SELECT id, departamento, municipio, latitud, longitud,
        '<b>Infraestructura</b><br>Departamento: ' || coalesce(departamento, 'N/A') || '<br>Municipio: ' ||
        coalesce(municipio, 'NO DISPONIBLE') || '<br>Prioridad energetica: N/A<br>Tipo de ubicacion: ' ||
        coalesce(precision_ubicacion, 'N/A') || '<br>Latitud usada: ' || {S.fixed('latitud', 4)} ||
        '<br>Longitud usada: ' || {S.fixed('longitud', 4)} ||
        '<br><span style=''color:#666;''>La fuente no trae municipio ni coordenada exacta de planta.</span>' AS popup
 FROM ov WHERE latitud IS NOT NULL AND longitud IS NOT NULL""", ["latitud", "longitud"]))
def q_generation_markers(spark, d):
    plants = pl.apply_overrides(rl.plants(spark, d), _completed(spark, d))
    return r6(md.generation_markers(plants))
