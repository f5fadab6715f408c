import pytest
from pyspark.sql import functions as F

from territoria.operators import change as ch
from territoria.operators import energy as en
from territoria.operators import priority as pr
from territoria.operators.ordinal import dense_rank_desc

PANEL = ("anio int, departamento string, tipo_vehiculo string, cantidad_ev double, kwh_promedio double, "
         "potencia_carga double, consumo_wh_km double")


def test_overlay_labels_and_row_count(spark):
    panel = spark.createDataFrame([(2022, "A", "T", 10.0, 1.0, 2.0, 3.0), (2022, "B", "T", 4.0, 1.0, 2.0, 3.0)], PANEL)
    preds = spark.createDataFrame([(2022, "A", "T", 12.0), (2022, "A", "T", 12.0)],
                                  "anio int, departamento string, tipo_vehiculo string, cantidad_ev_pred double")
    out = {r.departamento: r for r in en.forecast_overlay(panel, preds).collect()}
    assert len(out) == 2
    assert out["A"].fuente_cantidad_ev == "forecast_baseline" and out["A"].cantidad_ev_modelada == 12.0
    assert out["B"].fuente_cantidad_ev == "historico" and out["B"].cantidad_ev_modelada == 4.0


def test_scenario_fanout_rows(spark):
    panel = spark.createDataFrame([(2022, "A", "T", 10.0, 1.0, 2.0, 3.0), (2022, "B", "T", 4.0, None, None, 3.0)], PANEL)
    energy = en.build_energy_table(panel, None, None, 0.3)
    fan = en.scenario_fanout(energy, {"bajo": 0.2, "medio": 0.3, "alto": 0.5})
    assert fan.count() == 6
    r = fan.where((F.col("departamento") == "A") & (F.col("escenario_simultaneidad") == "alto")).first()
    assert r.demanda_futura == pytest.approx(10.0 * 2.0 * 0.5)
    assert energy.where(F.col("departamento") == "B").first().demanda_futura == 0.0


def test_min_max_scale_cases(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0)], "k int, v double")
    assert [r.s for r in pr.min_max_scale(df, "v", "s").collect()] == [0.0, 0.0]
    df = spark.createDataFrame([(1, None), (2, 2.0), (3, 4.0)], "k int, v double")
    got = sorted((r.k, r.s) for r in pr.min_max_scale(df, "v", "s").collect())
    assert got == [(1, 0.0), (2, 0.5), (3, 1.0)]
    one = spark.createDataFrame([(1, 3.0)], "k int, v double")
    assert pr.min_max_scale(one, "v", "s").first().s == 0.0


def test_demand_asset_join_nulls(spark):
    snap = spark.createDataFrame([("A", 1.0), (None, 2.0), ("C", 3.0)], "departamento string, demanda_futura double")
    cov = spark.createDataFrame([("A", 2.0, 10.0, 4.5, -74.0), (None, 1.0, 1.0, 1.0, 1.0)],
                                "departamento string, total_activos_hidraulicos double, "
                                "capacidad_hidraulica_total double, latitud_hidraulica_promedio double, "
                                "longitud_hidraulica_promedio double")
    out = {r.departamento: r for r in pr.demand_asset_join(snap, cov).collect()}
    assert out["C"].total_activos_hidraulicos == 0.0 and out["C"].latitud is None
    assert out["C"].latitud_hidraulica_promedio == 0.0
    assert out[None].total_activos_hidraulicos == 1.0 and out["A"].latitud == 4.5


def test_dense_rank_ties(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.2)], "d string, idx double")
    got = {r.d: r.rk for r in dense_rank_desc(df, "idx", "rk").collect()}
    assert got == {"a": 1, "b": 1, "c": 2}


def test_category_observation_consistency(spark):
    df = spark.createDataFrame([(0.66, 0.7, 0.7, 0.7, 0.1), (0.33, 0.05, 0.05, 0.0, 0.0), (0.3299, 0.2, 0.5, 0.0, 0.0),
                                (0.4, 0.05, 0.05, 0.0, 0.0)],
                               "indice_prioridad_territorial double, criterio_demanda double, "
                               "criterio_crecimiento_ev double, criterio_brecha_soporte_hidraulico double, "
                               "criterio_brecha_cobertura_hidraulica double")
    cats = [r[0] for r in df.select(pr.priority_category(F.col("indice_prioridad_territorial"))).collect()]
    assert cats == ["ALTA", "MEDIA", "BAJA", "MEDIA"]
    both = spark.createDataFrame([(0.7, 0.9, 0.7, 0.7)], "criterio_demanda double, criterio_crecimiento_ev double, "
                                 "criterio_brecha_soporte_hidraulico double, criterio_brecha_cobertura_hidraulica double")
    assert both.select(pr.priority_observation()).first()[0] == pr.OBS_COVERAGE_GAP
    gis = df.withColumn("capacidad_hidraulica_total", F.lit(0.0)).withColumn("total_activos_hidraulicos", F.lit(1.0))
    for c in pr.VALIDATION_COLUMNS:
        if c not in gis.columns and not c.startswith("peso") and c not in (
                "sin_soporte_hidraulico", "sin_cobertura_hidraulica", "consistencia_territorial_ok"):
            gis = gis.withColumn(c, F.lit(None).cast("string"))
    val = pr.build_validation_table(gis).collect()
    assert [r.consistencia_territorial_ok for r in val] == [True, True, True, False]
    assert val[0].sin_soporte_hidraulico and not val[0].sin_cobertura_hidraulica


def test_period_change(spark):
    df = spark.createDataFrame([("A", 2022, 10.0), ("A", 2027, 15.0), ("B", 2022, 0.0), ("B", 2027, 3.0),
                                (None, 2022, 1.0), (None, 2027, 5.0)], "k string, t int, v double")
    out = {(r.k, r.t): r for r in ch.period_change(df, "k", "t", "v", "d", "p").collect()}
    assert out[("A", 2027)].d == 5.0 and out[("A", 2027)].p == 0.5 and out[("A", 2022)].d == 0.0
    assert out[("B", 2027)].p == 0.0
    assert out[(None, 2027)].d == 0.0 and out[(None, 2027)].p == 0.0
