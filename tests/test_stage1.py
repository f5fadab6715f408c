import pytest
from pyspark.sql import functions as F

from territoria.operators import backtest as bt
from territoria.operators import panel as pn
from territoria.operators import trend as tr
from territoria.params import FlowParams, ParameterError

SCHEMA = "anio int, departamento string, tipo_vehiculo string, cantidad_ev double"


def test_panel_aggregate_means_and_null_keys(spark):
    df = spark.createDataFrame(
        [(2020, "A", "T", 1.0, 10.0, 1.0, 1.0), (2020, "A", "T", 2.0, None, 3.0, 1.0),
         (2020, None, "T", 5.0, 4.0, 4.0, 4.0)],
        "anio int, departamento string, tipo_vehiculo string, cantidad_ev double, kwh_promedio double, "
        "potencia_carga double, consumo_wh_km double")
    rows = {(r.departamento): r for r in pn.panel_aggregate(df).collect()}
    assert rows["A"].cantidad_ev == 3.0 and rows["A"].kwh_promedio == 10.0 and rows["A"].potencia_carga == 2.0
    assert rows[None].cantidad_ev == 5.0


def test_panel_means_keep_all_decimals(spark):
    df = spark.createDataFrame([(2020, "A", "T", 1.0, 0.125, 38.4567, 0.004)],
                               "anio int, departamento string, tipo_vehiculo string, cantidad_ev double, "
                               "kwh_promedio double, potencia_carga double, consumo_wh_km double")
    r = pn.panel_aggregate(df).first()
    assert (r.kwh_promedio, r.potencia_carga, r.consumo_wh_km) == (0.125, 38.4567, 0.004)


def test_group_trend_cases(spark):
    df = spark.createDataFrame(
        [(2020, "A", "T", 1.0), (2021, "A", "T", 3.0), (2022, "A", "T", 5.0), (2020, "S", "T", 7.0),
         (2020, "F", "T", 5.0), (2021, "F", "T", 1.0), (2019, "H", "T", 1.0), (2021, "H", "T", 4.0)], SCHEMA)
    fit = {r.departamento: r for r in tr.fit_group_trend(df).collect()}
    assert fit["A"].slope == pytest.approx(2.0)
    assert fit["S"].slope == 0.0 and fit["S"].intercept == 7.0
    target = spark.createDataFrame([(2030, "A", "T", 0.0), (2030, "S", "T", 0.0), (2030, "F", "T", 0.0),
                                    (2030, "Z", "T", 0.0)], SCHEMA)
    pred = {r.departamento: r.cantidad_ev_pred_tendencia
            for r in tr.predict_group_trend(target, tr.fit_group_trend(df)).collect()}
    assert pred["A"] == pytest.approx(21.0) and pred["S"] == 7.0 and pred["F"] == 0.0 and pred["Z"] == 0.0
    # exact half: (2019,1),(2021,4) at 2052 -> 50.5 -> 50 (half to even)
    from territoria.functions.numeric import official_round
    h = tr.predict_group_trend(spark.createDataFrame([(2052, "H", "T", 0.0)], SCHEMA), tr.fit_group_trend(df))
    assert h.select(official_round(F.col("cantidad_ev_pred_tendencia"))).first()[0] == 50


def test_cutoff_rules(spark):
    def cut(years):
        df = spark.createDataFrame([(y, "A", "T", 1.0) for y in years], SCHEMA)
        return df.select(bt.cutoff_year(df)).first()[0]
    assert cut([2020, 2021, 2022]) == 2021
    assert cut([2020, 2021]) == 2020
    assert cut([2020]) is None
    with pytest.raises(ValueError):
        bt.check_splittable(spark.createDataFrame([(2020, "A", "T", 1.0)], SCHEMA))


def test_model_selection_ties(spark):
    m = spark.createDataFrame([(bt.MODEL_A, 5.0), (bt.MODEL_B, 5.0), (bt.MODEL_TREND, 5.0)], "model string, rmse double")
    assert bt.select_model(m).first()["model"] == bt.MODEL_A
    m = spark.createDataFrame([(bt.MODEL_A, 5.0), (bt.MODEL_B, 4.0), (bt.MODEL_TREND, 3.9)], "model string, rmse double")
    assert bt.select_model(m).first()["model"] == bt.MODEL_TREND


def test_error_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 4.0)], "y double, p double")
    r = bt.error_metrics(df, "y", "p").first()
    assert r.mae == pytest.approx(2 / 3) and r.rmse == pytest.approx((2 / 3) ** 0.5)
    assert r.r2 == pytest.approx(1 - 2 / 8)


def test_horizon_fanout_uses_global_base_year(spark):
    df = spark.createDataFrame([(2019, "A", "T", 1.0), (2022, "B", "T", 2.0)], SCHEMA)
    rows = tr.horizon_fanout(df, [5]).collect()
    a = [r for r in rows if r.departamento == "A"][0]
    assert a.anio == 2027 and a.anio_base == 2022 and a.cantidad_ev == 1.0


def test_positional_holdout_matches_sort(spark):
    df = spark.createDataFrame([(2000 + i % 7, f"D{i}", "T", float(i)) for i in range(23)], SCHEMA)
    out = bt.positional_holdout(df, [F.col("anio"), F.col("departamento")]).collect()
    order = sorted(out, key=lambda r: (r.anio, r.departamento))
    assert [r.posicion for r in order] == list(range(1, 24))
    assert [r.particion for r in order][-4:] == ["test"] * 4 and order[-5].particion == "train"


def test_params():
    made = FlowParams.configured
    assert made(horizons=[10, "5", -1, 5]).horizons == (5, 10)
    assert made(horizons=[]).horizons == made({"forecast_horizons_anios": [-3]}).horizons == (5, 10, 15, 20, 30)
    assert made(scenario="nope").simultaneity == 0.3 and made(simultaneity=0.7, scenario="nope").simultaneity == 0.7
    assert made({"simultaneidad": {"alto": "0.5"}}, scenario="alto").simultaneity == 0.5
    assert made({"simultaneidad": {"alto": 0.5}, "default_scenario": "alto"}).simultaneity == 0.5
    assert made().scenarios == {"bajo": 0.2, "medio": 0.3, "alto": 0.5}
    weights = made({"weights": {"demanda": 1.0, "otro": 3}}).weights
    assert weights["demanda"] == 1.0 and weights["crecimiento_ev"] == 0.3 and "otro" not in weights
    for bad in ({"weights": {"demanda": "x"}}, {"simultaneidad": {"alto": None}}, {"forecast_horizons_anios": ["y"]}):
        with pytest.raises(ParameterError):
            made(bad)


def test_simultaneity_per_row(spark):
    df = spark.createDataFrame([("alto", None), ("nope", None), (None, None), ("bajo", 0.9)], "s string, f double")
    got = [r[0] for r in df.select(FlowParams().simultaneity_of(F.col("s"), F.col("f"))).collect()]
    assert got == [0.5, 0.3, 0.3, 0.9]
