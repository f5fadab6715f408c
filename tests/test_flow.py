"""The composite flow with its forests, the output stage and helpers."""

import json
import random

import pytest
from pyspark.sql import functions as F

from territoria.operators import forest as fr
from territoria.operators import trend as tr
from territoria.operators.median import exact_median, most_frequent
from territoria.operators.ordinal import ordinal_within_key
from territoria.plans import catalog
from territoria.plans import flow as fl
from territoria.plans.outputs import save_outputs

REG = ("anio int, departamento string, tipo_vehiculo string, cantidad_ev double, kwh_promedio double, "
       "potencia_carga double, consumo_wh_km double")
ASSETS = ("nombre_activo string, departamento string, capacidad_hidraulica double, latitud double, longitud double")


@pytest.fixture(scope="module")
def registrations(spark):
    rnd = random.Random(3)
    rows = [(2018 + y, d, t, float(5 * y + i + rnd.randint(0, 3)), 40.0 + i, 7.0 + i, 150.0)
            for y in range(5) for i, d in enumerate("ABC") for t in ("CAR", "BUS")]
    return spark.createDataFrame(rows, REG)


@pytest.fixture(scope="module")
def result(spark, registrations):
    assets = spark.createDataFrame([("x", "A", 10.0, 4.0, -74.0)], ASSETS)
    return fl.run_flow(registrations, assets, num_trees=5)


def test_flow_with_forests(result):
    future = result.forecast.collect()
    assert future and all(r.cantidad_ev_pred_modelo_a >= 0 and r.cantidad_ev_pred_modelo_b >= 0 for r in future)
    assert {r.modelo_seleccionado for r in future} == {tr.TREND_METHOD}
    chosen = result.backtest.selected
    best = min((r.rmse, list(fl.PREDICTION_OF).index(r.model)) for r in result.backtest.metrics.collect())
    assert list(fl.PREDICTION_OF)[best[1]] == chosen
    for r in result.predictions.collect():
        assert r.modelo_seleccionado == chosen and r.cantidad_ev_pred == r[fl.PREDICTION_OF[chosen]]
    overlay = result.energy.where("anio = 2022 and horizonte_anios is null").join(
        result.predictions.select("departamento", "tipo_vehiculo", F.col("cantidad_ev_pred").alias("p")),
        ["departamento", "tipo_vehiculo"])
    assert overlay.count() == 6 and overlay.where("abs(cantidad_ev_modelada - p) > 1e-9").count() == 0


def test_uncovered_departments_stay(result):
    rows = {r.departamento: r for r in result.priority.collect()}
    assert set(rows) == {"A", "B", "C"}
    assert rows["B"].total_activos_hidraulicos == 0 and rows["B"].latitud is None and rows["A"].latitud == 4.0


def test_one_year_is_an_error(spark, registrations):
    assets = spark.createDataFrame([], ASSETS)
    for forests in (True, False):
        with pytest.raises(ValueError):
            fl.run_flow(registrations.where("anio = 2018"), assets, with_forests=forests)


def test_outputs(spark, result, tmp_path):
    done = save_outputs(spark, result, str(tmp_path))
    assert len(done) == 14 and spark.read.parquet(f"{tmp_path}/priorizacion_territorial").count() == 3
    assert spark.read.option("header", True).csv(f"{tmp_path}/temporal_model_input.csv").count() == result.panel.count()
    summary = spark.read.json(f"{tmp_path}/etapa1_baseline_metrics.json").first()
    assert summary.selected_model == result.backtest.selected and summary.test_years == [2022]
    assert summary.forecast_years == [2027, 2032, 2037, 2042, 2052] and summary.train_rows == 24
    compared = spark.read.json(f"{tmp_path}/etapa1_model_comparison.json").first().asDict(recursive=True)
    assert compared["proyeccion_tendencial_grupo"]["rmse"] is not None
    point = json.loads(spark.read.text(f"{tmp_path}/priorizacion_territorial.geojson").first()[0])
    assert point["geometry"]["coordinates"] == [-74.0, 4.0]


def test_forest_of_grouped_rows_is_as_good(spark):
    rnd = random.Random(1)
    rows = [(2010 + rnd.randint(0, 9), rnd.choice("ABCD"), "T", 0.0) for _ in range(1500)]
    rows = [(y, d, t, (y - 2010) * (ord(d) - 60) + rnd.gauss(0, 4)) for y, d, t, _ in rows]
    df = spark.createDataFrame(rows, "anio int, departamento string, tipo_vehiculo string, cantidad_ev double")
    train, test = df.where("anio < 2018"), df.where("anio >= 2018")
    errors = []
    for instances in (32, None):
        model = fr.fit_forest(train, fr.FEATURES_A, "cantidad_ev", num_trees=20, max_depth=10, instances=instances)
        errors.append(model.predict(test, "p").agg(F.sqrt(F.avg((F.col("p") - F.col("cantidad_ev")) ** 2))).first()[0])
    assert abs(errors[0] - errors[1]) < 0.1 * errors[1]


def test_trees_are_walked_once_per_feature_vector(spark):
    kind = "anio int, departamento string, tipo_vehiculo string, cantidad_ev double"
    rows = [(2010 + i % 3, "AB"[i % 2], "T", float(i % 7)) for i in range(60)]
    model = fr.fit_forest(spark.createDataFrame(rows, kind), fr.FEATURES_A, "cantidad_ev", num_trees=5, max_depth=5)
    asked = [(2011, "A", "T", 1.0)] * 40 + [(2012, "new", None, None)] * 3 + [(None, None, "T", 2.0)] * 2
    df = spark.createDataFrame(asked, kind).withColumn("row", F.monotonically_increasing_id())
    row_by_row = {r.row: r._prediction for r in model.pipeline.transform(model._prep(df)).collect()}

    class Walked:
        stages, rows = model.pipeline.stages, []

        def transform(self, vectors):
            self.rows.append(vectors.count())
            return model.pipeline.transform(vectors)

    walked = Walked()
    counting = fr.ForestModel(walked, model.fills, model.numeric, model.categorical)
    out = counting.predict(df, "p")
    assert out.columns == [*df.columns, "p"]
    assert {r.row: r.p for r in out.collect()} == row_by_row and out.count() == 45
    assert walked.rows == [2]  # filled in, the last is the first
    assert sorted(map(str, out.drop("p").collect())) == sorted(map(str, df.collect()))


def test_fit_reads_its_records_a_few_times_only(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(v):
        read.add(1)
        return v

    rows = [(2010 + i % 3, "AB"[i % 2], "T", float(i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "anio int, departamento string, tipo_vehiculo string, cantidad_ev double")
    watched = df.withColumn("departamento", F.udf(seen, "string")("departamento"))
    fr.fit_forest(watched, fr.FEATURES_A, "cantidad_ev", num_trees=5, max_depth=5)
    # most frequent values and reduced rows; the indexers and the forest read the latter
    assert 0 < read.value <= 2 * len(rows)


def test_run_summary_builds_its_panel_once(spark, monkeypatch):
    built = []

    def panel(spark_, d):
        built.append(d)
        return spark.createDataFrame([(2018 + y, x, "CAR", k * y + 1.0, 40.0, 7.0, 150.0)
                                      for y in range(4) for k, x in enumerate("AB", 1)], REG)

    monkeypatch.setattr(catalog, "_panel", panel)
    row = catalog.QUERIES["backtest_run_summary"](spark, "given").first()
    assert built == ["given"]
    assert (row.train_rows, row.test_rows, row.cutoff_year, row.base_year, row.test_years) == (6, 2, 2020, 2021, [2021])
    assert row.forecast_years == [2026, 2031, 2036, 2041, 2051] and row.selected_model == "proyeccion_tendencial_grupo"
    assert (row.mae, row.rmse, row.r2) == (0.0, 0.0, 1.0)


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0, 1.0, 1.0, 9.0, None, float("nan")], [2.0] * 50 + [1.0, 7.0]])
def test_exact_median(spark, values):
    clean = sorted(v for v in values if v is not None and v == v)
    n = len(clean)
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert exact_median(df, "v") == (clean[(n - 1) // 2] + clean[n // 2]) / 2
    assert exact_median(df.limit(0), "v") is None


def test_most_frequent(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), (None,), (None,)], "v string")
    assert most_frequent(df, "v") == "a" and most_frequent(df.limit(0), "v") is None


def test_numbering_takes_one_range_exchange(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 3)
    out = ordinal_within_key(df, ["k"], [F.col("id")])
    rows = out.collect()
    for k in range(3):
        own = sorted((r.id, r.rn) for r in rows if r.k == k)
        assert [rn for _, rn in own] == list(range(1, len(own) + 1))
    assert "rangepartitioning" not in out._jdf.queryExecution().executedPlan().toString()


def test_sparse_trend_reads_its_input_once(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(2020, "A", "T", 1.0), (None, "B", "T", 2.0)],
                          "anio int, departamento string, tipo_vehiculo string, cantidad_ev double").write.parquet(path)
    fit = tr.fit_group_trend(spark.read.parquet(path))
    assert fit._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    rows = {r.departamento: r for r in fit.collect()}
    assert (rows["B"].slope, rows["B"].intercept, rows["B"].n_years) == (0.0, 0.0, 0)
    assert (rows["A"].slope, rows["A"].intercept) == (0.0, 1.0)
