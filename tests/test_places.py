import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from territoria.operators import places as pl
from territoria.operators.ordinal import ordinal_within_key
from territoria.sources import io as io_


def test_override_requires_all_three(spark):
    base = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 2.0), (3, 3.0, 3.0)], "id long, latitud double, longitud double")
    ovr = spark.createDataFrame([(1, "X", 9.0, 9.0), (2, "Y", 8.0, None)],
                                "id long, municipio string, latitud double, longitud double")
    done = pl.complete_overrides(ovr, None)
    out = {r.id: r for r in pl.apply_overrides(base, done).collect()}
    assert out[1].municipio == "X" and out[1].latitud == 9.0 and out[1].precision_ubicacion == pl.PRECISION_OVERRIDE
    assert out[2].municipio == pl.NO_MUNICIPALITY and out[2].latitud == 2.0
    assert out[3].precision_ubicacion == pl.PRECISION_APPROX


def test_catalogue_completion_on_folded_names(spark):
    ovr = spark.createDataFrame([("1", " Medellín ", None, None), ("x", "A", 1.0, 1.0), ("3", "  ", 1.0, 1.0),
                                 ("4", "CALI", 5.0, None)], "id string, municipio string, latitud double, longitud double")
    cat = spark.createDataFrame([("MEDELLIN", 6.2, -75.5), ("cali", 3.4, -76.5)], "municipio string, latitud double, longitud double")
    out = {r.id: r for r in pl.complete_overrides(ovr, cat).collect()}
    assert set(out) == {1, 4}
    assert (out[1].municipio, out[1].latitud, out[1].longitud) == ("Medellín", 6.2, -75.5)
    assert (out[4].latitud, out[4].longitud) == (5.0, -76.5)


def test_nearest_lookup_exact_tie_unknown(spark):
    ref = spark.createDataFrame([(0.0, 0.0, "A", 1), (2.0, 0.0, "B", 2), (5.0, 5.0, "C", 3), (5.0, 5.0, "D", 4)],
                                "x double, y double, v string, o long")
    q = spark.createDataFrame([(1, 5.00001, 5.0), (2, 1.0, 0.0), (3, None, 1.0), (4, 1.9, 0.1)],
                              "id long, x double, y double")
    out = {r.id: (r.valor, r.metodo) for r in pl.nearest_lookup(q, ref, "id", "x", "y", "x", "y", "v", "o").collect()}
    assert out[1] == ("D", "exacta")       # duplicate reference point: last value wins
    assert out[2] == ("A", "cercana")      # equal distance: first position wins
    assert out[3] == ("UNKNOWN", "sin_coordenadas")
    assert out[4] == ("B", "cercana")


def test_nearest_lookup_matches_brute_force(spark):
    rnd = random.Random(7)
    refs = [(rnd.uniform(0, 10), rnd.uniform(0, 10), str(i), i) for i in range(300)]
    refs += [(5.0 + rnd.uniform(0, 0.01), 5.0 + rnd.uniform(0, 0.01), f"h{i}", 1000 + i) for i in range(300)]
    qs = [(i, rnd.uniform(-2, 12), rnd.uniform(-2, 12)) for i in range(200)]
    ref = spark.createDataFrame(refs, "x double, y double, v string, o long")
    q = spark.createDataFrame(qs, "id long, x double, y double")
    got = {r.id: r.valor for r in pl.nearest_lookup(q, ref, "id", "x", "y", "x", "y", "v", "o", bucket_size=8).collect()}
    table = {}
    for x, y, v, o in refs:
        k = (round(x, 4), round(y, 4))
        table[k] = (v, table.get(k, (None, o))[1]) if k in table else (v, o)
    for i, x, y in qs:
        best = min(table.items(), key=lambda kv: ((x - kv[0][0]) ** 2 + (y - kv[0][1]) ** 2, kv[1][1]))
        exact = table.get((round(x, 4), round(y, 4)))
        assert got[i] == (exact[0] if exact else best[1][0])


def test_positional_assignment(spark):
    dem = spark.createDataFrame([(1, "K"), (2, "K"), (3, "K"), (4, "Z")], "d_id long, k string")
    cand = spark.createDataFrame([(10, "K"), (11, "K")], "c_id long, k string")
    out = {r.d_id: r for r in pl.positional_assignment(dem, cand, ["k"], [F.col("d_id")], [F.col("c_id")]).collect()}
    assert out[1].c_id == 10 and out[2].c_id == 11 and out[3].c_id is None and not out[4].asignado
    s = pl.assignment_summary(pl.positional_assignment(dem, cand, ["k"], [F.col("d_id")], [F.col("c_id")])).first()
    assert (s.total, s.asignados, s.sin_asignar) == (4, 2, 2)


def test_ordinal_hot_key_equals_row_number(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v long")
    got = ordinal_within_key(df, ["k"], [F.col("v")], num_partitions=16)
    ref = df.withColumn("rn2", F.row_number().over(Window.partitionBy("k").orderBy("v")))
    assert got.join(ref, ["k", "v"]).where(F.col("rn") != F.col("rn2")).count() == 0
    assert got.count() == 3000


def test_waterfall_lookup(spark):
    rows = spark.createDataFrame([(1, "P", "M", "R", None, None), (2, "Q", "M2", "R", None, None),
                                  (3, "S", "M", "R", 1.0, 2.0)],
                                 "rid long, nombre string, municipio string, departamento string, "
                                 "latitud double, longitud double")
    gaz = spark.createDataFrame([("M, R, Colombia", 4.0, 5.0, "hit-m"), ("P, M, R, Colombia", None, None, None),
                                 ("R, Colombia", 7.0, 8.0, "hit-r")],
                                "query string, latitud double, longitud double, display_name string")
    qs = pl.lookup_queries(F.col("nombre"), F.col("municipio"), F.col("departamento"), F.lit(None))
    out = {r.rid: r for r in pl.waterfall_lookup(rows, gaz, "rid", qs).collect()}
    assert (out[1].latitud, out[1].geocoding_query) == (4.0, "M, R, Colombia")
    assert (out[2].latitud, out[2].geocoding_source) == (7.0, "hit-r")
    assert out[3].latitud == 1.0 and out[3].geocoding_query is None
    dry = {r.rid: r for r in pl.waterfall_lookup(rows, gaz, "rid", qs, limit=1, dry_run=True).collect()}
    assert dry[1].geocoding_source == "dry_run" and dry[2].geocoding_query is None


def test_geojson_skips_missing_coordinates(spark):
    df = spark.createDataFrame([("A", 1.0, 2.0), ("B", None, 2.0)], "departamento string, latitud double, longitud double")
    feats = io_.geojson_point_features(df).collect()
    assert len(feats) == 1 and '"coordinates":[2.0,1.0]' in feats[0].feature


def test_headers_and_columns(spark):
    df = spark.createDataFrame([(1, 2)], "` Año Registro ` int, `Valor (COP)` int")
    assert io_.normalize_headers(df).columns == ["ano_registro", "valor_cop"]
    try:
        io_.normalize_headers(spark.createDataFrame([(1, 2)], "`a b` int, `a_b` int"))
        raise AssertionError("collision not detected")
    except ValueError:
        pass
    out = io_.alias_and_require(df.toDF("a", "b"), {"a": "alias_a"}, {"req": "double"})
    assert out.columns == ["a", "b", "alias_a", "req"]
    assert io_.order_columns(out, ["req", "a", "req", "zz"]).columns == ["req", "a", "b", "alias_a"]
    assert io_.order_columns(out, ["req"], keep_rest=False).columns == ["req"]


def test_refresh_catalog_table_overwrites(spark, tmp_path):
    df = spark.createDataFrame([(2020, "A", "T", 1.0, 2.0, 3.0, 4.0)],
                               "anio int, departamento string, tipo_vehiculo string, cantidad_ev double, "
                               "kwh_promedio double, potencia_carga double, consumo_wh_km double")
    loc = str(tmp_path / "t")
    assert io_.refresh_catalog_table(spark, df, "etapa1_temporal", loc, "prueba_resultados").count() == 1
    assert io_.refresh_catalog_table(spark, df.union(df), "etapa1_temporal", loc, "prueba_resultados").count() == 2
    try:
        io_.conform(df, "tabla_desconocida")
        raise AssertionError("unknown table accepted")
    except ValueError:
        pass


def test_nearest_lookup_nan_is_unknown(spark):
    ref = spark.createDataFrame([(0.0, 0.0, "A", 1), (float("nan"), 0.0, "N", 2)], "x double, y double, v string, o long")
    q = spark.createDataFrame([(1, float("nan"), 0.0), (2, 1.0, 1.0)], "id long, x double, y double")
    out = {r.id: r.valor for r in pl.nearest_lookup(q, ref, "id", "x", "y", "x", "y", "v", "o").collect()}
    assert out == {1: "UNKNOWN", 2: "A"}


def test_nearest_candidates_of_outliers_are_few(spark):
    rnd = random.Random(5)
    refs = [(rnd.uniform(0, 1), rnd.uniform(0, 1), str(i), i) for i in range(4000)]
    ref = pl._ref_table(spark.createDataFrame(refs, "x double, y double, v string, o long"), "x", "y", "v", "o", 4)
    q = spark.createDataFrame([(i, rnd.uniform(50, 90), rnd.uniform(-90, -50)) for i in range(200)],
                              "_qid long, _qx double, _qy double")
    pairs = pl.nearest_candidates(q, ref)
    assert pairs.select("_qid").distinct().count() == 200
    assert pairs.count() <= 200 * 64 * 9  # not 200 * 4000


def test_waterfall_hit_replaces_both_coordinates(spark):
    rows = spark.createDataFrame([(1, "p", 9.0, None), (2, "q", 9.0, None), (3, "p", 1.0, 2.0)],
                                 "id long, k string, latitud double, longitud double")
    gaz = spark.createDataFrame([("p", 4.0, 5.0, "P")], "query string, latitud double, longitud double, display_name string")
    out = {r.id: (r.latitud, r.longitud) for r in pl.waterfall_lookup(rows, gaz, "id", F.array("k")).collect()}
    assert out == {1: (4.0, 5.0), 2: (9.0, None), 3: (1.0, 2.0)}


def test_cache_upsert_first_row_wins(spark):
    cache = spark.createDataFrame([("a", 1.0)], "query string, latitud double")
    new = spark.createDataFrame([("a", 9.0), ("b", 3.0), ("b", 2.0)], "query string, latitud double")
    assert sorted(map(tuple, pl.cache_upsert(cache, new).collect())) == [("a", 1.0), ("b", 2.0)]


def test_scan_refuses_bad_cells(spark, tmp_path):
    import pytest
    (tmp_path / "t.csv").write_text("a,b\n1,2\nx,3\n")
    with pytest.raises(Exception):
        io_.scan_csv(spark, str(tmp_path / "t.csv"), "a int, b int").collect()


def test_unreadable_table_is_an_error_and_a_missing_one_is_none(spark, tmp_path):
    import pytest
    from territoria.sources.tables import table_if_exists
    assert table_if_exists(spark, "no_such_table", str(tmp_path / "none.parquet")) is None
    (tmp_path / "bad.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        table_if_exists(spark, "no_such_table", str(tmp_path / "bad.parquet")).collect()
