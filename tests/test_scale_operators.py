"""Operators for hot keys, many columns, large files and refreshed tables."""

import json
import math
import os
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from territoria.functions.numeric import exact_avg, exact_sum
from territoria.operators import energy as en
from territoria.operators.hot_keys import hot_key_join, hot_keys
from territoria.operators.lookup_cache import LookupCache
from territoria.operators.median import exact_medians, most_frequents
from territoria.operators.ordinal import previous_in_key
from territoria.operators.panel import panel_aggregate
from territoria.plans.flow import run_flow
from territoria.plans.store import StageStore
from territoria.sources import io as io_
from territoria.sources import offset_scan
from territoria.sources import snapshots as sn
from territoria.sources.files import children, exists


@pytest.fixture
def fixed_width(spark):
    """Eight shuffle partitions that stay as they are."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


# ------------------------------------------------------------ header offset --
def test_offset_scan_keeps_splits(spark, tmp_path):
    rows = [(i, f"n {i}, \"q\"", None if i % 7 == 0 else i / 4) for i in range(20_000)]
    df = spark.createDataFrame(rows, "k int, name string, v double").repartition(3)
    above = ["Report", "", "a;b", "1,2,3", "last"]
    offset_scan.write_with_offset(df, str(tmp_path / "t"), above)
    files = [f for f in os.listdir(tmp_path / "t") if f.endswith(".txt")]
    assert len(files) == 3 and all(open(tmp_path / "t" / f).read().startswith("Report\n\na;b\n1,2,3\nlast\nk,name,v\n") for f in files)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        out = offset_scan.scan_with_offset(spark, str(tmp_path / "t"), df.schema, skip=5)
        assert out.rdd.getNumPartitions() > 3  # a file is read by several tasks
        assert sorted(map(tuple, out.collect())) == sorted(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_offset_scan_faults(spark, tmp_path):
    (tmp_path / "short").write_text("one\ntwo\n")
    with pytest.raises(Exception, match="lines to skip"):
        offset_scan.scan_with_offset(spark, str(tmp_path / "short"), "a int", skip=5).collect()
    (tmp_path / "bad").write_text("x\na\n1\nno number\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        offset_scan.scan_with_offset(spark, str(tmp_path / "bad"), "a int", skip=1).collect()
    (tmp_path / "only_header").write_text("x\na\n")
    assert offset_scan.scan_with_offset(spark, str(tmp_path / "only_header"), "a int", skip=1).count() == 0


# ------------------------------------------------------------- collections ---
def feature(i, points=3, **more):
    return {"type": "Feature", "properties": {"shapeName": f"Depto \"{i}\" {{}}", **more},
            "geometry": {"type": "Polygon", "coordinates": [[[j, i] for j in range(points)]]}}


def test_one_large_collection_is_read_by_many_tasks(spark, tmp_path):
    path = str(tmp_path / "all.geojson")
    with open(path, "w") as f:
        json.dump({"type": "FeatureCollection", "name": "x", "features": [feature(i, 200) for i in range(300)], "crs": {"a": [1]}}, f)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        out = io_.read_boundaries(spark, path, collection=True)
        assert out.rdd.getNumPartitions() > 1
        rows = out.select("shapeName", "geometry", F.spark_partition_id().alias("part")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len({r.part for r in rows}) > 1
    assert {(r.shapeName, len(json.loads(r.geometry)["coordinates"][0])) for r in rows} == {(f"Depto \"{i}\" {{}}", 200) for i in range(300)}


@pytest.mark.parametrize("indent", [None, 2])
def test_collection_layouts(spark, tmp_path, indent):
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature(1), feature(2)]}, indent=indent) + "\n")
    (tmp_path / "b.json").write_text(json.dumps({"features": [feature(3)], "type": "FeatureCollection"}, indent=indent))
    (tmp_path / "c.json").write_text(json.dumps({"type": "FeatureCollection", "features": []}, indent=indent))
    got = sorted(r.shapeName for r in io_.read_boundaries(spark, str(tmp_path), collection=True).collect())
    assert got == [f"Depto \"{i}\" {{}}" for i in (1, 2, 3)]


def test_collection_faults(spark, tmp_path):
    late = {"id": 1, **feature(1)}
    (tmp_path / "late.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature(0), late]}))
    with pytest.raises(Exception, match="first member"):
        io_.read_boundaries(spark, str(tmp_path / "late.json"), collection=True).collect()
    (tmp_path / "inside.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature(0, kind="Feature")]}))
    with pytest.raises(Exception):
        io_.read_boundaries(spark, str(tmp_path / "inside.json"), collection=True).collect()


# ------------------------------------------------------------ refreshed tables --
PANEL = ("anio int, departamento string, tipo_vehiculo string, cantidad_ev double, kwh_promedio double, "
         "potencia_carga double, consumo_wh_km double")


def test_refresh_switches_folders(spark, tmp_path):
    one = spark.createDataFrame([(2020, "A", "T", 1.0, 1.0, 1.0, 1.0)], PANEL)
    base = str(tmp_path / "etapa1_temporal")
    for n in (1, 2, 3):
        df = one if n == 1 else one.withColumn("anio", F.explode(F.sequence(F.lit(1), F.lit(n))))
        assert sn.refresh(spark, df, "etapa1_temporal", base, "prueba_cambio").count() == n
        assert len([p for p in children(spark, base) if sn.SNAPSHOT in p]) == min(n, 2)  # one earlier snapshot stays
    moved = str(tmp_path / "otra" / "etapa1_temporal")
    assert sn.refresh(spark, one, "etapa1_temporal", moved, "prueba_cambio").count() == 1
    assert moved in sn.location_of(spark, "prueba_cambio.etapa1_temporal")


def test_a_dying_write_leaves_the_old_rows(spark, tmp_path):
    base = str(tmp_path / "etapa1_temporal")
    good = spark.createDataFrame([(2020, "A", "T", 1.0, 1.0, 1.0, 1.0)], PANEL)
    sn.refresh(spark, good, "etapa1_temporal", base, "prueba_fallo")
    bad = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") == 999, F.raise_error(F.lit("dies"))).otherwise(2020).cast("int").alias("anio"),
                                            *[F.lit(None).cast("string").alias(c) for c in ("departamento", "tipo_vehiculo")],
                                            *[F.col("id").cast("double").alias(c) for c in good.columns[3:]])
    with pytest.raises(Exception, match="dies"):
        sn.refresh(spark, bad, "etapa1_temporal", base, "prueba_fallo")
    assert [r.departamento for r in spark.table("prueba_fallo.etapa1_temporal").collect()] == ["A"]
    assert sn.refresh(spark, good.union(good), "etapa1_temporal", base, "prueba_fallo").count() == 2


# -------------------------------------------------------------------- hot keys --
def test_hot_key_is_dealt_out(spark, fixed_width):
    rows = spark.range(0, 100_000, 1, 8).select(
        F.when(F.col("id") < 90_000, F.lit(7)).when(F.col("id") < 91_000, F.lit(None)).otherwise(F.col("id")).cast("long").alias("k"), "id")
    small = spark.createDataFrame([(7, "hot"), (95_000, "x"), (-1, "never")], "k2 long, name string")
    assert hot_keys(rows, "k", 1000) == {7: 90}
    out = hot_key_join(rows, small, "k", "k2", "left", rows_per_part=1000)
    assert out.columns == ["k", "id", "k2", "name"]
    sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 100_000 and max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]
    assert out.where("name = 'hot'").count() == 90_000 and out.where("name = 'x'").count() == 1
    plain = rows.join(small, rows.k == small.k2, "left")
    assert out.exceptAll(plain).isEmpty() and plain.exceptAll(out).isEmpty()
    inner = hot_key_join(rows, small, "k", "k2", "inner", rows_per_part=1000)
    assert inner.count() == 90_001
    # without a hot key the join is the plain one
    assert "_hk" not in hot_key_join(rows.where("k != 7"), small, "k", "k2", rows_per_part=1000)._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        hot_key_join(rows, small, "k", "k2", "full")


# --------------------------------------------------------------------- medians --
def test_medians_of_many_columns(spark):
    r = random.Random(5)
    n = 3001
    data = [tuple([r.gauss(0, 1), r.choice([1.0, 2.0]), r.random() * 10 ** r.randint(-200, 200), float(i % 2) if i % 3 else None,
                   math.inf if i % 2 else -math.inf, None]) for i in range(n)]
    names = ["a", "b", "c", "d", "e", "f"]
    df = spark.createDataFrame(data, ", ".join(f"{c} double" for c in names))
    want = {}
    for i, c in enumerate(names):
        v = sorted(x[i] for x in data if x[i] is not None)
        want[c] = (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2 if v else None
    assert exact_medians(df, names) == want
    assert exact_medians(df, names, ranges=4, read=6) == want  # many rounds
    assert exact_medians(df.limit(0), names) == dict.fromkeys(names)


def test_jobs_do_not_grow_with_the_columns(spark):
    df = spark.range(20_000).select(*[(F.hash("id", F.lit(i)) % 10_007).cast("double").alias(f"c{i}") for i in range(8)])
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for n in (1, 8):
        spark.sparkContext.setJobGroup(f"medians{n}", "")
        exact_medians(df, [f"c{i}" for i in range(n)])
        jobs.append(len(tracker.getJobIdsForGroup(f"medians{n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def test_most_frequent_of_many_columns(spark):
    df = spark.createDataFrame([("b", None), ("a", "x"), ("b", None), ("a", "y")], "p string, q string")
    assert most_frequents(df, ["p", "q"]) == {"p": "a", "q": "x"}
    assert most_frequents(df.limit(0), ["p"]) == {"p": None}


# -------------------------------------------------------------- previous value --
def test_previous_value_equals_lag(spark):
    df = spark.range(0, 30_000, 1, 6).select(
        F.when(F.col("id") % 10 < 9, "hot").when(F.col("id") % 20 == 9, F.lit(None)).otherwise((F.col("id") % 50).cast("string")).alias("k"),
        F.pmod(F.xxhash64("id"), F.lit(10**12)).alias("t"), F.when(F.col("id") % 11 > 0, F.col("id").cast("double")).alias("v"))
    out = previous_in_key(df, "k", "t", "v", "p", num_partitions=12)
    want = df.withColumn("p", F.lag("v").over(Window.partitionBy("k").orderBy("t")))
    assert out.exceptAll(want).isEmpty() and want.exceptAll(out).isEmpty()
    slices = df.repartitionByRange(12, F.col("k").asc_nulls_first(), F.col("t")).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in slices) < 30_000 / 4


# ------------------------------------------------------------------ exact sums --
def test_sums_do_not_depend_on_partitions(spark):
    r = random.Random(9)
    rows = [(r.choice("ab"), r.choice([1e-9, 1e-3, 1.0, 1e6, 1e12, 1e15, 1e20]) * r.gauss(0, 1)) for _ in range(4000)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = [sorted(map(tuple, df.repartition(n).groupBy("k").agg(exact_sum(F.col("v")).alias("s"), exact_avg(F.col("v")).alias("m")).collect()))
           for n in (1, 8, 200)]
    assert got[0] == got[1] == got[2]
    for k, s, _ in got[0]:
        assert s == pytest.approx(math.fsum(v for x, v in rows if x == k), rel=1e-12)
    panel = [sorted(map(str, panel_aggregate(df.select(F.lit(2020).alias("anio"), F.col("k").alias("departamento"), F.lit("T").alias("tipo_vehiculo"),
                                                       *[F.col("v").alias(c) for c in ("cantidad_ev", "kwh_promedio", "potencia_carga", "consumo_wh_km")])
                                             .repartition(n)).collect())) for n in (1, 8, 200)]
    assert panel[0] == panel[1] == panel[2]


@pytest.mark.parametrize("values, want", [([math.inf, 1.0], math.inf), ([1e30, 1.0], 1e30), ([math.inf, -math.inf], math.nan), ([math.nan, 1.0], math.nan),
                                          ([None, None], None), ([1e-20, 1e-20], 2e-20), ([], None), ([0.1] * 10, 1.0), ([-1e300, 1e300, 5.0], 5.0)])
def test_exact_sum_of_unusual_values(spark, values, want):
    got = spark.createDataFrame([(v,) for v in values], "v double").agg(exact_sum(F.col("v"))).first()[0]
    assert got == want or (want != want and got != got)


# ----------------------------------------------------------------- kept lookups --
def test_cache_adds_files_only(spark, tmp_path):
    cache = LookupCache(spark, str(tmp_path / "cache"), "query string, lat double")
    rows = spark.range(2000).select(F.concat(F.lit("q"), "id").alias("query"), F.col("id").cast("double").alias("lat"))
    assert cache.read().count() == 0 and cache.upsert(rows) == 2000
    before = {f: os.stat(f).st_mtime_ns for f in map(str, (tmp_path / "cache").rglob("*.parquet"))}
    again = spark.createDataFrame([("q5", -1.0), ("new", 1.0), ("new", 2.0), ("miss", None)], "query string, lat double")
    assert cache.upsert(again) == 2
    after = {f: os.stat(f).st_mtime_ns for f in map(str, (tmp_path / "cache").rglob("*.parquet"))}
    assert all(after[f] == t for f, t in before.items()) and len(after) - len(before) <= 2
    added = spark.read.parquet(*[f for f in after if f not in before]).count()
    assert added == 2
    got = {r["query"]: r.lat for r in cache.read().where("query in ('q5', 'new', 'miss')").collect()}
    assert got == {"q5": 5.0, "new": 1.0, "miss": None}
    assert cache.upsert(again) == 0


# ------------------------------------------------------------------ stage store --
def test_the_store_is_empty_after_the_run(spark):
    reg = spark.createDataFrame([(2018 + y, d, "CAR", float(y + 1), 40.0, 7.0, 150.0) for y in range(4) for d in "AB"], PANEL)
    assets = spark.createDataFrame([("x", "A", 10.0, 4.0, -74.0)],
                                   "nombre_activo string, departamento string, capacidad_hidraulica double, latitud double, longitud double")
    with StageStore(spark, "prueba") as store:
        result = run_flow(reg, assets, with_forests=False, store=store)
        assert {os.path.basename(p) for p in children(spark, store.folder)} == {"panel", "energy", "priority"}
        assert result.priority.count() == 2
        plan = result.energy.select("anio")._jdf.queryExecution().executedPlan().toString()
        assert "ReadSchema: struct<anio:int>" in plan
    assert not exists(spark, store.folder)


def test_two_predictions_for_one_key_are_an_error(spark):
    panel = spark.createDataFrame([(2022, "A", "T", 10.0, 1.0, 2.0, 3.0)], PANEL)
    kind = "anio int, departamento string, tipo_vehiculo string, cantidad_ev_pred double"
    for second in (13.0, None):
        preds = spark.createDataFrame([(2022, "A", "T", 12.0), (2022, "A", "T", second)], kind)
        with pytest.raises(Exception, match="two predictions"):
            en.forecast_overlay(panel, preds).collect()


def test_holdout_energy_fills_medians(spark):
    measures = spark.createDataFrame([(1.0, 10.0), (3.0, 30.0), (None, 20.0)], "kwh_promedio double, potencia_carga double")
    pred = spark.createDataFrame([(1, 2.0, None, 5.0), (2, 4.0, 7.0, None)], "i int, cantidad_ev_pred double, kwh_promedio double, potencia_carga double")
    got = {r.i: (r.consumo_energetico, r.demanda_futura) for r in en.holdout_energy(pred, measures, 0.5).collect()}
    assert got == {1: (4.0, 5.0), 2: (28.0, 40.0)}
