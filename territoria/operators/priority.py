"""Stage 3: department snapshot, asset coverage, demand x asset join, min-max
criteria, weighted index, dense rank, category, observation, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import exact_avg, exact_sum
from ..params import DEFAULT_WEIGHTS
from .common import attach_one_row, cut_lineage
from .ordinal import dense_rank_desc

# --- fixed values (thresholds and texts of the reference) ------------------
HIGH = 0.66
LOW = 0.33
CONSISTENCY_MIN = 0.10
OBS_BALANCED = "Prioridad balanceada"
OBS_SUPPORT_GAP = "Alta demanda proyectada y brecha de soporte hidraulico"
OBS_COVERAGE_GAP = "Alta demanda proyectada y baja cobertura hidraulica"
OBS_LOW_PRESSURE = "Presion territorial baja en el escenario base"
# column names and order of the ranking and validation tables
GIS_COLUMNS = [
    "departamento", "anio_min", "anio_max", "cantidad_ev", "cantidad_ev_modelada",
    "consumo_energetico", "demanda_futura", "total_activos_hidraulicos",
    "capacidad_hidraulica_total", "latitud_hidraulica_promedio", "longitud_hidraulica_promedio",
    "latitud", "longitud", "criterio_demanda", "criterio_crecimiento_ev",
    "criterio_soporte_hidraulico", "criterio_cobertura_hidraulica",
    "criterio_brecha_soporte_hidraulico", "criterio_brecha_cobertura_hidraulica",
    "indice_prioridad_territorial", "ranking_prioridad", "categoria_prioridad", "anio_escenario",
    "escenario_energetico_base", "observacion_prioridad",
]
VALIDATION_COLUMNS = [
    "departamento", "anio_escenario", "escenario_energetico_base", "ranking_prioridad",
    "categoria_prioridad", "indice_prioridad_territorial", "demanda_futura", "consumo_energetico",
    "cantidad_ev_modelada", "capacidad_hidraulica_total", "total_activos_hidraulicos",
    "criterio_demanda", "criterio_crecimiento_ev", "criterio_soporte_hidraulico",
    "criterio_cobertura_hidraulica", "criterio_brecha_soporte_hidraulico",
    "criterio_brecha_cobertura_hidraulica", "peso_demanda", "peso_crecimiento_ev",
    "peso_brecha_soporte_hidraulico", "peso_brecha_cobertura_hidraulica",
    "sin_soporte_hidraulico", "sin_cobertura_hidraulica", "consistencia_territorial_ok",
    "observacion_prioridad",
]
# ---------------------------------------------------------------------------


def department_snapshot(energy: DataFrame, dept: str = "departamento", time_col: str = "anio") -> DataFrame:
    """Rows of the latest year summed per department (NULL department kept)."""
    top = energy.select(F.max(time_col)).scalar()
    snap = energy.where(F.col(time_col) == top)
    s = lambda c: F.coalesce(exact_sum(F.col(c)), F.lit(0.0)).alias(c)
    return snap.groupBy(dept).agg(
        F.min(time_col).cast("int").alias("anio_min"), F.max(time_col).cast("int").alias("anio_max"),
        s("cantidad_ev"), s("cantidad_ev_modelada"), s("consumo_energetico"), s("demanda_futura"))


def asset_coverage(assets: DataFrame, dept: str = "departamento") -> DataFrame:
    """Per department: non-null asset names, total capacity, mean coords."""
    return assets.groupBy(dept).agg(
        F.count("nombre_activo").cast("double").alias("total_activos_hidraulicos"),
        F.coalesce(exact_sum(F.col("capacidad_hidraulica")), F.lit(0.0)).alias("capacidad_hidraulica_total"),
        exact_avg(F.col("latitud")).alias("latitud_hidraulica_promedio"),
        exact_avg(F.col("longitud")).alias("longitud_hidraulica_promedio"))


def demand_asset_join(snapshot: DataFrame, coverage: DataFrame, dept: str = "departamento") -> DataFrame:
    """Left join on department (NULL matches NULL). ``latitud``/``longitud``
    are copied before the fill and stay NULL for uncovered departments; the
    four asset measures are then filled with 0."""
    cov = coverage.withColumnRenamed(dept, "_cov_dept")
    j = snapshot.join(cov, snapshot[dept].eqNullSafe(cov["_cov_dept"]), "left").drop("_cov_dept")
    j = (j.withColumn("latitud", F.col("latitud_hidraulica_promedio"))
         .withColumn("longitud", F.col("longitud_hidraulica_promedio")))
    for c in ("total_activos_hidraulicos", "capacidad_hidraulica_total",
              "latitud_hidraulica_promedio", "longitud_hidraulica_promedio"):
        j = j.withColumn(c, F.coalesce(F.col(c), F.lit(0.0)))
    return j


def _clean(col: str) -> Column:
    return F.coalesce(F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double")), F.lit(0.0))


def min_max_scale_many(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Min-max scale several columns ({input: output}) with one aggregate.

    NULL/NaN count as 0; all zeros when max = min or the input is empty.
    The one-row min/max table is broadcast-joined back (not an unpartitioned
    window, which would put every row into one task).
    """
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.min(_clean(c)).alias(f"_mn{i}"), F.max(_clean(c)).alias(f"_mx{i}")]
    out = attach_one_row(df, df.agg(*aggs))
    for i, (c, o) in enumerate(cols.items()):
        mn, mx, v = F.col(f"_mn{i}"), F.col(f"_mx{i}"), _clean(c)
        out = out.withColumn(o, F.when(mx.isNull() | (mx == mn), F.lit(0.0)).otherwise((v - mn) / (mx - mn)))
    return out.drop(*[f"_mn{i}" for i in range(len(cols))], *[f"_mx{i}" for i in range(len(cols))])


def min_max_scale(df: DataFrame, col: str, out: str) -> DataFrame:
    return min_max_scale_many(df, {col: out})


def weighted_index(weights: dict[str, float] | None = None) -> Column:
    w = weights or DEFAULT_WEIGHTS
    return (F.lit(w["demanda"]) * F.col("criterio_demanda")
            + F.lit(w["crecimiento_ev"]) * F.col("criterio_crecimiento_ev")
            + F.lit(w["soporte_hidraulico"]) * F.col("criterio_brecha_soporte_hidraulico")
            + F.lit(w["cobertura_hidraulica"]) * F.col("criterio_brecha_cobertura_hidraulica"))


def priority_category(idx: Column) -> Column:
    return F.when(idx >= HIGH, "ALTA").when(idx < LOW, "BAJA").otherwise("MEDIA")


def priority_observation() -> Column:
    """Later rules overwrite earlier ones in the reference; evaluated here
    in reverse order so the first matching branch wins."""
    d = F.col("criterio_demanda")
    return (F.when((d < LOW) & (F.col("criterio_crecimiento_ev") < LOW), OBS_LOW_PRESSURE)
             .when((d >= HIGH) & (F.col("criterio_brecha_cobertura_hidraulica") >= HIGH), OBS_COVERAGE_GAP)
             .when((d >= HIGH) & (F.col("criterio_brecha_soporte_hidraulico") >= HIGH), OBS_SUPPORT_GAP)
             .otherwise(OBS_BALANCED))


def add_criteria(df: DataFrame) -> DataFrame:
    df = min_max_scale_many(df, {
        "demanda_futura": "criterio_demanda",
        "cantidad_ev_modelada": "criterio_crecimiento_ev",
        "capacidad_hidraulica_total": "criterio_soporte_hidraulico",
        "total_activos_hidraulicos": "criterio_cobertura_hidraulica"})
    return (df.withColumn("criterio_brecha_soporte_hidraulico", 1 - F.col("criterio_soporte_hidraulico"))
            .withColumn("criterio_brecha_cobertura_hidraulica", 1 - F.col("criterio_cobertura_hidraulica")))


def build_priority_table(energy: DataFrame, assets: DataFrame, weights: dict[str, float] | None = None,
                         scenario_label: str = "medio") -> DataFrame:
    """Department ranking table (25 columns), ordered by (rank, department)."""
    gis = demand_asset_join(department_snapshot(energy), asset_coverage(assets))
    gis = add_criteria(gis).withColumn("indice_prioridad_territorial", weighted_index(weights))
    # department grain: written once, because the rank reads it three times
    gis = dense_rank_desc(cut_lineage(gis), "indice_prioridad_territorial", "ranking_prioridad")
    gis = (gis.withColumn("categoria_prioridad", priority_category(F.col("indice_prioridad_territorial")))
           .withColumn("anio_escenario", F.col("anio_max"))
           .withColumn("escenario_energetico_base", F.lit(scenario_label))
           .withColumn("observacion_prioridad", priority_observation()))
    return gis.select(*GIS_COLUMNS).orderBy("ranking_prioridad", F.col("departamento").asc_nulls_first())


def build_validation_table(gis: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    w = weights or DEFAULT_WEIGHTS
    idx = F.col("indice_prioridad_territorial")
    return (gis.withColumn("peso_demanda", F.lit(float(w["demanda"])))
            .withColumn("peso_crecimiento_ev", F.lit(float(w["crecimiento_ev"])))
            .withColumn("peso_brecha_soporte_hidraulico", F.lit(float(w["soporte_hidraulico"])))
            .withColumn("peso_brecha_cobertura_hidraulica", F.lit(float(w["cobertura_hidraulica"])))
            .withColumn("sin_soporte_hidraulico", F.coalesce(F.col("capacidad_hidraulica_total"), F.lit(0.0)) == 0)
            .withColumn("sin_cobertura_hidraulica", F.coalesce(F.col("total_activos_hidraulicos"), F.lit(0.0)) == 0)
            .withColumn("consistencia_territorial_ok",
                        (idx <= LOW) | (F.col("criterio_demanda") >= CONSISTENCY_MIN)
                        | (F.col("criterio_crecimiento_ev") >= CONSISTENCY_MIN))
            .select(*VALIDATION_COLUMNS))
