"""The data half of the maps: point tables, payload tables, domains, colour
bins and text for markers. Drawing itself is out of scope."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as nu
from ..functions import text as tx
from .common import attach_one_row
from .panel import latest_snapshot

PAYLOAD_METRICS = ["demanda_futura", "consumo_energetico", "cantidad_ev_modelada",
                   "cantidad_ev_historica", "aumento_demanda", "aumento_demanda_pct"]


def point_table(df: DataFrame, lat: str = "latitud", lon: str = "longitud") -> DataFrame:
    """Coerce coordinates to double and drop rows missing either one."""
    return (df.withColumn(lat, nu.coerce_numeric(F.col(lat)))
            .withColumn(lon, nu.coerce_numeric(F.col(lon)))
            .dropna(subset=[lat, lon]))


def demand_points(energy: DataFrame, priority: DataFrame) -> DataFrame:
    """Latest-year demand rows, left-joined with the ranking's coordinates,
    category and rank; rows without coordinates dropped."""
    latest = latest_snapshot(energy, "anio")
    pr = priority.select(F.col("departamento").alias("_pd"), "latitud", "longitud",
                         "categoria_prioridad", "ranking_prioridad")
    j = latest.join(pr, latest["departamento"].eqNullSafe(pr["_pd"]), "left").drop("_pd")
    return point_table(j)


def heat_points(points: DataFrame) -> DataFrame:
    """[lat, lon, demand] per (territory, type) row, not aggregated by place."""
    return points.select("departamento", "tipo_vehiculo", "latitud", "longitud",
                         F.coalesce(F.col("demanda_futura"), F.lit(0.0)).alias("peso"))


def boundary_metrics(boundaries: DataFrame, priority: DataFrame) -> DataFrame:
    """All boundary shapes kept, metrics attached where the department matches."""
    pr = priority.withColumnRenamed("departamento", "_pd")
    return boundaries.join(pr, boundaries["departamento"].eqNullSafe(pr["_pd"]), "left").drop("_pd")


def choropleth_frame(merged: DataFrame, metric: str, unit: str) -> DataFrame:
    """Boundary metrics plus the display text of the tooltip."""
    return (merged
            .withColumn(f"{metric}_display", tx.format_metric(F.col(metric), unit, 2))
            .withColumn("demanda_futura_display", tx.format_metric(F.col("demanda_futura"), "kW", 2))
            .withColumn("consumo_energetico_display", tx.format_metric(F.col("consumo_energetico"), "kWh", 2))
            .withColumn("cantidad_ev_modelada_display",
                        tx.format_metric(F.col("cantidad_ev_modelada"), "vehiculos", 0))
            .withColumn("indice_prioridad_display",
                        tx.format_metric(F.col("indice_prioridad_territorial"), "indice", 3)))


def payload_flat(yearly: DataFrame, metrics: Sequence[str] = PAYLOAD_METRICS) -> DataFrame:
    """One row per (territory, year): metrics NULL->0 rounded half-to-even to 2 places
    (the percent change times 100)."""
    cols = []
    for m in metrics:
        v = F.coalesce(F.col(m), F.lit(0.0))
        if m.endswith("_pct"):
            v = v * 100
        cols.append(F.bround(v, 2).alias(m))
    return yearly.select("departamento", F.col("anio").cast("int").alias("anio"), *cols)


def payload_nested(flat: DataFrame, metrics: Sequence[str] = PAYLOAD_METRICS) -> DataFrame:
    """territory -> {year text -> metrics struct}. One map per territory;
    its size is bounded by the number of periods."""
    entry = F.struct(F.col("anio").cast("string").alias("key"),
                     F.struct(*[F.col(m) for m in metrics]).alias("value"))
    return flat.groupBy("departamento").agg(F.map_from_entries(F.collect_list(entry)).alias("metricas_por_anio"))


def initial_year_values(yearly: DataFrame, metric: str) -> DataFrame:
    """The slider's first view: the last year, and each territory's value of the metric in it (missing -> 0)."""
    last = yearly.select(F.max("anio")).scalar()
    return yearly.where(F.col("anio") == last).select(
        F.col("anio").cast("int").alias("anio_inicial"), "departamento", F.coalesce(F.col(metric), F.lit(0.0)).alias("valor"))


def metric_domain(df: DataFrame, metric: str) -> DataFrame:
    """(min, max) of a metric (NULL->0 first); equal -> (min(0,min), max(1,max));
    also the 0..max(1, max) domain of the plain choropleths."""
    v = F.coalesce(F.col(metric), F.lit(0.0))
    agg = df.agg(F.min(v).alias("mn"), F.max(v).alias("mx"))
    mn, mx = F.coalesce(F.col("mn"), F.lit(0.0)), F.coalesce(F.col("mx"), F.lit(0.0))
    return agg.select(
        F.when(mn == mx, F.least(F.lit(0.0), mn)).otherwise(mn).alias("dominio_min"),
        F.when(mn == mx, F.greatest(F.lit(1.0), mx)).otherwise(mx).alias("dominio_max"),
        F.lit(0.0).alias("escala_min"),
        F.greatest(F.lit(1.0), mx).alias("escala_max"))


def projected_years(yearly: DataFrame, hist: str = "cantidad_ev_historica") -> DataFrame:
    """Years after the last year with historic counts > 0 (default: the
    first year) are projected."""
    last_hist = yearly.agg(F.coalesce(F.max(F.when(F.col(hist) > 0, F.col("anio"))),
                                      F.min("anio")).alias("ultimo_anio_historico"))
    years = yearly.select(F.col("anio").cast("int").alias("anio")).where(F.col("anio").isNotNull()).distinct()
    out = attach_one_row(years, last_hist)
    return out.withColumn("proyectado", F.col("anio") > F.col("ultimo_anio_historico"))


def color_bins(df: DataFrame, metric: str, domain: DataFrame) -> DataFrame:
    """Nine-bin colour of a metric against a domain table (one row)."""
    j = attach_one_row(df, domain.select("dominio_min", "dominio_max"))
    idx = nu.color_bin(F.col(metric), F.col("dominio_min"), F.col("dominio_max"))
    return j.withColumn("bin_color", idx).withColumn("color", nu.bin_color(F.col("bin_color"))) \
        .drop("dominio_min", "dominio_max")


def _fixed(c: Column, decimals: int) -> Column:
    """Plain fixed-point text (no grouping), rounded half-to-even on the
    exact binary value like Python's ``f"{x:.nf}"``."""
    pattern = "0." + "0" * decimals if decimals else "0"
    return F.call_function("format_number", F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(pattern))


def priority_popup() -> Column:
    return F.concat(
        F.lit("<b>"), F.coalesce(F.col("departamento"), F.lit("None")), F.lit("</b><br>Indice: "),
        _fixed(F.col("indice_prioridad_territorial"), 3),
        F.lit("<br>Ranking: "), F.coalesce(F.col("ranking_prioridad").cast("string"), F.lit("0")),
        F.lit("<br>Categoria: "), F.coalesce(F.col("categoria_prioridad"), F.lit("N/A")),
        F.lit("<br>Demanda futura: "), _fixed(F.col("demanda_futura"), 2))


def priority_markers(priority: DataFrame) -> DataFrame:
    pts = point_table(priority)
    return pts.select("departamento", "latitud", "longitud", "ranking_prioridad", "categoria_prioridad",
                      tx.category_color(F.col("categoria_prioridad")).alias("color"),
                      priority_popup().alias("popup"))


def asset_markers(assets: DataFrame) -> DataFrame:
    pts = point_table(assets)
    popup = F.concat(
        F.lit("<b>"), F.coalesce(F.col("nombre_activo"), F.lit("Activo hidraulico")),
        F.lit("</b><br>Departamento: "), F.coalesce(F.col("departamento"), F.lit("N/A")),
        F.lit("<br>Municipio: "), F.coalesce(F.col("municipio"), F.lit("N/A")),
        F.lit("<br>Capacidad hidraulica: "), F.coalesce(F.col("capacidad_hidraulica").cast("string"), F.lit("0")))
    return pts.select("id_activo", "nombre_activo", "departamento", "latitud", "longitud", popup.alias("popup"))


def pressure_circles(points: DataFrame) -> DataFrame:
    popup = F.concat(
        F.lit("<b>"), F.coalesce(F.col("departamento"), F.lit("N/A")), F.lit("</b><br>Demanda futura: "),
        _fixed(F.col("demanda_futura"), 2), F.lit("<br>Consumo energetico: "),
        _fixed(F.col("consumo_energetico"), 2))
    return points.select("departamento", "tipo_vehiculo", "latitud", "longitud",
                         nu.pressure_radius(F.col("demanda_futura")).alias("radio_m"), popup.alias("popup"))


def observed_horizons(panel: DataFrame, series: Sequence[str], time_col: str = "anio",
                      default: Sequence[int] = (5, 10, 15, 20, 30)) -> DataFrame:
    """Per series: offsets of its observations from the global first year,
    cleaned like the horizon parameter (positive, distinct, sorted; empty ->
    default). Array size is bounded by the number of periods."""
    first = panel.select(F.min(time_col)).scalar()
    offs = panel.groupBy(*series).agg(F.collect_set((F.col(time_col) - first).cast("int")).alias("_o"))
    cleaned = F.array_sort(F.array_distinct(F.filter(F.col("_o"), lambda x: x > 0)))
    dflt = F.array(*[F.lit(int(h)) for h in default])
    return offs.select(*series, F.when(F.size(cleaned) > 0, cleaned).otherwise(dflt).alias("horizontes"))


def generation_markers(plants: DataFrame, kind_col: str | None = None) -> DataFrame:
    """Generation plant markers (after the override join): point table plus
    popup with type, department, municipality, location precision and the
    coordinates used (4 decimals)."""
    pts = point_table(plants)
    kind = F.coalesce(F.col(kind_col), F.lit("Infraestructura")) if kind_col else F.lit("Infraestructura")
    popup = F.concat(
        F.lit("<b>"), kind, F.lit("</b><br>Departamento: "), F.coalesce(F.col("departamento"), F.lit("N/A")),
        F.lit("<br>Municipio: "), F.coalesce(F.col("municipio"), F.lit("NO DISPONIBLE")),
        F.lit("<br>Prioridad energetica: N/A<br>Tipo de ubicacion: "),
        F.coalesce(F.col("precision_ubicacion"), F.lit("N/A")),
        F.lit("<br>Latitud usada: "), _fixed(F.col("latitud"), 4),
        F.lit("<br>Longitud usada: "), _fixed(F.col("longitud"), 4),
        F.lit("<br><span style='color:#666;'>La fuente no trae municipio ni coordenada exacta de planta.</span>"))
    return pts.select("id", "departamento", "municipio", "latitud", "longitud", popup.alias("popup"))
