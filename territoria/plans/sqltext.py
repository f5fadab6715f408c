"""DuckDB SQL text for the oracle side: the same rules as the Spark column
helpers, written as SQL expressions over the pre-registered test views."""

from __future__ import annotations

from ..functions.text import (CATEGORY_COLORS, DEFAULT_CATEGORY_COLOR, DEPARTMENT_ACCENTS_FROM,
                              DEPARTMENT_ACCENTS_TO, DEPARTMENT_ALIASES, DISPLAY_LABELS, WS_CLASS)
from ..params import DEFAULT_WEIGHTS

WS = WS_CLASS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def esum(x: str) -> str:
    return f"CAST(CAST(sum(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 12))) AS VARCHAR) AS DOUBLE)"


def eavg(x: str) -> str:
    return f"(CAST(CAST(sum(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 12))) AS VARCHAR) AS DOUBLE) / CAST(count({x}) AS DOUBLE))"



def rnd(x: str, d: int) -> str:
    """Half-up rounding of the shortest decimal form (Spark ``round``)."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 12)), {d}) AS DOUBLE)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def upper(x: str) -> str:
    # Python / Java upper-case 'ß' as 'SS'
    return f"upper(replace({x}, 'ß', 'SS'))"


def standardize(x: str) -> str:
    return upper(strip(x))


def norm_dept(x: str) -> str:
    base = (f"regexp_replace(translate({upper(strip(x))}, {q(DEPARTMENT_ACCENTS_FROM)}, "
            f"{q(DEPARTMENT_ACCENTS_TO)}), '{WS}+', ' ', 'g')")
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in DEPARTMENT_ALIASES.items())
    return f"(CASE {base} {cases} ELSE {base} END)"


def fold(x: str) -> str:
    return f"coalesce(strip_accents({upper(strip(x))}), '')"


def display_label(x: str) -> str:
    base = upper(strip(f"CAST({x} AS VARCHAR)"))
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in DISPLAY_LABELS.items())
    return f"(CASE {base} {cases} ELSE {base} END)"


def category_color(x: str) -> str:
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in CATEGORY_COLORS.items())
    return f"(CASE upper(coalesce({x}, 'None')) {cases} ELSE {q(DEFAULT_CATEGORY_COLOR)} END)"


def format_metric(x: str, unit: str, decimals: int = 2) -> str:
    v = f"(CASE WHEN {x} IS NULL OR isnan({x}) THEN 0.0 ELSE CAST({x} AS DOUBLE) END)"
    txt = f"translate(format('{{:,.{decimals}f}}', {v}), ',.', '.,')"
    return f"trim({txt} || ' {unit}')" if unit else txt


def synthetic_lat(k: str) -> str:
    return f"round(-4.0 + CAST((({k}) * 37) % 1601 AS DOUBLE) / 100.0, 4)"


def synthetic_lon(k: str) -> str:
    return f"round(-79.0 + CAST((({k}) * 53) % 1201 AS DOUBLE) / 100.0, 4)"


W = DEFAULT_WEIGHTS


REGISTRATIONS = f"""
reg AS (
  SELECT CAST(year(o.o_orderdate) AS INTEGER) AS anio,
         {norm_dept('n.n_name')} AS departamento,
         {standardize('p.p_type')} AS tipo_vehiculo,
         coalesce(l.l_quantity, 0.0) AS cantidad_ev,
         l.l_extendedprice AS kwh_promedio,
         p.p_retailprice AS potencia_carga,
         CAST(p.p_size AS DOUBLE) AS consumo_wh_km,
         o.o_custkey AS o_custkey
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN part p ON l.l_partkey = p.p_partkey
)"""

ASSETS = f"""
assets AS (
  SELECT s.s_suppkey AS id_activo, s.s_name AS nombre_activo, {norm_dept('n.n_name')} AS departamento,
         CAST(NULL AS VARCHAR) AS municipio, r.r_name AS subarea,
         s.s_acctbal AS capacidad_hidraulica,
         {synthetic_lat('s.s_suppkey')} AS latitud, {synthetic_lon('s.s_suppkey')} AS longitud
  FROM supplier s
  LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
)"""

PANEL = f"""
panel AS (
  SELECT anio, departamento, tipo_vehiculo,
         coalesce(sum(cantidad_ev), 0.0) AS cantidad_ev,
         avg(kwh_promedio) AS kwh_promedio, avg(potencia_carga) AS potencia_carga,
         avg(consumo_wh_km) AS consumo_wh_km
  FROM reg GROUP BY anio, departamento, tipo_vehiculo
)"""

DATA = """
data AS (
  SELECT * FROM panel
  WHERE anio IS NOT NULL AND departamento IS NOT NULL AND tipo_vehiculo IS NOT NULL
    AND cantidad_ev IS NOT NULL
),
cut AS (SELECT max(anio) AS cutoff FROM data WHERE anio < (SELECT max(anio) FROM data)),
train AS (SELECT * FROM data WHERE anio <= (SELECT cutoff FROM cut)),
test AS (SELECT * FROM data WHERE anio > (SELECT cutoff FROM cut))"""


def trend_fit(name: str, src: str, series=("departamento", "tipo_vehiculo"), time="anio",
              value="cantidad_ev") -> str:
    s = ", ".join(series)
    return f"""
{name}_y AS (
  SELECT {s}, {time}, coalesce(sum({value}), 0.0) AS y FROM {src} GROUP BY {s}, {time}
),
{name}_s AS (
  SELECT {s}, CAST(count({time}) AS DOUBLE) AS n, sum(CAST({time} AS DOUBLE)) AS sx, sum(y) AS sy,
         sum(CAST({time} AS DOUBLE) * y) AS sxy, sum(CAST({time} AS DOUBLE) * CAST({time} AS DOUBLE)) AS sxx,
         max_by(y, {time}) AS last_y
  FROM {name}_y WHERE {time} IS NOT NULL GROUP BY {s}
),
{name} AS (
  SELECT {s},
    CASE WHEN n >= 2 THEN (n * sxy - sx * sy) / (n * sxx - sx * sx) ELSE 0.0 END AS slope,
    CASE WHEN n >= 2 THEN (sy - ((n * sxy - sx * sy) / (n * sxx - sx * sx)) * sx) / n ELSE last_y END AS intercept,
    CAST(n AS BIGINT) AS n_years
  FROM {name}_s
)"""


def trend_pred(target: str, trend: str, series=("departamento", "tipo_vehiculo"), time="anio") -> str:
    on = " AND ".join(f"x.{c} IS NOT DISTINCT FROM t.{c}" for c in series)
    return (f"coalesce(greatest(t.intercept + t.slope * CAST(x.{time} AS DOUBLE), 0.0), 0.0)",
            f"{target} x LEFT JOIN {trend} t ON {on}")


BACKTEST = f"""
{trend_fit('trend_train', 'train')},
backtest AS (
  SELECT x.anio, x.departamento, x.tipo_vehiculo, x.cantidad_ev, x.kwh_promedio, x.potencia_carga,
         x.consumo_wh_km, 'backtest' AS tipo_prediccion, CAST(NULL AS INTEGER) AS anio_base,
         CAST(NULL AS INTEGER) AS horizonte_anios, CAST(NULL AS DOUBLE) AS cantidad_ev_pred_modelo_a,
         CAST(NULL AS DOUBLE) AS cantidad_ev_pred_modelo_b,
         {trend_pred('test', 'trend_train')[0]} AS cantidad_ev_pred_tendencia
  FROM {trend_pred('test', 'trend_train')[1]}
),
predictions AS (
  SELECT *, cantidad_ev_pred_tendencia AS cantidad_ev_pred,
         'proyeccion_tendencial_grupo' AS modelo_seleccionado,
         abs(cantidad_ev - cantidad_ev_pred_tendencia) AS error_absoluto
  FROM backtest
)"""


def future(horizons=(5, 10, 15, 20, 30)) -> str:
    hs = ", ".join(str(h) for h in horizons)
    return f"""
{trend_fit('trend_all', 'data')},
latest AS (
  SELECT departamento, tipo_vehiculo,
         max_by(kwh_promedio, anio) AS kwh_promedio, max_by(potencia_carga, anio) AS potencia_carga,
         max_by(consumo_wh_km, anio) AS consumo_wh_km, max_by(cantidad_ev, anio) AS cantidad_ev
  FROM data GROUP BY departamento, tipo_vehiculo
),
fan AS (
  SELECT l.*, CAST((SELECT max(anio) FROM data) AS INTEGER) AS anio_base,
         CAST(h.h AS INTEGER) AS horizonte_anios,
         CAST((SELECT max(anio) FROM data) + h.h AS INTEGER) AS anio
  FROM latest l CROSS JOIN (SELECT unnest([{hs}]) AS h) h
),
forecast AS (
  SELECT x.anio, x.departamento, x.tipo_vehiculo, CAST(NULL AS DOUBLE) AS cantidad_ev,
         x.kwh_promedio, x.potencia_carga, x.consumo_wh_km, x.anio_base, x.horizonte_anios,
         'forecast_futuro' AS tipo_prediccion,
         CAST(NULL AS DOUBLE) AS cantidad_ev_pred_modelo_a, CAST(NULL AS DOUBLE) AS cantidad_ev_pred_modelo_b,
         {trend_pred('fan', 'trend_all')[0]} AS cantidad_ev_pred_tendencia,
         round_even(round({trend_pred('fan', 'trend_all')[0]}, 6), 0) AS cantidad_ev_pred,
         'proyeccion_tendencial_grupo' AS modelo_seleccionado, CAST(NULL AS DOUBLE) AS error_absoluto
  FROM {trend_pred('fan', 'trend_all')[1]}
)"""


def energy(sim: float = 0.3) -> str:
    return f"""
overlay AS (
  SELECT p.*, CAST(NULL AS INTEGER) AS anio_base, CAST(NULL AS INTEGER) AS horizonte_anios,
         d.cantidad_ev_pred,
         coalesce(d.cantidad_ev_pred, p.cantidad_ev) AS cantidad_ev_modelada,
         CASE WHEN d.cantidad_ev_pred IS NOT NULL THEN 'forecast_baseline' ELSE 'historico' END
           AS fuente_cantidad_ev
  FROM panel p LEFT JOIN (SELECT DISTINCT anio, departamento, tipo_vehiculo, cantidad_ev_pred FROM predictions) d
    ON p.anio IS NOT DISTINCT FROM d.anio AND p.departamento IS NOT DISTINCT FROM d.departamento
   AND p.tipo_vehiculo IS NOT DISTINCT FROM d.tipo_vehiculo
),
futrows AS (
  SELECT DISTINCT anio, departamento, tipo_vehiculo, kwh_promedio, potencia_carga, consumo_wh_km,
         cantidad_ev_pred, anio_base, horizonte_anios FROM forecast
),
unioned AS (
  SELECT anio, departamento, tipo_vehiculo, cantidad_ev, kwh_promedio, potencia_carga, consumo_wh_km,
         anio_base, horizonte_anios, cantidad_ev_pred, cantidad_ev_modelada, fuente_cantidad_ev FROM overlay
  UNION ALL
  SELECT anio, departamento, tipo_vehiculo, 0.0, kwh_promedio, potencia_carga, consumo_wh_km,
         anio_base, horizonte_anios, cantidad_ev_pred, cantidad_ev_pred, 'forecast_futuro' FROM futrows
),
energy AS (
  SELECT anio, departamento, tipo_vehiculo, cantidad_ev,
         coalesce(kwh_promedio, 0.0) AS kwh_promedio, coalesce(potencia_carga, 0.0) AS potencia_carga,
         consumo_wh_km, anio_base, horizonte_anios, cantidad_ev_pred, cantidad_ev_modelada,
         fuente_cantidad_ev, {sim} AS simultaneidad,
         cantidad_ev_modelada * coalesce(kwh_promedio, 0.0) AS consumo_energetico,
         cantidad_ev_modelada * coalesce(potencia_carga, 0.0) * {sim} AS demanda_futura,
         cantidad_ev_modelada * coalesce(kwh_promedio, 0.0) AS consumo_energetico_kwh,
         cantidad_ev_modelada * coalesce(potencia_carga, 0.0) * {sim} AS demanda_futura_kw
  FROM unioned
)"""


def _scaled(col: str, out: str, src: str) -> str:
    v = f"coalesce(CASE WHEN isnan({col}) THEN NULL ELSE {col} END, 0.0)"
    return (f"CASE WHEN (SELECT max({v}) FROM {src}) IS NULL OR (SELECT max({v}) FROM {src}) = "
            f"(SELECT min({v}) FROM {src}) THEN 0.0 ELSE ({v} - (SELECT min({v}) FROM {src})) / "
            f"((SELECT max({v}) FROM {src}) - (SELECT min({v}) FROM {src})) END AS {out}")


PRIORITY = f"""
snap AS (
  SELECT departamento, CAST(min(anio) AS INTEGER) AS anio_min, CAST(max(anio) AS INTEGER) AS anio_max,
         coalesce(CAST(CAST(sum(CAST(CAST(cantidad_ev AS VARCHAR) AS DECIMAL(38, 12))) AS VARCHAR) AS DOUBLE), 0.0) AS cantidad_ev,
         coalesce(CAST(CAST(sum(CAST(CAST(cantidad_ev_modelada AS VARCHAR) AS DECIMAL(38, 12))) AS VARCHAR) AS DOUBLE), 0.0) AS cantidad_ev_modelada,
         coalesce(CAST(CAST(sum(CAST(CAST(consumo_energetico AS VARCHAR) AS DECIMAL(38, 12))) AS VARCHAR) AS DOUBLE), 0.0) AS consumo_energetico,
         coalesce(CAST(CAST(sum(CAST(CAST(demanda_futura AS VARCHAR) AS DECIMAL(38, 12))) AS VARCHAR) AS DOUBLE), 0.0) AS demanda_futura
  FROM energy WHERE anio = (SELECT max(anio) FROM energy) GROUP BY departamento
),
coverage AS (
  SELECT departamento, CAST(count(nombre_activo) AS DOUBLE) AS total_activos_hidraulicos,
         coalesce(CAST(CAST(sum(CAST(CAST(capacidad_hidraulica AS VARCHAR) AS DECIMAL(38, 12))) AS VARCHAR) AS DOUBLE), 0.0)
           AS capacidad_hidraulica_total,
         CAST(CAST(sum(CAST(CAST(latitud AS VARCHAR) AS DECIMAL(38, 12))) AS VARCHAR) AS DOUBLE) / CAST(count(latitud) AS DOUBLE)
           AS latitud_hidraulica_promedio,
         CAST(CAST(sum(CAST(CAST(longitud AS VARCHAR) AS DECIMAL(38, 12))) AS VARCHAR) AS DOUBLE) / CAST(count(longitud) AS DOUBLE)
           AS longitud_hidraulica_promedio
  FROM assets GROUP BY departamento
),
joined AS (
  SELECT s.*, coalesce(c.total_activos_hidraulicos, 0.0) AS total_activos_hidraulicos,
         coalesce(c.capacidad_hidraulica_total, 0.0) AS capacidad_hidraulica_total,
         coalesce(c.latitud_hidraulica_promedio, 0.0) AS latitud_hidraulica_promedio,
         coalesce(c.longitud_hidraulica_promedio, 0.0) AS longitud_hidraulica_promedio,
         c.latitud_hidraulica_promedio AS latitud, c.longitud_hidraulica_promedio AS longitud
  FROM snap s LEFT JOIN coverage c ON s.departamento IS NOT DISTINCT FROM c.departamento
),
crit AS (
  SELECT *,
    {_scaled('demanda_futura', 'criterio_demanda', 'joined')},
    {_scaled('cantidad_ev_modelada', 'criterio_crecimiento_ev', 'joined')},
    {_scaled('capacidad_hidraulica_total', 'criterio_soporte_hidraulico', 'joined')},
    {_scaled('total_activos_hidraulicos', 'criterio_cobertura_hidraulica', 'joined')}
  FROM joined
),
crit2 AS (
  SELECT *, 1 - criterio_soporte_hidraulico AS criterio_brecha_soporte_hidraulico,
         1 - criterio_cobertura_hidraulica AS criterio_brecha_cobertura_hidraulica FROM crit
),
idx AS (
  SELECT *, {W['demanda']} * criterio_demanda + {W['crecimiento_ev']} * criterio_crecimiento_ev
          + {W['soporte_hidraulico']} * criterio_brecha_soporte_hidraulico
          + {W['cobertura_hidraulica']} * criterio_brecha_cobertura_hidraulica AS indice_prioridad_territorial
  FROM crit2
),
gis AS (
  SELECT departamento, anio_min, anio_max, cantidad_ev, cantidad_ev_modelada, consumo_energetico,
         demanda_futura, total_activos_hidraulicos, capacidad_hidraulica_total,
         latitud_hidraulica_promedio, longitud_hidraulica_promedio, latitud, longitud,
         criterio_demanda, criterio_crecimiento_ev, criterio_soporte_hidraulico,
         criterio_cobertura_hidraulica, criterio_brecha_soporte_hidraulico,
         criterio_brecha_cobertura_hidraulica, indice_prioridad_territorial,
         CAST(dense_rank() OVER (ORDER BY indice_prioridad_territorial DESC) AS INTEGER)
           AS ranking_prioridad,
         CASE WHEN indice_prioridad_territorial >= 0.66 THEN 'ALTA'
              WHEN indice_prioridad_territorial < 0.33 THEN 'BAJA' ELSE 'MEDIA' END AS categoria_prioridad,
         CAST((SELECT max(anio) FROM energy) AS INTEGER) AS anio_escenario,
         'medio' AS escenario_energetico_base,
         CASE WHEN criterio_demanda < 0.33 AND criterio_crecimiento_ev < 0.33
                THEN 'Presion territorial baja en el escenario base'
              WHEN criterio_demanda >= 0.66 AND criterio_brecha_cobertura_hidraulica >= 0.66
                THEN 'Alta demanda proyectada y baja cobertura hidraulica'
              WHEN criterio_demanda >= 0.66 AND criterio_brecha_soporte_hidraulico >= 0.66
                THEN 'Alta demanda proyectada y brecha de soporte hidraulico'
              ELSE 'Prioridad balanceada' END AS observacion_prioridad
  FROM idx
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip().rstrip(",") for c in ctes)


FLOW = with_(REGISTRATIONS, ASSETS, PANEL, DATA, BACKTEST, future(), energy(), PRIORITY)


# ----------------------------------------------------------- side roles ---
CUSTOMERS_GEO = f"""
cgeo AS (
  SELECT c.c_custkey, c.c_name AS nombre, c.c_mktsegment AS municipio,
         {norm_dept('n.n_name')} AS departamento, r.r_name AS subarea,
         CASE WHEN c.c_acctbal >= 0 THEN {synthetic_lat('c.c_custkey')} END AS latitud,
         CASE WHEN c.c_acctbal >= 0 THEN {synthetic_lon('c.c_custkey')} END AS longitud
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
)"""


def _clean(x: str) -> str:
    return strip(f"coalesce(CAST({x} AS VARCHAR), '')")


def _edges(x: str) -> str:
    return f"regexp_replace({x}, '^[, ]+|[, ]+$', '', 'g')"


def lookup_queries(name: str, mun: str, reg: str, sub: str) -> str:
    n, m, r, s = _clean(name), _clean(mun), _clean(reg), _clean(sub)
    q1 = _edges(f"{n} || ', ' || {m} || ', ' || {r} || ', Colombia'")
    q2 = _edges(f"{m} || ', ' || {r} || ', Colombia'")
    q3 = _edges(f"CASE WHEN {s} <> '' THEN {s} || ', ' || {r} || ', Colombia' ELSE '' END")
    q4 = _edges(f"{r} || ', Colombia'")
    return (f"list_filter([{q1}, CASE WHEN {q2} <> {q1} THEN {q2} ELSE '' END, "
            f"CASE WHEN {q3} NOT IN ({q1}, {q2}) THEN {q3} ELSE '' END, "
            f"CASE WHEN {q4} NOT IN ({q1}, {q2}, {q3}) THEN {q4} ELSE '' END], lambda x: x <> '')")


GAZETTEER = f"""
gaz_seg AS (
  SELECT municipio || ', ' || departamento || ', Colombia' AS query,
         {rnd(eavg('latitud'), 4)} AS latitud, {rnd(eavg('longitud'), 4)} AS longitud
  FROM cgeo WHERE latitud IS NOT NULL AND longitud IS NOT NULL GROUP BY municipio, departamento
),
gaz_reg AS (
  SELECT subarea || ', ' || departamento || ', Colombia' AS query,
         {rnd(eavg('latitud'), 4)} AS latitud, {rnd(eavg('longitud'), 4)} AS longitud
  FROM assets GROUP BY subarea, departamento
),
gaz_dep AS (
  SELECT {norm_dept('n.n_name')} || ', Colombia' AS query,
         CASE WHEN EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey)
              THEN {synthetic_lat('n.n_nationkey')} END AS latitud,
         CASE WHEN EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey)
              THEN {synthetic_lon('n.n_nationkey')} END AS longitud
  FROM nation n
),
gazetteer AS (
  SELECT query, latitud, longitud, query AS display_name FROM gaz_seg
  UNION ALL SELECT query, latitud, longitud, query FROM gaz_reg
  UNION ALL SELECT query, latitud, longitud, CASE WHEN latitud IS NOT NULL THEN query END FROM gaz_dep
)"""

EMB_REF = """
refs_raw AS (
  SELECT round_even(CAST(embedding[3] AS DOUBLE), 4) AS rx, round_even(CAST(embedding[4] AS DOUBLE), 4) AS ry,
         label AS v, vec_id * 2 AS o FROM embeddings
  UNION ALL
  SELECT round_even(CAST(embedding[1] AS DOUBLE), 4), round_even(CAST(embedding[2] AS DOUBLE), 4),
         label, vec_id * 2 + 1 FROM embeddings WHERE label = 0
),
ref AS (SELECT rx, ry, arg_max(v, o) AS v, min(o) AS o FROM refs_raw GROUP BY rx, ry),
qpts AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS qx, CAST(embedding[2] AS DOUBLE) AS qy FROM embeddings)"""


YEARLY = """
yearly AS (
  SELECT anio, departamento,
         coalesce(CAST(CAST(sum(CAST(CAST(cantidad_ev AS VARCHAR) AS DECIMAL(38, 12))) AS VARCHAR) AS DOUBLE), 0.0) AS cantidad_ev_historica,
         coalesce(CAST(CAST(sum(CAST(CAST(cantidad_ev_modelada AS VARCHAR) AS DECIMAL(38, 12))) AS VARCHAR) AS DOUBLE), 0.0) AS cantidad_ev_modelada,
         coalesce(CAST(CAST(sum(CAST(CAST(consumo_energetico AS VARCHAR) AS DECIMAL(38, 12))) AS VARCHAR) AS DOUBLE), 0.0) AS consumo_energetico,
         coalesce(CAST(CAST(sum(CAST(CAST(demanda_futura AS VARCHAR) AS DECIMAL(38, 12))) AS VARCHAR) AS DOUBLE), 0.0) AS demanda_futura
  FROM energy GROUP BY anio, departamento
),
chg AS (
  SELECT *,
    CASE WHEN departamento IS NULL THEN 0.0
         ELSE coalesce(demanda_futura - lag(demanda_futura) OVER w, 0.0) END AS aumento_demanda,
    CASE WHEN departamento IS NULL THEN 0.0
         ELSE coalesce((demanda_futura - lag(demanda_futura) OVER w) / nullif(lag(demanda_futura) OVER w, 0), 0.0)
    END AS aumento_demanda_pct
  FROM yearly WINDOW w AS (PARTITION BY departamento ORDER BY anio)
)"""

PALETTE_SQL = "['#ffffcc', '#ffeda0', '#fed976', '#feb24c', '#fd8d3c', '#fc4e2a', '#e31a1c', '#bd0026', '#800026']"


def fixed(x: str, decimals: int) -> str:
    return f"printf('%.{decimals}f', coalesce(CAST({x} AS DOUBLE), 0.0))"

