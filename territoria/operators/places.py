"""Place operators: override and catalogue joins, waterfall lookup against a
gazetteer / cache table, exact-then-nearest reference lookup, positional
(FIFO) assignment."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.numeric import coerce_numeric
from .common import cut_lineage, null_safe_on
from .hot_keys import hot_key_join
from .ordinal import ordinal_within_key

# --- fixed values (texts of the reference) ---------------------------------
NO_MUNICIPALITY = "NO DISPONIBLE EN LA FUENTE"
PRECISION_APPROX = "coordenada_aproximada_departamental"
DETAIL_APPROX = ("La fuente original no incluye municipio ni coordenada puntual de la planta; "
                 "se usa una ubicacion aproximada asociada al departamento.")
PRECISION_OVERRIDE = "coordenada_municipal_referenciada"
DETAIL_OVERRIDE = "Municipio referenciado manualmente y coordenada tomada del catalogo municipal de apoyo."
COUNTRY = "Colombia"
UNKNOWN = "UNKNOWN"
DRY_RUN = "dry_run"
# ---------------------------------------------------------------------------


# ------------------------------------------------------------ J5 / J4 -----
def complete_overrides(overrides: DataFrame, catalogue: DataFrame | None) -> DataFrame:
    """Override rows (id, municipio, latitud, longitud): unusable id or blank
    municipality removed; own coordinates win, the catalogue (matched on the
    accent-folded name) fills the gaps; provenance texts added."""
    o = (overrides.withColumn("id", coerce_numeric(F.col("id")))
         .where(F.col("id").isNotNull())
         .withColumn("id", F.col("id").cast("long"))
         .withColumn("municipio", tx.strip_ws(F.col("municipio").cast("string")))
         .where(F.col("municipio").isNotNull() & (F.col("municipio") != ""))
         .withColumn("_mkey", tx.fold_accents(F.col("municipio")))
         .withColumn("latitud", coerce_numeric(F.col("latitud")))
         .withColumn("longitud", coerce_numeric(F.col("longitud"))))
    if catalogue is not None:
        cat = catalogue.select(tx.fold_accents(F.col("municipio")).alias("_ckey"),
                               coerce_numeric(F.col("latitud")).alias("_clat"),
                               coerce_numeric(F.col("longitud")).alias("_clon"))
        o = (hot_key_join(o, cat, "_mkey", "_ckey")
             .withColumn("latitud", F.coalesce(F.col("latitud"), F.col("_clat")))
             .withColumn("longitud", F.coalesce(F.col("longitud"), F.col("_clon"))))
    return o.select("id", "municipio", "latitud", "longitud",
                    F.lit(PRECISION_OVERRIDE).alias("precision_ubicacion"),
                    F.lit(DETAIL_OVERRIDE).alias("detalle_ubicacion"))


def apply_overrides(base: DataFrame, overrides: DataFrame | None) -> DataFrame:
    """Base rows get default municipality/provenance; a row takes the override
    only when the override's municipality, latitude and longitude are all
    present, and then all provenance columns switch together."""
    b = (base.withColumn("id", coerce_numeric(F.col("id")).cast("long"))
         .withColumn("municipio", F.lit(NO_MUNICIPALITY))
         .withColumn("precision_ubicacion", F.lit(PRECISION_APPROX))
         .withColumn("detalle_ubicacion", F.lit(DETAIL_APPROX))
         .withColumn("latitud", coerce_numeric(F.col("latitud")))
         .withColumn("longitud", coerce_numeric(F.col("longitud"))))
    if overrides is None:
        return b
    cols = ["municipio", "latitud", "longitud", "precision_ubicacion", "detalle_ubicacion"]
    o = overrides.select(F.col("id").alias("_oid"), *[F.col(c).alias(c + "_override") for c in cols])
    j = b.join(o, b["id"] == o["_oid"], "left").drop("_oid")
    has = (F.col("municipio_override").isNotNull() & F.col("latitud_override").isNotNull()
           & F.col("longitud_override").isNotNull())
    for c in cols:
        j = j.withColumn(c, F.when(has, F.col(c + "_override")).otherwise(F.col(c)))
    return j.drop(*[c + "_override" for c in cols])


# ------------------------------------------------------- F-str1 / J11 ----
def lookup_queries(name: Column, municipality: Column, region: Column, subarea: Column) -> Column:
    """Ordered, de-duplicated query texts: name+place+region, place+region,
    sub-area+region (only with a sub-area), region; each stripped of commas
    and blanks at both ends; empty texts dropped."""
    n, m, r, s = (tx.clean_text(c) for c in (name, municipality, region, subarea))
    c = F.lit(", " + COUNTRY)
    cands = [F.concat(n, F.lit(", "), m, F.lit(", "), r, c),
             F.concat(m, F.lit(", "), r, c),
             F.when(s != "", F.concat(s, F.lit(", "), r, c)).otherwise(F.lit("")),
             F.concat(r, c)]
    arr = F.array(*[tx.strip_query_edges(x) for x in cands])
    return F.array_distinct(F.filter(arr, lambda x: x != ""))


def waterfall_lookup(rows: DataFrame, gazetteer: DataFrame, row_id: str,
                     queries: Column, limit: int | None = None, dry_run: bool = False) -> DataFrame:
    """Fill missing coordinates from the first query with a hit.

    Only rows lacking latitude or longitude are looked up; a gazetteer row
    with NULL coordinates is a cached miss and is skipped. Output adds
    ``geocoding_query`` and ``geocoding_source``; rows with coordinates are
    untouched. ``limit`` caps the rows needing lookup (in ``row_id`` order);
    ``dry_run`` records the first query with source ``dry_run``.

    The queries are exploded with their position and equi-joined to the hits
    (a text that very many rows ask for is dealt over several tasks); the
    first hit per row is a ``min_by`` aggregate.
    """
    need_cond = F.col("latitud").isNull() | F.col("longitud").isNull()
    with_q = rows.withColumn("_queries", queries)
    need = with_q.where(need_cond).select(row_id, "_queries")
    if limit is not None:
        need = ordinal_within_key(need, [], [F.col(row_id).asc_nulls_first()], out="_nth").where(F.col("_nth") <= int(limit)).drop("_nth")
    if dry_run:
        picked = need.select(F.col(row_id).alias("_rid"), F.col("_queries")[0].alias("_q"),
                             F.lit(None).cast("double").alias("_lat"), F.lit(None).cast("double").alias("_lon"),
                             F.lit(DRY_RUN).alias("_src"))
    else:
        exploded = need.select(F.col(row_id).alias("_rid"), F.posexplode("_queries").alias("_pos", "_q"))
        hits = gazetteer.where(F.col("latitud").isNotNull() & F.col("longitud").isNotNull()).select(
            F.col("query").alias("_gq"), F.col("latitud").alias("_glat"),
            F.col("longitud").alias("_glon"), F.col("display_name").alias("_gsrc"))
        matched = hot_key_join(exploded, hits, "_q", "_gq", "inner")
        picked = matched.groupBy("_rid").agg(
            F.min_by(F.struct("_q", "_glat", "_glon", "_gsrc"),
                     F.struct("_pos", "_gsrc", "_glat", "_glon")).alias("_hit")
        ).select("_rid", F.col("_hit._q").alias("_q"), F.col("_hit._glat").alias("_lat"),
                 F.col("_hit._glon").alias("_lon"), F.col("_hit._gsrc").alias("_src"))
    out = with_q.drop("_queries").join(picked, F.col(row_id) == F.col("_rid"), "left")
    # a hit replaces both coordinates: half of one place is never joined to half of another
    hit = F.col("_lat").isNotNull() & F.col("_lon").isNotNull()
    return (out.withColumn("latitud", F.when(hit, F.col("_lat")).otherwise(F.col("latitud")))
            .withColumn("longitud", F.when(hit, F.col("_lon")).otherwise(F.col("longitud")))
            .withColumn("geocoding_query", F.col("_q"))
            .withColumn("geocoding_source", F.col("_src"))
            .drop("_rid", "_q", "_lat", "_lon", "_src"))


def cache_upsert(cache: DataFrame, results: DataFrame, key: str = "query",
                 order: Sequence[str] | None = None) -> DataFrame:
    """New lookups (hits and misses) are added for queries not yet cached;
    existing cache rows win (a cached query is never looked up again). Of
    several new rows of one query the first by ``order`` wins."""
    others = [c for c in cache.columns if c != key]
    rank = F.struct(*[F.col(c) for c in (order or others)])
    new = (results.join(cache.select(key), key, "left_anti").groupBy(key)
           .agg(F.min_by(F.struct(*others), rank).alias("_first")).select(key, "_first.*"))
    return cache.unionByName(new.select(*cache.columns))


# ---------------------------------------------------------------- J8 ------
def _ref_table(reference: DataFrame, x: str, y: str, value: str, order: str, decimals: int) -> DataFrame:
    """Unique rounded reference points: the last value in reference order
    wins, the first position is kept (dict-insertion semantics)."""
    return (reference.select(F.bround(coerce_numeric(F.col(x)), decimals).alias("_rx"),
                             F.bround(coerce_numeric(F.col(y)), decimals).alias("_ry"),
                             F.col(value).alias("_rv"), F.col(order).alias("_ro"))
            .where(F.col("_rx").isNotNull() & F.col("_ry").isNotNull())
            .groupBy("_rx", "_ry")
            .agg(F.max_by("_rv", "_ro").alias("_rv"), F.min("_ro").alias("_ro")))


def nearest_lookup(queries: DataFrame, reference: DataFrame, qid: str, qx: str, qy: str,
                   rx: str, ry: str, rvalue: str, rorder: str, out: str = "valor",
                   decimals: int = 4, bucket_size: int = 64, unknown: str | None = UNKNOWN) -> DataFrame:
    """Exact-then-nearest lookup of a value at a point.

    Query points are rounded to ``decimals``; an exact rounded hit takes the
    reference value. Otherwise the nearest reference point by squared
    Euclidean distance from the unrounded query wins, ties going to the first
    reference position. Query rows with a NULL or NaN
    coordinate get ``unknown``.

    Nearest search is exact without any all-pairs join; see
    :func:`nearest_candidates`.
    """
    ref = _ref_table(reference, rx, ry, rvalue, rorder, decimals)
    ref = cut_lineage(ref)
    q = queries.select(F.col(qid).alias("_qid"), coerce_numeric(F.col(qx)).alias("_qx"),
                       coerce_numeric(F.col(qy)).alias("_qy"))
    q = q.withColumn("_kx", F.bround("_qx", decimals)).withColumn("_ky", F.bround("_qy", decimals))
    exact = (q.join(ref, (q["_kx"] == ref["_rx"]) & (q["_ky"] == ref["_ry"]), "inner")
             .select("_qid", F.col("_rv").alias("_val"), F.lit("exacta").alias("_how")))
    pending = q.where(F.col("_qx").isNotNull() & F.col("_qy").isNotNull()) \
        .join(exact.select("_qid"), "_qid", "left_anti").select("_qid", "_qx", "_qy")

    pairs = nearest_candidates(pending, ref, decimals, bucket_size)
    d = (F.col("_qx") - F.col("_rx")) ** 2 + (F.col("_qy") - F.col("_ry")) ** 2
    near = pairs.groupBy("_qid").agg(F.min_by("_rv", F.struct(d, F.col("_ro"))).alias("_val"))
    res = exact.unionByName(near.withColumn("_how", F.lit("cercana")))
    out_df = queries.join(res, queries[qid] == res["_qid"], "left").drop("_qid")
    val = F.col("_val").cast("string")
    return (out_df.withColumn(out, F.coalesce(val, F.lit(unknown)) if unknown is not None else val)
            .withColumn("metodo", F.coalesce(F.col("_how"), F.lit("sin_coordenadas")))
            .drop("_val", "_how"))


def nearest_candidates(queries: DataFrame, ref: DataFrame, decimals: int = 4, bucket_size: int = 64) -> DataFrame:
    """Query rows (_qid, _qx, _qy) joined with the few reference points that can
    be nearest, found by a descent through square cells.

    All reference points are summarised once at every cell size from the whole
    extent down to cells of at most ``bucket_size`` points (or the rounding
    step). A query starts with the one coarsest cell and at every level keeps
    those children whose nearest possible point is no farther than some
    point certainly is in another child (by the cells' bounding boxes). A query
    far from all points thus meets a few cells per level instead of all points.
    """
    step = 10.0 ** -decimals
    st = ref.agg(F.count(F.lit(1)).alias("n"), F.min("_rx").alias("x0"), F.max("_rx").alias("x1"),
                 F.min("_ry").alias("y0"), F.max("_ry").alias("y1")).first()
    if not st["n"]:
        return queries.join(ref, F.lit(False))
    extent = max(st["x1"] - st["x0"], st["y1"] - st["y0"], step) * (1 + 1e-9)
    deepest = max(0, math.ceil(math.log2(extent / step)))

    def cell(level: int) -> list[Column]:
        size = extent / 2 ** level
        return [F.floor((F.col("_rx") - st["x0"]) / size).alias("_cx"), F.floor((F.col("_ry") - st["y0"]) / size).alias("_cy")]

    depth = min(deepest, max(0, math.ceil(math.log2(max(1.0, math.sqrt(st["n"] / bucket_size))))))
    while depth < deepest:
        dense = ref.groupBy(*cell(depth)).count().agg(F.max("count")).first()[0]
        if dense <= bucket_size:
            break
        depth = min(deepest, depth + 2)
    kept = queries.withColumns({"_cx": F.lit(0).cast("long"), "_cy": F.lit(0).cast("long")})
    per_query = Window.partitionBy("_qid")
    for level in range(1, depth + 1):
        boxes = ref.groupBy(*cell(level)).agg(
            F.min("_rx").alias("_x0"), F.max("_rx").alias("_x1"), F.min("_ry").alias("_y0"), F.max("_ry").alias("_y1"))
        children = boxes.withColumns({"_px": F.shiftright("_cx", 1), "_py": F.shiftright("_cy", 1)})
        above = kept.withColumnsRenamed({"_cx": "_px", "_cy": "_py"})
        both = above.join(children, ["_px", "_py"])
        least, most = [], []
        for q, lo, hi in (("_qx", "_x0", "_x1"), ("_qy", "_y0", "_y1")):
            off = F.greatest(F.col(lo) - F.col(q), F.col(q) - F.col(hi), F.lit(0.0))
            far = F.greatest(F.abs(F.col(q) - F.col(lo)), F.abs(F.col(q) - F.col(hi)))
            least.append(off * off)
            most.append(far * far)
        ranked = both.select("_qid", "_qx", "_qy", "_cx", "_cy", (least[0] + least[1]).alias("_least"),
                             F.min(most[0] + most[1]).over(per_query).alias("_most"))
        kept = ranked.where(F.col("_least") <= F.col("_most") * (1 + 1e-9)).drop("_least", "_most")
        if level % 3 == 0:
            kept = cut_lineage(kept)
    points = ref.select("*", *cell(depth))
    return kept.join(points, ["_cx", "_cy"]).drop("_cx", "_cy")


# ------------------------------------------------------------ J9 / J10 ----
def positional_assignment(demand: DataFrame, candidates: DataFrame, keys: Sequence[str],
                          demand_order: Sequence[Column], candidate_order: Sequence[Column]) -> DataFrame:
    """Per key, the k-th demand row (in ``demand_order``) takes the k-th
    candidate (in ``candidate_order``); demand rows beyond the candidates of
    their key stay unassigned (candidate columns NULL, ``asignado`` false).

    Both sides are numbered with the skew-safe ordinal, then equi-joined on
    (key, position): every join key is unique, so a hot key is spread over
    many join partitions.
    """
    keys = list(keys)
    d = ordinal_within_key(demand, keys, list(demand_order), out="_pos")
    c = ordinal_within_key(candidates, keys, list(candidate_order), out="_pos")
    c = c.select(*[F.col(k).alias("_c_" + k) for k in keys], F.col("_pos").alias("_c_pos"),
                 *[F.col(x).alias(x) for x in c.columns if x not in keys and x != "_pos"])
    cond = null_safe_on(d, c, keys + ["_pos"], ["_c_" + k for k in keys] + ["_c_pos"])
    j = d.join(c, cond, "left")
    return (j.withColumn("asignado", F.col("_c_pos").isNotNull())
            .withColumnRenamed("_pos", "posicion").drop("_c_pos", *["_c_" + k for k in keys]))


def assignment_summary(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.count(F.lit(1)).alias("total"),
                        F.count_if(F.col("asignado")).alias("asignados"),
                        F.count_if(~F.col("asignado")).alias("sin_asignar"))
