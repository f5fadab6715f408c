"""Scans of the input tables and the domain roles derived from them.

The engine's operators work on domain-shaped frames (registrations, assets,
places). ``registrations`` / ``assets`` map the star-schema test tables onto
those roles; every role is a lazy join over whole tables, so its size grows
with the data. Normalisation runs on the dimension rows *before* the joins,
so a department name is cleaned once per nation, not once per fact row.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import coerce_numeric
from ..functions.text import normalize_territory, standardize_text

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def synthetic_lat(key: Column) -> Column:
    """Deterministic latitude in [-4, 12] derived from an integer key."""
    return F.round(F.lit(-4.0) + F.pmod(key * 37, F.lit(1601)).cast("double") / 100.0, 4)


def synthetic_lon(key: Column) -> Column:
    """Deterministic longitude in [-79, -67] derived from an integer key."""
    return F.round(F.lit(-79.0) + F.pmod(key * 53, F.lit(1201)).cast("double") / 100.0, 4)


def departments(spark: SparkSession, sf_dir: str, with_region: bool = True) -> DataFrame:
    """nation -> (n_nationkey, departamento[, region])."""
    nation = read_table(spark, sf_dir, "nation")
    if not with_region:
        return nation.select("n_nationkey", normalize_territory(F.col("n_name")).alias("departamento"))
    region = read_table(spark, sf_dir, "region")
    return (nation.join(region, nation.n_regionkey == region.r_regionkey, "left")
            .select("n_nationkey", normalize_territory(F.col("n_name")).alias("departamento"),
                    F.col("r_name").alias("region")))


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per registration record (re-aim: one lineitem).

    Columns: anio, departamento, tipo_vehiculo, cantidad_ev, kwh_promedio,
    potencia_carga, consumo_wh_km. Only the needed columns reach the scans.
    """
    dept = departments(spark, sf_dir, with_region=False)
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.year("o_orderdate").alias("anio"))
    part = read_table(spark, sf_dir, "part").select(
        "p_partkey",
        standardize_text(F.col("p_type")).alias("tipo_vehiculo"),
        coerce_numeric(F.col("p_retailprice")).alias("potencia_carga"),
        coerce_numeric(F.col("p_size")).alias("consumo_wh_km"))
    lineitem = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber",
        F.coalesce(coerce_numeric(F.col("l_quantity")), F.lit(0.0)).alias("cantidad_ev"),
        coerce_numeric(F.col("l_extendedprice")).alias("kwh_promedio"))
    # orders-side dimension first (orders << lineitem), then the fact joins
    order_dim = (orders.join(customer, orders.o_custkey == customer.c_custkey)
                 .join(dept, F.col("c_nationkey") == dept.n_nationkey)
                 .select("o_orderkey", "o_custkey", "anio", "departamento"))
    return (lineitem.join(order_dim, lineitem.l_orderkey == order_dim.o_orderkey)
            .join(part, lineitem.l_partkey == part.p_partkey)
            .select("anio", "departamento", "tipo_vehiculo", "cantidad_ev", "kwh_promedio",
                    "potencia_carga", "consumo_wh_km", "o_custkey", "l_orderkey", "l_linenumber"))


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Infrastructure assets (re-aim: every supplier; capacity = balance)."""
    supplier = read_table(spark, sf_dir, "supplier")
    dept = departments(spark, sf_dir)
    return (supplier.join(dept, supplier.s_nationkey == dept.n_nationkey, "left")
            .select(F.col("s_suppkey").alias("id_activo"),
                    F.col("s_name").alias("nombre_activo"),
                    "departamento",
                    F.lit(None).cast("string").alias("municipio"),
                    F.col("region").alias("subarea"),
                    coerce_numeric(F.col("s_acctbal")).alias("capacidad_hidraulica"),
                    synthetic_lat(F.col("s_suppkey")).alias("latitud"),
                    synthetic_lon(F.col("s_suppkey")).alias("longitud")))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in any store Spark can read; other errors show."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001 - public Hadoop API
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)  # noqa: SLF001


def table_if_exists(spark: SparkSession, name: str, fallback_path: str | None = None,
                    fmt: str = "parquet", required: bool = False) -> DataFrame | None:
    """Catalog table if it exists, else a file path if it exists, else None
    (or an error when ``required``)."""
    if spark.catalog.tableExists(name):
        return spark.table(name)
    if fallback_path and path_exists(spark, fallback_path):
        return spark.read.format(fmt).option("header", True).load(fallback_path)
    if required:
        raise RuntimeError(f"required table '{name}' is not available; run the flow first")
    return None


# ---------------------------------------------------------------------------
# Raw registration records with the source's column names (before P1).
def registrations_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("departamento"))
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderstatus").alias("estado"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("fecha_registro"),
        F.year("o_orderdate").alias("anio_registro"))
    part = read_table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_type").alias("clase"),
        F.col("p_retailprice").alias("potencia_carga_dc_kw"),
        F.col("p_size").alias("consumo_wh_km"))
    lineitem = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", F.col("l_quantity").alias("cantidad"),
        F.col("l_extendedprice").alias("capacidad_kwh"))
    od = (orders.join(customer, orders.o_custkey == customer.c_custkey)
          .join(nation, F.col("c_nationkey") == nation.n_nationkey))
    return (lineitem.join(od, lineitem.l_orderkey == od.o_orderkey)
            .join(part, lineitem.l_partkey == part.p_partkey)
            .select("estado", "fecha_registro", "anio_registro", "clase", "departamento", "cantidad",
                    "capacidad_kwh", "consumo_wh_km", "potencia_carga_dc_kw"))


# rename map of the source columns (fixed values)
MASTER_RENAMES = {
    "anio_registro": "anio",
    "clase": "tipo_vehiculo",
    "cantidad": "cantidad_ev",
    "capacidad_kwh": "kwh_promedio",
    "potencia_carga_dc_kw": "potencia_carga",
}


def load_master(raw: DataFrame) -> DataFrame:
    """P1 + P2: rename, keep the other columns, normalise the keys and
    coerce the measures (count missing -> 0, absent measure -> NULL)."""
    df = raw.withColumnsRenamed({k: v for k, v in MASTER_RENAMES.items() if k in raw.columns})
    adds = {
        "departamento": normalize_territory(F.col("departamento")),
        "tipo_vehiculo": standardize_text(F.col("tipo_vehiculo")),
        "anio": coerce_numeric(F.col("anio")),
        "cantidad_ev": F.coalesce(coerce_numeric(F.col("cantidad_ev")), F.lit(0.0)),
    }
    for c in ("kwh_promedio", "potencia_carga", "consumo_wh_km"):
        adds[c] = coerce_numeric(F.col(c)) if c in df.columns else F.lit(None).cast("double")
    return df.withColumns(adds)
