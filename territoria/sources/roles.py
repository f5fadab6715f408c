"""Side-job roles derived from the test tables (whole tables, lazy):

* places needing a lookup  <- customer (+ nation, region); a customer with a
  negative balance has no coordinates;
* gazetteer / lookup cache <- customers with coordinates (segment level),
  assets (region level) and nations (department level; a nation without any
  supplier is a cached miss);
* nearest-lookup points    <- embeddings (x, y = first two components; the
  reference layer uses the next two, plus the label-0 vectors' own points so
  that exact hits occur);
* plants / overrides / municipality catalogue <- documents and labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import exact_avg
from ..functions.text import normalize_territory
from .tables import assets, departments, read_table, synthetic_lat, synthetic_lon


def customers_geo(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer")
    dept = departments(spark, d)
    has = F.col("c_acctbal") >= 0
    return (c.join(dept, c.c_nationkey == dept.n_nationkey, "left")
            .select("c_custkey", F.col("c_name").alias("nombre"), F.col("c_mktsegment").alias("municipio"),
                    "departamento", F.col("region").alias("subarea"),
                    F.when(has, synthetic_lat(F.col("c_custkey"))).alias("latitud"),
                    F.when(has, synthetic_lon(F.col("c_custkey"))).alias("longitud")))


def gazetteer(spark: SparkSession, d: str, include_segments: bool = True) -> DataFrame:
    """(query, latitud, longitud, display_name); NULL coordinates = cached miss."""
    parts = []
    if include_segments:
        cg = customers_geo(spark, d).where(F.col("latitud").isNotNull() & F.col("longitud").isNotNull())
        seg = cg.groupBy("municipio", "departamento").agg(
            F.round(exact_avg(F.col("latitud")), 4).alias("latitud"), F.round(exact_avg(F.col("longitud")), 4).alias("longitud"))
        parts.append(seg.select(F.concat(F.col("municipio"), F.lit(", "), F.col("departamento"),
                                          F.lit(", Colombia")).alias("query"),
                                "latitud", "longitud"))
    reg = assets(spark, d).groupBy("subarea", "departamento").agg(
        F.round(exact_avg(F.col("latitud")), 4).alias("latitud"), F.round(exact_avg(F.col("longitud")), 4).alias("longitud"))
    parts.append(reg.select(F.concat(F.col("subarea"), F.lit(", "), F.col("departamento"),
                                     F.lit(", Colombia")).alias("query"), "latitud", "longitud"))
    nation = read_table(spark, d, "nation")
    with_supplier = read_table(spark, d, "supplier").select(F.col("s_nationkey").alias("_k")).distinct()
    dep = nation.join(with_supplier, nation.n_nationkey == with_supplier._k, "left")
    known = F.col("_k").isNotNull()
    parts.append(dep.select(F.concat(normalize_territory(F.col("n_name")), F.lit(", Colombia")).alias("query"),
                            F.when(known, synthetic_lat(F.col("n_nationkey"))).alias("latitud"),
                            F.when(known, synthetic_lon(F.col("n_nationkey"))).alias("longitud")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("display_name", F.when(F.col("latitud").isNotNull(), F.col("query")))


def embedding_queries(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "embeddings")
    return e.select("vec_id", F.col("embedding")[0].cast("double").alias("x"),
                    F.col("embedding")[1].cast("double").alias("y"))


def embedding_reference(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "embeddings")
    main = e.select(F.col("embedding")[2].cast("double").alias("x"), F.col("embedding")[3].cast("double").alias("y"),
                    F.col("label").alias("valor"), (F.col("vec_id") * 2).alias("orden"))
    own = e.where(F.col("label") == 0).select(
        F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"),
        F.col("label").alias("valor"), (F.col("vec_id") * 2 + 1).alias("orden"))
    return main.unionByName(own)


def municipality_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """(municipio, latitud, longitud): one row per document source."""
    docs = read_table(spark, d, "documents")
    return docs.groupBy(F.upper("source").alias("municipio")).agg(
        F.round(exact_avg(synthetic_lat(F.col("doc_id"))), 4).alias("latitud"),
        F.round(exact_avg(synthetic_lon(F.col("doc_id"))), 4).alias("longitud"))


def raw_overrides(spark: SparkSession, d: str) -> DataFrame:
    """(id, municipio, latitud, longitud): labelled documents; own
    coordinates only for quality documents, longitude only when not toxic."""
    lab = read_table(spark, d, "labels")
    docs = read_table(spark, d, "documents").select("doc_id", "source")
    j = lab.join(docs, "doc_id", "left")
    return j.select(F.col("doc_id").alias("id"),
                    F.concat(F.lit(" "), F.col("source"), F.lit(" ")).alias("municipio"),
                    F.when(F.col("quality") == 1, synthetic_lat(F.col("doc_id"))).alias("latitud"),
                    F.when((F.col("quality") == 1) & (F.col("toxic") == 0),
                           synthetic_lon(F.col("doc_id"))).alias("longitud"))


def plants(spark: SparkSession, d: str) -> DataFrame:
    """Base rows for the override join: every document with an approximate
    (department-level) coordinate."""
    docs = read_table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.upper("lang").alias("departamento"),
                       F.round(synthetic_lat(F.col("doc_id")) / 2, 4).alias("latitud"),
                       F.round(synthetic_lon(F.col("doc_id")) / 2, 4).alias("longitud"))


def suppliers_by_nation(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "supplier")
    n = read_table(spark, d, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey, "left").select("s_suppkey", "s_name", "n_name")


def customers_by_nation(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer")
    n = read_table(spark, d, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").select("c_custkey", "c_name", "n_name")
