from pyspark.sql import functions as F

from territoria.functions import numeric as nu
from territoria.functions import text as tx


def col1(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {dtype}")
    return [r[0] for r in df.select(expr(F.col("v"))).collect()]


def test_coerce_numeric(spark):
    got = col1(spark, ["3", " 3 ", "1e3", "1,5", "x", "NaN", None], nu.coerce_numeric)
    assert got == [3.0, 3.0, 1000.0, None, None, None, None]


def test_normalize_territory(spark):
    got = col1(spark, [" Bogotá ", "GUAJIRA", "San  Andrés y Providencia", None, "São",
                       " bogota\n", "BOGOTÁ D.C."], tx.normalize_territory)
    assert got == ["BOGOTA D.C.", "LA GUAJIRA", "ARCHIPIELAGO DE SAN ANDRES, PROVIDENCIA", None, "SÃO",
                   "BOGOTA D.C.", "BOGOTA D.C."]


def test_standardize_and_fold(spark):
    assert col1(spark, [" José ", None], tx.standardize_text) == ["JOSÉ", None]
    assert col1(spark, [" José ", None, "straße", "ﬁn Ĳ"], tx.fold_accents) == ["JOSE", "", "STRASSE", "FIN IJ"]


def test_query_edges_and_format(spark):
    assert col1(spark, [", VALLE, Colombia", " , x ,"], tx.strip_query_edges) == ["VALLE, Colombia", "x"]
    got = col1(spark, [1234567.125, None, float("nan"), -0.5], lambda c: tx.format_metric(c, "kW", 2), "double")
    assert got == ["1.234.567,12 kW", "0,00 kW", "0,00 kW", "-0,50 kW"]


def test_labels_and_colors(spark):
    assert col1(spark, ["bogota d.c. ", "ANTIOQUIA"], tx.display_label) == ["BOGOTA", "ANTIOQUIA"]
    assert col1(spark, ["alta", "BAJA", None, "x"], tx.category_color) == ["#d73027", "#1a9850", "#4575b4", "#4575b4"]


def test_color_bin(spark):
    df = spark.createDataFrame([(0.5, 0.0, 1.0), (None, 0.0, 1.0), (3.0, 2.0, 2.0), (2.0, 0.0, 1.0),
                                (0.0625, 0.0, 1.0)], "v double, a double, b double")
    got = [r[0] for r in df.select(nu.color_bin(F.col("v"), F.col("a"), F.col("b"))).collect()]
    assert got == [4, None, 8, 8, 1]
    colors = [r[0] for r in df.select(nu.bin_color(nu.color_bin(F.col("v"), F.col("a"), F.col("b")))).collect()]
    assert colors[1] == nu.MISSING_COLOR and colors[2] == nu.BIN_PALETTE[-1]


def test_pressure_radius(spark):
    assert col1(spark, [100.0, 4000.0, None], nu.pressure_radius, "double") == [5000.0, 8000.0, 5000.0]


def test_fold_beyond_latin(spark):
    texts = ["Йод", "Άλφα", "ＡＢＣ", "한", "ﬁn ½", "e\u0301", "São Paulo", "Ñandú ß", "\u0130x", None]
    got = col1(spark, texts, tx.fold_accents)
    want = [tx.unaccented(t.strip().upper()) if t is not None else "" for t in texts]
    assert got == want and got[0] == "ИОД" and got[2] == "ABC"


def test_strip_keeps_inner_blanks_fast(spark):
    assert col1(spark, ["\u2003 a" + " " * 20000 + "b \u00a0"], tx.strip_ws) == ["a" + " " * 20000 + "b"]
