"""Text normalisation as Spark column expressions.

All helpers take and return ``Column`` objects so Catalyst keeps them inside
whole-stage codegen; only ``fold_accents`` hands the rare texts beyond Latin
letters to a vectorised function.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# --- fixed values (must equal the reference) ------------------------------
# Department accent map applied after upper-casing.
DEPARTMENT_ACCENTS_FROM = "ÁÉÍÓÚÜáéíóúüÑñ"
DEPARTMENT_ACCENTS_TO = "AEIOUUaeiouuNn"
# Department aliases, looked up after accents and white space are normalised.
DEPARTMENT_ALIASES = {
    "BOGOTA": "BOGOTA D.C.",
    "BOGOTA, D.C.": "BOGOTA D.C.",
    "BOGOTÁ D.C.": "BOGOTA D.C.",
    "D.C. BOGOTA": "BOGOTA D.C.",
    "SAN ANDRES Y PROVIDENCIA": "ARCHIPIELAGO DE SAN ANDRES, PROVIDENCIA",
    "ARCHIPIELAGO DE SAN ANDRES Y PROVIDENCIA": "ARCHIPIELAGO DE SAN ANDRES, PROVIDENCIA",
    "ARCHIPIELAGO DE SAN ANDRES PROVIDENCIA": "ARCHIPIELAGO DE SAN ANDRES, PROVIDENCIA",
    "GUAJIRA": "LA GUAJIRA",
}
# Short labels for map display.
DISPLAY_LABELS = {
    "ARCHIPIELAGO DE SAN ANDRES, PROVIDENCIA": "SAN ANDRES",
    "ARCHIPIELAGO DE SAN ANDRES, PROVIDENCIA Y SANTA CATALINA": "SAN ANDRES",
    "BOGOTA D.C.": "BOGOTA",
    "VALLE DEL CAUCA": "VALLE",
    "NORTE DE SANTANDER": "N. SANTANDER",
}
# Priority category colours and the fallback colour.
CATEGORY_COLORS = {"ALTA": "#d73027", "MEDIA": "#fee08b", "BAJA": "#1a9850"}
DEFAULT_CATEGORY_COLOR = "#4575b4"
# ---------------------------------------------------------------------------


def _python_space_chars() -> str:
    """Characters for which Python's ``str.isspace`` is true (BMP)."""
    return "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def _regex_class(chars: str) -> str:
    """Regex character class for a set of characters, written as ranges of
    consecutive code points (a long list of single characters is scanned
    linearly per input character by the regex engine)."""
    cps = sorted({ord(c) for c in chars})
    parts, i = [], 0
    while i < len(cps):
        j = i
        while j + 1 < len(cps) and cps[j + 1] == cps[j] + 1:
            j += 1
        lo, hi = cps[i], cps[j]
        parts.append(f"\\x{{{lo:x}}}" if lo == hi else f"\\x{{{lo:x}}}-\\x{{{hi:x}}}")
        i = j + 1
    return "[" + "".join(parts) + "]"


# Java-regex character class equal to Python's white space set; used for
# strip() and for the ``\s+`` collapse so results agree with the reference.
WS_CLASS = _regex_class(_python_space_chars())


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()``: remove all Unicode white space at both ends."""
    return F.btrim(c, F.lit(_python_space_chars()))


def collapse_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"{WS_CLASS}+", " ")


def standardize_text(c: Column) -> Column:
    """Strip + upper; accents are kept. NULL stays NULL."""
    return F.upper(strip_ws(c))


def normalize_territory(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """Department key: strip -> upper -> fixed accent map -> collapse white
    space -> alias map. NULL stays NULL; accents outside the map survive."""
    aliases = DEPARTMENT_ALIASES if aliases is None else aliases
    base = collapse_ws(F.translate(F.upper(strip_ws(c)), DEPARTMENT_ACCENTS_FROM, DEPARTMENT_ACCENTS_TO))
    if not aliases:
        return base
    lookup = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(lookup[base], base)


def unaccented(text: str) -> str:
    """Compatibility-decomposed text without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@F.pandas_udf(StringType())
def _unaccented(texts: pd.Series) -> pd.Series:
    return texts.map(unaccented, na_action="ignore")


@lru_cache(maxsize=1)
def _latin_fold() -> tuple[str, str, str]:
    """By rule from ``unicodedata``: Latin letters that fold to one letter,
    those letters, and the class of all characters that need more than that."""
    single = {}
    plain = []
    for cp in (*range(0x250), *range(0x1E00, 0x1F00)):
        folded = unaccented(chr(cp))
        if len(folded) == 1:
            plain.append(chr(cp))
            if folded != chr(cp):
                single[chr(cp)] = folded
    return "".join(single), "".join(single.values()), "[^" + _regex_class("".join(plain))[1:]


def fold_accents(c: Column, null_as_empty: bool = True) -> Column:
    """Strip, upper, compatibility-decompose and drop combining marks.

    Latin texts fold with one ``translate``; only texts with another character
    (other scripts, ligatures, combining marks) pass a vectorised function,
    which gets NULL for all others. NULL becomes ``""`` (municipality key
    semantics) unless ``null_as_empty=False``.
    """
    src, dst, other = _latin_fold()
    base = F.upper(strip_ws(c))
    more = base.rlike(other)
    out = F.coalesce(_unaccented(F.when(more, base)), F.translate(base, src, dst))
    return F.coalesce(out, F.lit("")) if null_as_empty else out


def strip_query_edges(c: Column) -> Column:
    """Python ``s.strip(", ")``: drop commas and blanks at both ends."""
    return F.regexp_replace(c, r"^[, ]+|[, ]+$", "")


def clean_text(c: Column) -> Column:
    """NULL -> "" then strip."""
    return strip_ws(F.coalesce(c.cast("string"), F.lit("")))


def display_label(c: Column) -> Column:
    cleaned = F.upper(strip_ws(c.cast("string")))
    lookup = F.create_map(*[F.lit(x) for kv in DISPLAY_LABELS.items() for x in kv])
    return F.coalesce(lookup[cleaned], cleaned)


def category_color(c: Column) -> Column:
    lookup = F.create_map(*[F.lit(x) for kv in CATEGORY_COLORS.items() for x in kv])
    return F.coalesce(lookup[F.upper(F.coalesce(c.cast("string"), F.lit("None")))],
                      F.lit(DEFAULT_CATEGORY_COLOR))


def format_metric(c: Column, unit: str, decimals: int = 2) -> Column:
    """es-CO number text: thousands '.', decimals ',', fixed decimals + unit.
    NULL/NaN print as 0 (the reference prints ``nan`` for NaN)."""
    value = F.when(c.isNull() | F.isnan(c), F.lit(0.0)).otherwise(c.cast("double"))
    text = F.translate(F.format_number(value, decimals), ",.", ".,")
    return F.trim(F.concat(text, F.lit(" " + unit))) if unit else text
