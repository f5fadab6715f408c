"""Numeric column helpers that keep pandas' missing-value rules under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference) ------------------------------
# Nine-bin sequential palette of the year-slider choropleth, low to high,
# and the colour of a department without a value.
BIN_PALETTE = ["#ffffcc", "#ffeda0", "#fed976", "#feb24c", "#fd8d3c",
               "#fc4e2a", "#e31a1c", "#bd0026", "#800026"]
MISSING_COLOR = "#d9d9d9"
# Circle radius: 2 metres per kW with a 5 km floor.
RADIUS_PER_KW = 2.0
MIN_RADIUS = 5000.0
# ---------------------------------------------------------------------------


def coerce_numeric(c: Column) -> Column:
    """pandas ``to_numeric(errors='coerce')``: bad text -> NULL, NaN -> NULL.

    ``try_cast`` never raises under ANSI mode; it parses '1e3' and ' 3 '
    like pandas and rejects '1,5'.
    """
    d = c.try_cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def safe_div(num: Column, den: Column, default: float | None = 0.0) -> Column:
    """x / y without raising; division by zero, inf and NaN -> default."""
    q = F.try_divide(num, den)
    if default is None:
        return q
    return F.when(q.isNull() | F.isnan(q) | (F.abs(q) == float("inf")), F.lit(default)).otherwise(q)


def official_round(c: Column) -> Column:
    """Half-to-even to an integer, applied to the value rounded at 6 places so
    float noise of the fit cannot move a value off an exact half."""
    return F.bround(F.round(c, 6), 0)


def color_bin(value: Column, vmin: Column, vmax: Column, bins: int = 9) -> Column:
    """Bin index 0..bins-1: clamp((v-min)/(max-min),0,1)*(bins-1) rounded
    half-up; max<=min -> last bin; NULL value -> NULL."""
    top = bins - 1
    ratio = F.least(F.greatest((value - vmin) / (vmax - vmin), F.lit(0.0)), F.lit(1.0))
    idx = F.least(F.floor(ratio * top + 0.5), F.lit(top)).cast("int")
    return (F.when(value.isNull(), F.lit(None).cast("int"))
             .when(vmax <= vmin, F.lit(top))
             .otherwise(idx))


def bin_color(idx: Column) -> Column:
    palette = F.array(*[F.lit(x) for x in BIN_PALETTE])
    return F.when(idx.isNull(), F.lit(MISSING_COLOR)).otherwise(F.element_at(palette, idx + 1))


def pressure_radius(demand: Column) -> Column:
    return F.greatest(F.coalesce(demand, F.lit(0.0)) * RADIUS_PER_KW, F.lit(MIN_RADIUS))


# magnitudes below, from ... to (exclusive) and the decimal places kept of them
_CLASSES = [(0.0, 1e-6, 30), (1e-6, 1e13, 12), (1e13, 1e24, 2)]


def exact_sum(c: Column) -> Column:
    """Sum of doubles that does not depend on partitioning or retry order.

    A double sum does, in its last bits. Here every value is taken as its
    shortest decimal and summed exactly with the values of its magnitude (below
    1e-6, 1e13 and 1e24, with 30, 12 and 2 places; some 1e13 rows of the largest
    fit), and the three sums are added in a fixed order. Larger, infinite and
    NaN values are summed as doubles, so they show in the result as in a plain
    sum. NULL if there is no value.
    """
    x = c.cast("double")
    size = F.abs(x)
    total = F.lit(0.0)
    for low, high, places in _CLASSES:
        part = F.when((size >= low) & (size < high), x.cast(f"decimal(38,{places})"))
        total = total + F.coalesce(F.sum(part).cast("double"), F.lit(0.0))
    total = total + F.coalesce(F.sum(F.when(size >= _CLASSES[-1][1], x)), F.lit(0.0))
    return F.when(F.count(x) > 0, total)


def exact_avg(c: Column) -> Column:
    """Mean of the non-null values from their exact sum."""
    return exact_sum(c) / F.count(c.cast("double")).cast("double")
