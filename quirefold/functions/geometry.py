"""Geometry of elements as column expressions: derived edges, ranges, comparators, style."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = Column | str
#: Range queries look so far along the page.
REACH = 1000.0
SEPARATION, BORDER, ALIGNMENT = 1.0, 2.0, 7.0
FORM_OVERLAP, SMALL = 0.02, 8.0


def _c(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def derived(df: DataFrame) -> DataFrame:
    """``df`` with the eight derived edges and centres."""
    return df.withColumns({
        "bottom": F.col("top") + F.coalesce("height", F.lit(0.0)), "right": F.col("left") + F.coalesce("width", F.lit(0.0)),
        "h_centre": F.col("left") + F.col("width") / 2, "v_centre": F.col("top") + F.col("height") / 2,
        "v_end": F.col("top") + F.col("stretch"), "h_end": F.col("left") + F.col("stretch"),
    })


def between_open(x: C, lo: C, hi: C) -> Column:
    """lo < x < hi."""
    return (_c(x) > _c(lo)) & (_c(x) < _c(hi))


def between_half(x: C, lo: C, hi: C) -> Column:
    """lo <= x < hi."""
    return (_c(x) >= _c(lo)) & (_c(x) < _c(hi))


def intersects(lower: C, upper: C, lo: C, hi: C, reach: float | None = None) -> Column:
    """The interval lower..upper begins in lo..hi (hi excluded), or begins before lo, within reach, and ends after it."""
    l, u, lo, hi = map(_c, (lower, upper, lo, hi))
    near, far = (l <= lo), (u > lo)
    if reach is not None:
        near, far = near & (l > lo - reach), far & (u < lo + reach)
    return ((l >= lo) & (l < hi)) | (near & far)


def overlap(a_lo: C, a_hi: C, b_lo: C, b_hi: C) -> Column:
    """Length of the common part of two intervals, at least 0."""
    return F.greatest(F.least(_c(a_hi), _c(b_hi)) - F.greatest(_c(a_lo), _c(b_lo)), F.lit(0.0))


def tabular_intersects(column_left: C, column_right: C, left: C, width: C) -> Column:
    """An element wider than a sign shares more than that much with a column."""
    return (_c(width) > SMALL) & (F.least(_c(column_right), _c(left) + _c(width)) > F.greatest(_c(column_left), _c(left)) + SMALL)


def same_line(top1: C, height1: C, top2: C, height2: C, form: C | None = None) -> Column:
    """-n, 0 or n: whether the first of two elements stands above, on or below the other's line; n is whole points, 1 at least.

    A missing top gives 1; a missing height is 1.  A form field needs an overlap of more than a fiftieth of the lower height.
    """
    t1, t2 = _c(top1), _c(top2)
    b1, b2 = t1 + F.coalesce(_c(height1), F.lit(1.0)), t2 + F.coalesce(_c(height2), F.lit(1.0))
    shared = F.when((t1 >= t2) & (t1 <= b2), b2 - t1).when((t2 >= t1) & (t2 <= b1), b1 - t2).otherwise(0.0)
    low = F.least(b1 - t1, b2 - t2)
    least = F.lit(0.0) if form is None else F.when(_c(form), FORM_OVERLAP).otherwise(0.0)
    # overlap / low > least, free of a division by an element of no height
    on = F.when(low > 0, shared > least * low).otherwise(shared > 0)
    way = F.when(t1 < t2, F.least((t1 - t2).cast("int"), F.lit(-1))).otherwise(F.greatest((t1 - t2).cast("int"), F.lit(1)))
    return F.when(t1.isNull() | t2.isNull(), 1).when(on, 0).otherwise(way)


def same_column(left1: C, width1: C, left2: C, width2: C) -> Column:
    """-1, 0 or 1: 0 where the lefts differ by at most half of the lesser width."""
    l1, l2 = _c(left1), _c(left2)
    half = lambda w: F.coalesce(_c(w) / 2, F.lit(1.0))
    return F.when(F.abs(l1 - l2) <= F.least(half(width1), half(width2)), 0).when(l1 < l2, -1).otherwise(1)


def equal_or_absent(a: C, b: C) -> Column:
    return _c(a).eqNullSafe(_c(b))


def other_style(a: str, b: str) -> Column:
    """Two elements, structs or aliases, look different: size by 15 %, family, colour (black by default) or styles."""
    f = lambda side, name: F.col(f"{side}.{name}")
    size = F.when(f(a, "font_size").isNull() | f(b, "font_size").isNull(), ~f(a, "font_size").eqNullSafe(f(b, "font_size"))).otherwise(F.abs(f(a, "font_size") - f(b, "font_size")) >= 0.15 * F.greatest(f(a, "font_size"), f(b, "font_size")))
    styles = lambda side: F.array_sort(F.coalesce(f(side, "styles"), F.array().cast("array<string>")))
    return size | ~f(a, "font_family").eqNullSafe(f(b, "font_family")) | (F.coalesce(f(a, "rgb"), F.lit(0)) != F.coalesce(f(b, "rgb"), F.lit(0))) | (styles(a) != styles(b))


def slope_class(x1: C, y1: C, x2: C, y2: C) -> Column:
    """``vline`` or ``hline`` for a stroke steep or flat enough and longer than 5, else null."""
    dx, dy = F.abs(_c(x2) - _c(x1)), F.abs(_c(y2) - _c(y1))
    return F.when((dy >= 5.67 * dx) & (dy > 5), "vline").when((dy <= 0.18 * dx) & (dx > 5), "hline")
