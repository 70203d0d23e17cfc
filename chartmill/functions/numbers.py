"""Scalar laws, bins, units and boxes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_scale(v: Column, scale: Column | float) -> Column:
    return F.log1p(F.greatest(v, F.lit(0.0)) / scale)


def from_log_scale(z: Column, scale: Column | float) -> Column:
    return F.expm1(z) * scale


def depletion(v: Column, c0: Column | float, phi: Column | float, m: Column | float) -> Column:
    """Junction capacitance c0 / (1 + v / phi)^m."""
    return F.lit(c0) / F.pow(1 + v / F.lit(phi), F.lit(m))


def significant(x: Column, digits: int = 4) -> Column:
    """x rounded to so many significant digits; 0 stays."""
    e = digits - 1 - F.floor(F.log10(F.abs(F.nullif(x, F.lit(0.0)))))
    return F.coalesce(F.round(x * F.pow(F.lit(10.0), e.cast("double"))) / F.pow(F.lit(10.0), e.cast("double")), x)


def cell(share: Column, n: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(share * n))).cast("int")


def count_bin(n: Column) -> Column:
    return F.when(n == 0, "0").when(n == 1, "1").when(n <= 3, "2-3").when(n <= 7, "4-7").when(n <= 15, "8-15").when(n <= 31, "16-31").otherwise("32+")


def page_count_bin(n: Column) -> Column:
    return F.when(n <= 4, "1-4").when(n <= 8, "5-8").when(n <= 12, "9-12").when(n <= 16, "13-16").when(n <= 24, "17-24").otherwise("25+")


def page_size(w: Column, h: Column) -> Column:
    """a4, letter or the side ratio, with p for portrait and l for landscape."""
    ratio = F.format_string("r%.1f", F.round(F.greatest(w, h) / F.greatest(F.lit(1.0), F.least(w, h)), 1))
    base = F.when((F.abs(w - 595) < 25) & (F.abs(h - 842) < 35), "a4").when((F.abs(w - 612) < 25) & (F.abs(h - 792) < 35), "letter").otherwise(ratio)
    return F.concat(base, F.lit("-"), F.when(h >= w, "p").otherwise("l"))


def intersection(a: dict[str, Column], b: dict[str, Column]) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    return w * F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))


def area(b: dict[str, Column]) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    i = intersection(a, b)
    return F.coalesce(i / F.nullif(area(a) + area(b) - i, F.lit(0.0)), F.lit(0.0))


def overlap_of_smaller(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return F.coalesce(intersection(a, b) / F.nullif(F.least(area(a), area(b)), F.lit(0.0)), F.lit(0.0))


#: Unit -> (base unit, factor).
UNITS = {"pF": ("pF", 1.0), "nF": ("pF", 1e3), "uF": ("pF", 1e6), "pC": ("pC", 1.0), "nC": ("pC", 1e3), "mOhm": ("mOhm", 1.0), "Ohm": ("mOhm", 1e3)}


def in_base_unit(value: Column, unit: Column) -> Column:
    out = F.lit(None).cast("double")
    for u, (_, f) in UNITS.items():
        out = F.when(unit == u, value * f).otherwise(out)
    return out
