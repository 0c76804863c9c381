"""Boxes (x0, y0, x1, y1) as struct columns: overlaps, clipping, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def _span(a: Column, b: Column, lo: str, hi: str) -> Column:
    return F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared area per area of ``a``; 0 for an empty box."""
    area = (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])
    return F.when(area > 0, _span(a, b, "x0", "x1") * _span(a, b, "y0", "y1") / F.nullif(area, F.lit(0.0))).otherwise(0.0)


def vertical_overlap_ratio(a: Column, b: Column) -> Column:
    height = a["y1"] - a["y0"]
    return F.when(height > 0, _span(a, b, "y0", "y1") / F.nullif(height, F.lit(0.0))).otherwise(0.0)


def covered_by_table(a: Column, b: Column) -> Column:
    """Text blocks that a table repeats."""
    return (overlap_ratio(a, b) >= 0.6) | ((vertical_overlap_ratio(a, b) >= 0.85) & (overlap_ratio(a, b) > 0))


def expand(a: Column, pad: Column, width: Column, height: Column) -> Column:
    """Padded and clipped to the page."""
    zero = F.lit(0.0)
    return box(F.greatest(zero, a["x0"] - pad), F.greatest(zero, a["y0"] - pad), F.least(width, a["x1"] + pad), F.least(height, a["y1"] + pad))


def key(a: Column) -> Column:
    """Corners to two decimals: equal cells of a spanning table have one key."""
    return F.concat_ws(",", *(F.bround(a[c], 2).cast("string") for c in ("x0", "y0", "x1", "y1")))


def in_margin(a: Column, page_height: Column, margin: float = 0.05) -> Column:
    return (a["y1"] <= page_height * margin) | (a["y0"] >= page_height * (1 - margin))
